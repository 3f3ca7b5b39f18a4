-- numerator * factor / denominator in whole numbers, half away from zero; NULL for a zero denominator.
-- Quotient and remainder are taken on cents, as a division of wide decimals would be cut to six places.
CREATE OR REPLACE TEMPORARY FUNCTION rounded_ratio(numerator DECIMAL(30, 2), denominator DECIMAL(30, 2), factor INT)
RETURNS DECIMAL(29, 0)
RETURN CASE WHEN denominator <> 0 THEN
    sign(numerator) * sign(denominator) * CAST((
        CAST(abs(numerator) * 200 * factor + abs(denominator) * 100 AS DECIMAL(38, 0))
        - CAST(abs(numerator) * 200 * factor + abs(denominator) * 100 AS DECIMAL(38, 0)) % CAST(abs(denominator) * 200 AS DECIMAL(38, 0))
    ) / CAST(abs(denominator) * 200 AS DECIMAL(38, 0)) AS DECIMAL(29, 0))
END;
