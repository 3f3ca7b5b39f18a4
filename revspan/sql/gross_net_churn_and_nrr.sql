-- Churn and retention rates of every month asked for; NULL where nothing could be lost.
CREATE OR REPLACE TEMPORARY FUNCTION metric_gross_net_churn_and_nrr(first_month DATE, last_month DATE)
RETURNS TABLE (
    month_start DATE, starting_mrr DECIMAL(22, 2), expansion_mrr DECIMAL(22, 2), contraction_mrr DECIMAL(22, 2),
    churned_mrr DECIMAL(22, 2), gross_mrr_churn_rate_pct DECIMAL(31, 2), net_mrr_churn_rate_pct DECIMAL(31, 2),
    nrr_pct DECIMAL(31, 2))
RETURN
    WITH flows AS (
        SELECT *, contraction_mrr + churned_mrr AS lost
        FROM monthly_flows WHERE month_start BETWEEN first_month AND last_month
    )
    SELECT month_start, starting_mrr, expansion_mrr, contraction_mrr, churned_mrr,
           0.01 * rounded_ratio(-lost, starting_mrr, 10000),
           0.01 * rounded_ratio(-lost - expansion_mrr, starting_mrr, 10000),
           0.01 * rounded_ratio(starting_mrr + expansion_mrr + lost, starting_mrr, 10000)
    FROM flows;
