-- Revenue at the start, what moved it, and revenue at the end of every month asked for.
CREATE OR REPLACE TEMPORARY FUNCTION metric_mrr_waterfall(first_month DATE, last_month DATE)
RETURNS TABLE (
    month_start DATE, starting_mrr DECIMAL(22, 2), new_mrr DECIMAL(22, 2), expansion_mrr DECIMAL(22, 2),
    contraction_mrr DECIMAL(22, 2), churned_mrr DECIMAL(22, 2), ending_mrr DECIMAL(22, 2))
RETURN
    SELECT month_start, starting_mrr, new_mrr, expansion_mrr, contraction_mrr, churned_mrr, ending_mrr
    FROM monthly_flows WHERE month_start BETWEEN first_month AND last_month;
