-- Revenue by the tier held at each month end asked for.
CREATE OR REPLACE TEMPORARY FUNCTION metric_segment_monthly_mrr(first_month DATE, last_month DATE)
RETURNS TABLE (
    month_start DATE, plan_tier STRING, active_accounts BIGINT, total_mrr DECIMAL(22, 2), avg_mrr_per_account DECIMAL(31, 2))
RETURN
    SELECT month_start, plan_tier, count(*), sum(mrr), 0.01 * rounded_ratio(sum(mrr), count(*), 100)
    FROM account_month_mrr
    WHERE plan_tier IS NOT NULL AND month_start BETWEEN first_month AND last_month
    GROUP BY month_start, plan_tier;
