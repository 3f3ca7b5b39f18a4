-- Revenue by the accounts' industry at each month end asked for; only paying accounts are active.
CREATE OR REPLACE TEMPORARY FUNCTION metric_segment_monthly_industry_mrr(first_month DATE, last_month DATE)
RETURNS TABLE (
    month_start DATE, industry STRING, active_accounts BIGINT, total_mrr DECIMAL(22, 2), avg_mrr_per_account DECIMAL(31, 2))
RETURN
    SELECT month_start, industry, count_if(mrr > 0), sum(mrr),
           0.01 * rounded_ratio(sum(mrr) FILTER (WHERE mrr > 0), count_if(mrr > 0), 100)
    FROM account_month_mrr
    WHERE month_start BETWEEN first_month AND last_month
    GROUP BY month_start, industry;
