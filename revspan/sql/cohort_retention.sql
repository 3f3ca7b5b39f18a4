-- Share of each month's first subscribers who pay in the months asked for.
CREATE OR REPLACE TEMPORARY FUNCTION metric_cohort_retention(first_month DATE, last_month DATE)
RETURNS TABLE (
    cohort_month DATE, months_since_signup INT, cohort_size BIGINT, active_accounts BIGINT, retention_pct DECIMAL(30, 1))
RETURN
    WITH cohorts AS (
        SELECT account_id, trunc(min(start_date), 'MM') AS cohort_month FROM subscriptions GROUP BY account_id
    ), sizes AS (
        SELECT cohort_month, count(*) AS cohort_size FROM cohorts GROUP BY cohort_month
    ), present AS (
        SELECT cohort_month, month_start, count_if(mrr > 0) AS active_accounts
        FROM account_month_mrr JOIN cohorts USING (account_id)
        WHERE month_start BETWEEN first_month AND last_month AND month_start >= cohort_month
        GROUP BY cohort_month, month_start
    )
    SELECT cohort_month, CAST(round(months_between(month_start, cohort_month)) AS INT), cohort_size, active_accounts,
           0.1 * rounded_ratio(active_accounts, cohort_size, 1000)
    FROM present JOIN sizes USING (cohort_month);
