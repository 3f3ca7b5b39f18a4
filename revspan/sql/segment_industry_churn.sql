-- Ever-churned share of the accounts by industry; lifetime flags, so no months are asked for.
CREATE OR REPLACE TEMPORARY FUNCTION metric_segment_industry_churn()
RETURNS TABLE (industry STRING, n_accounts BIGINT, n_churned BIGINT, churn_rate_pct DECIMAL(30, 1))
RETURN
    SELECT industry, count(*), count_if(churn_flag), 0.1 * rounded_ratio(count_if(churn_flag), count(*), 1000)
    FROM accounts GROUP BY industry;
