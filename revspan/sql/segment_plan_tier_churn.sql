-- Ever-churned share of the accounts by plan_tier; lifetime flags, so no months are asked for.
CREATE OR REPLACE TEMPORARY FUNCTION metric_segment_plan_tier_churn()
RETURNS TABLE (plan_tier STRING, n_accounts BIGINT, n_churned BIGINT, churn_rate_pct DECIMAL(30, 1))
RETURN
    SELECT plan_tier, count(*), count_if(churn_flag), 0.1 * rounded_ratio(count_if(churn_flag), count(*), 1000)
    FROM accounts GROUP BY plan_tier;
