-- What moved in every month, for the waterfall and the rates on top of it; a filter on month_start reaches the changes.
CREATE OR REPLACE TEMPORARY VIEW monthly_flows AS
    SELECT month_start, sum(prior_mrr) AS starting_mrr,
           coalesce(sum(mrr_delta) FILTER (WHERE movement_type = 'new'), 0) AS new_mrr,
           coalesce(sum(mrr_delta) FILTER (WHERE movement_type = 'expansion'), 0) AS expansion_mrr,
           coalesce(sum(mrr_delta) FILTER (WHERE movement_type = 'contraction'), 0) AS contraction_mrr,
           coalesce(sum(mrr_delta) FILTER (WHERE movement_type = 'churned'), 0) AS churned_mrr,
           sum(current_mrr) AS ending_mrr
    FROM account_mrr_changes GROUP BY month_start;
