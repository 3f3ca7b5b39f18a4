"""DuckDB SQL for every registered query.

Written from what the metrics mean, with integer cents: at a month end an account shows its
last-started subscription unless that one has ended, and is compared with itself a month ago.
It shares neither plans nor arithmetic with the Spark operators it checks.
"""

from __future__ import annotations

SUBS = """
last_ship AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1),
subs AS (
  SELECT o_orderkey AS subscription_id, o_custkey AS account_id,
         CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderstatus = 'F' THEN s.last_day END AS end_date,
         o_orderpriority AS plan_tier, o_orderstatus = 'P' AS is_trial,
         o_orderpriority = '1-URGENT' AS upgrade_flag, o_orderpriority = '5-LOW' AS downgrade_flag,
         CASE WHEN o_orderstatus = 'P' THEN 0
              ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS HUGEINT) END AS cents
  FROM orders LEFT JOIN last_ship s ON l_orderkey = o_orderkey)"""

ACCTS = SUBS + """,
first_sub AS (
  SELECT account_id, plan_tier, start_date FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY start_date, subscription_id) AS rn
    FROM subs) WHERE rn = 1),
accts AS (
  SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry,
         c_nationkey, f.plan_tier, c_acctbal < 0 AS churn_flag,
         f.start_date - CAST(c_custkey % 40 AS INTEGER) AS signup_date
  FROM customer LEFT JOIN first_sub f ON f.account_id = c_custkey)"""

CAL = """,
cal AS (
  SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end
  FROM (SELECT unnest(generate_series(
          date_trunc('month', (SELECT min(start_date) FROM subs)),
          date_trunc('month', (SELECT max(start_date) FROM subs)), INTERVAL 1 MONTH)) AS m))"""

TIMELINE = """,
careers AS (
  SELECT account_id, list(start_date ORDER BY start_date, subscription_id) AS days,
         list(subscription_id ORDER BY start_date, subscription_id) AS ids
  FROM subs GROUP BY account_id),
timeline AS (
  SELECT subs.*, days[list_position(ids, subscription_id) + 1] AS next_start_date,
         least(end_date, days[list_position(ids, subscription_id) + 1] - 1) AS effective_end_date
  FROM subs JOIN careers USING (account_id))"""

PANEL = ACCTS + CAL + TIMELINE + """,
newest AS (
  SELECT account_id, month_start, month_end,
         last(subscription_id ORDER BY start_date, subscription_id) AS subscription_id
  FROM subs JOIN cal ON start_date <= month_end GROUP BY ALL),
shown AS (
  SELECT n.account_id, n.month_start, cents, plan_tier
  FROM newest n JOIN subs USING (subscription_id)
  WHERE coalesce(end_date, month_end) >= month_end),
panel AS (
  SELECT cal.month_start, a.account_id, a.industry, CAST(coalesce(s.cents, 0) AS HUGEINT) AS cents,
         s.plan_tier, CAST(s.account_id IS NOT NULL AS BIGINT) AS n_matches
  FROM cal CROSS JOIN accts a
  LEFT JOIN shown s ON (s.account_id, s.month_start) = (a.account_id, cal.month_start))"""

def movement(prior: str, current: str) -> str:
    """Kind of a change: a positive amount out of nothing is new, one that turns to nothing has churned; all else goes by
    its sign, negative amounts too."""
    return f"""CASE WHEN {current} = {prior} THEN 'unchanged'
              WHEN {prior} = 0 AND {current} > 0 THEN 'new'
              WHEN {current} = 0 AND {prior} > 0 THEN 'churned'
              WHEN {current} - {prior} > 0 THEN 'expansion' ELSE 'contraction' END"""


MOVES = PANEL + f""",
moves AS (
  SELECT p.month_start, p.account_id, p.cents AS cur, coalesce(q.cents, 0) AS prior,
         p.cents - coalesce(q.cents, 0) AS delta,
         {movement('coalesce(q.cents, 0)', 'p.cents')} AS kind
  FROM panel p LEFT JOIN panel q
    ON q.account_id = p.account_id AND q.month_start + INTERVAL 1 MONTH = p.month_start)"""


def scaled(numerator: str, denominator: str, factor: int) -> str:
    """numerator * factor / denominator, rounded half away from zero, as an integer."""
    n, d = f"({numerator})", f"({denominator})"
    return (
        f"(CASE WHEN {d} <> 0 THEN sign({n}) * "
        f"((abs({n}) * {2 * factor} + {d}) // (2 * {d})) END)"
    )


def shown(integer: str, scale: int) -> str:
    return f"(CAST({integer} AS DOUBLE) / {scale})"


def money(cents: str, name: str) -> str:
    return f"{shown(cents, 100)} AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _flow(kind: str) -> str:
    return f"CAST(coalesce(sum(delta) FILTER (kind = '{kind}'), 0) AS HUGEINT)"


WATERFALL = MOVES + f""",
wf AS (
  SELECT month_start, CAST(sum(prior) AS HUGEINT) AS starting, {_flow('new')} AS new,
         {_flow('expansion')} AS exp, {_flow('contraction')} AS contr,
         {_flow('churned')} AS churned, CAST(sum(cur) AS HUGEINT) AS ending
  FROM moves GROUP BY month_start),
rates AS (
  SELECT *, {scaled('-(contr + churned)', 'starting', 10000)} AS gross,
         {scaled('-(contr + churned + exp)', 'starting', 10000)} AS net,
         {scaled('starting + exp + contr + churned', 'starting', 10000)} AS nrr
  FROM wf)"""

WATERFALL_COLUMNS = ", ".join([
    money("starting", "starting_mrr"), money("new", "new_mrr"), money("exp", "expansion_mrr"),
    money("contr", "contraction_mrr"), money("churned", "churned_mrr"),
    money("ending", "ending_mrr"),
])
RATE_COLUMNS = ", ".join([
    f"{shown('gross', 100)} AS gross_mrr_churn_rate_pct",
    f"{shown('net', 100)} AS net_mrr_churn_rate_pct", f"{shown('nrr', 100)} AS nrr_pct",
])

CHURN = f""",
churn AS (
  SELECT d.dimension, d.segment, count(*) AS n, count(*) FILTER (churn_flag) AS x,
         {scaled('count(*) FILTER (churn_flag)', 'count(*)', 1000)} AS rate
  FROM (SELECT churn_flag, unnest([{{'dimension': 'plan_tier', 'segment': plan_tier}},
                                   {{'dimension': 'industry', 'segment': industry}}]) AS d FROM accts)
  GROUP BY ALL)"""


def tail(statistic: str, dof: str) -> str:
    """Upper tail of chi-square: one minus the series of the lower incomplete gamma function."""
    return (
        f"(CASE WHEN {statistic} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform("
        f"range(0, 400), lambda i: exp((i + {dof} / 2.0) * ln({statistic} / 2.0) "
        f"- lgamma(i + {dof} / 2.0 + 1.0) - {statistic} / 2.0)))) END)"
    )


TESTS = CHURN + f""",
pooled AS (SELECT dimension, sum(n) AS n_all, sum(x) AS x_all, count(*) AS k FROM churn GROUP BY 1),
cells AS (
  SELECT c.dimension, k, x AS seen, n * (x_all / n_all) AS expected, x_all, n_all
  FROM churn c JOIN pooled p USING (dimension)
  UNION ALL
  SELECT c.dimension, k, n - x, n * (1 - x_all / n_all), x_all, n_all
  FROM churn c JOIN pooled p USING (dimension)),
chi_raw AS (
  SELECT dimension, any_value(k) AS k,
         CASE WHEN any_value(x_all) > 0 AND any_value(x_all) < any_value(n_all) THEN
           sum(pow(abs(seen - expected)
                   - CASE WHEN k = 2 THEN least(0.5, abs(seen - expected)) ELSE 0 END, 2) / expected)
         END AS stat
  FROM cells GROUP BY dimension),
chi AS (
  SELECT dimension, stat, k - 1 AS dof,
         CASE WHEN k = 1 THEN 1.0 ELSE {tail('stat', '(k - 1)')} END AS p FROM chi_raw),
hi AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension
           ORDER BY rate DESC, segment DESC NULLS LAST) AS rn FROM churn) WHERE rn = 1),
lo AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension
           ORDER BY rate, segment NULLS FIRST) AS rn FROM churn) WHERE rn = 1),
z_raw AS (
  SELECT hi.dimension, hi.segment AS seg_a, lo.segment AS seg_b, hi.rate AS rate_a, lo.rate AS rate_b,
         (hi.x / hi.n - lo.x / lo.n) / sqrt(((hi.x + lo.x) / (hi.n + lo.n))
           * (1 - (hi.x + lo.x) / (hi.n + lo.n)) * (1 / hi.n + 1 / lo.n)) AS z
  FROM hi JOIN lo USING (dimension)),
ztest AS (SELECT *, {tail('(z * z)', '1')} AS p FROM z_raw)"""

COHORT = """,
cohorts AS (
  SELECT DISTINCT account_id, CAST(date_trunc('month', first_value(start_date) OVER (
           PARTITION BY account_id ORDER BY start_date)) AS DATE) AS cohort_month FROM subs),
sizes AS (SELECT cohort_month, count(*) AS cohort_size FROM cohorts GROUP BY ALL)"""

RETENTION = PANEL + COHORT + f""",
present AS (
  SELECT cohort_month, datediff('month', cohort_month, month_start) AS months_since_signup,
         count(*) FILTER (cents <> 0) AS active
  FROM panel JOIN cohorts USING (account_id) GROUP BY ALL),
retention AS (
  SELECT cohort_month, months_since_signup, cohort_size, active, {scaled('active', 'cohort_size', 1000)} AS pct
  FROM present JOIN sizes USING (cohort_month) WHERE months_since_signup >= 0)"""

SEG_MONTHLY = """,
seg_monthly AS (
  SELECT 'plan_tier' AS dimension, plan_tier AS segment, month_start,
         count(*) AS active, CAST(sum(cents) AS HUGEINT) AS total
  FROM panel WHERE plan_tier IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'industry', industry, month_start, count(*) FILTER (cents > 0), CAST(sum(cents) AS HUGEINT)
  FROM panel GROUP BY ALL)"""

REQUESTS = """,
spans AS (
  SELECT greatest(CAST(date_trunc('year', month_start) AS DATE), (SELECT min(month_start) FROM cal))
           AS start_month, max(month_start) AS end_month FROM cal GROUP BY 1
  UNION SELECT min(month_start), max(month_start) FROM cal),
requests AS (
  SELECT dimension || '|' || coalesce(segment, '*') || '|' || start_month || '|' || end_month
           AS request_id, dimension, segment, start_month, end_month
  FROM (SELECT dimension, segment FROM churn WHERE segment IS NOT NULL
        UNION ALL SELECT 'all', NULL) CROSS JOIN spans)"""

# Monthly facts: the mean rates so far are running sums of hundredths over running counts.
_SO_FAR = "OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _mean(rate: str, over: str = "") -> str:
    return scaled(f"sum({rate}) {over}", f"10 * count({rate}) {over}", 1)


FACTS = WATERFALL + f""",
facts AS (
  SELECT *, lag(ending) OVER (ORDER BY month_start) AS prior_ending, count(*) {_SO_FAR} AS n_months,
         {_mean('gross', _SO_FAR)} AS avg_gross, {_mean('net', _SO_FAR)} AS avg_net,
         {_mean('nrr', _SO_FAR)} AS avg_nrr FROM rates),
mom AS (
  SELECT *, ending - prior_ending AS change,
         {scaled('ending - prior_ending', 'prior_ending', 10000)} AS growth FROM facts)"""

MEAN_COLUMNS = ", ".join([
    f"{shown('avg_gross', 10)} AS avg_gross_churn_pct_full_period",
    f"{shown('avg_net', 10)} AS avg_net_churn_pct_full_period",
    f"{shown('avg_nrr', 10)} AS avg_nrr_pct_full_period",
])


def _snapshot() -> str:
    def listing(dimension: str) -> str:
        return (
            "(SELECT string_agg(coalesce(segment, '-') || ':' || n || ':' || CAST(x AS BIGINT) || ':' || "
            f"{shown('rate', 10)}, ';' ORDER BY rate DESC, segment NULLS FIRST) FROM churn "
            f"WHERE dimension = '{dimension}')"
        )

    return f"""WITH {FACTS}{TESTS}
SELECT month_start AS latest_month, {money('ending', 'ending_mrr')},
  {money('prior_ending', 'prior_month_ending_mrr')}, {money('change', 'mrr_change_dollars')},
  {shown('growth', 100)} AS mom_mrr_growth_pct, {money('new', 'new_mrr')},
  {money('exp', 'expansion_mrr')}, {money('contr', 'contraction_mrr')},
  {money('churned', 'churned_mrr')}, {RATE_COLUMNS}, {MEAN_COLUMNS},
  {listing('plan_tier')} AS plan_tier_churn, {listing('industry')} AS industry_churn,
  round(c.stat, 3) AS chi2, CAST(c.dof AS BIGINT) AS dof, round(c.p, 4) AS chi2_p_value,
  c.p < 0.05 AS chi2_significant, z.seg_a AS segment_a, z.seg_b AS segment_b,
  {shown('z.rate_a', 10)} AS churn_pct_a, {shown('z.rate_b', 10)} AS churn_pct_b,
  round(z.z, 3) AS z, round(z.p, 4) AS z_p_value, z.p < 0.05 AS z_significant
FROM mom, chi c, ztest z WHERE c.dimension = 'plan_tier' AND z.dimension = 'industry'"""


def _facts_in_order() -> dict[str, str]:
    def dollars(cents: str) -> str:
        return f"coalesce('$' || format('{{:,}}', CAST({scaled(cents, '100', 1)} AS BIGINT)), 'n/a')"

    def pct(integer: str, scale: int) -> str:
        return f"coalesce(CAST({shown(integer, scale)} AS VARCHAR) || '%', 'n/a')"

    def listing(dimension: str) -> str:
        return (
            f"(SELECT string_agg(coalesce(segment, 'n/a') || ' ' || {pct('rate', 10)} || ' (' || "
            "CAST(x AS BIGINT) || ' of ' || n || ')', ', ' ORDER BY rate DESC, segment NULLS FIRST) "
            f"FROM churn WHERE dimension = '{dimension}')"
        )

    def extreme(table: str, dimension: str) -> str:
        return (
            f"(SELECT coalesce(segment, 'n/a') || ' at ' || {pct('rate', 10)} FROM {table} "
            f"WHERE dimension = '{dimension}')"
        )

    verdict = (
        "'p = ' || CAST(round(p, 4) AS VARCHAR) || CASE WHEN p < 0.05 THEN "
        "' (statistically significant)' ELSE ' (NOT statistically significant)' END"
    )
    lines = {
        "latest_month": "'Latest month: ' || month_start",
        "ending_mrr": f"'Ending MRR: ' || {dollars('ending')}",
        "prior_ending_mrr": f"'Prior month ending MRR: ' || {dollars('prior_ending')}",
        "mrr_change": f"'Dollar change vs prior month: ' || {dollars('change')}",
        "mom_growth": f"'Month-over-month MRR growth: ' || {pct('growth', 100)}",
        "movements": (
            f"'New MRR: ' || {dollars('new')} || ', Expansion: ' || {dollars('exp')} || "
            f"', Contraction: ' || {dollars('contr')} || ', Churned: ' || {dollars('churned')}"
        ),
        "gross_churn": f"'Gross MRR churn rate: ' || {pct('gross', 100)}",
        "net_churn": f"'Net MRR churn rate: ' || {pct('net', 100)}",
        "nrr": f"'NRR: ' || {pct('nrr', 100)}",
        "period_average": (
            f"'Full ' || n_months || '-month average: gross churn ' || {pct('avg_gross', 10)} || "
            f"', net churn ' || {pct('avg_net', 10)} || ', NRR ' || {pct('avg_nrr', 10)}"
        ),
        "tier_churn": f"'Churn by plan tier: ' || {listing('plan_tier')}",
        "tier_highest": f"'Highest-churn plan tier: ' || {extreme('hi', 'plan_tier')}",
        "tier_lowest": f"'Lowest-churn plan tier: ' || {extreme('lo', 'plan_tier')}",
        "tier_test": (
            f"(SELECT 'Plan tier chi-square test: ' || {verdict} || CASE WHEN p < 0.05 THEN "
            "'; the tiers differ' ELSE '; the tiers are essentially tied' END "
            "FROM chi WHERE dimension = 'plan_tier')"
        ),
        "industry_churn": f"'Churn by industry: ' || {listing('industry')}",
        "industry_highest": f"'Highest-churn industry: ' || {extreme('hi', 'industry')}",
        "industry_lowest": f"'Lowest-churn industry: ' || {extreme('lo', 'industry')}",
        "industry_test": (
            f"(SELECT seg_a || ' vs ' || seg_b || ' two-proportion z-test: ' || {verdict} "
            "FROM ztest WHERE dimension = 'industry')"
        ),
    }
    return lines


def _fact_sheet() -> str:
    parts = [f"SELECT month_start AS source_month, '{k}' AS fact_id, {v} AS fact FROM mom"
             for k, v in _facts_in_order().items()]
    return f"WITH {FACTS}{TESTS}\n" + "\nUNION ALL\n".join(parts)


def _summaries() -> str:
    lines = _facts_in_order()
    return f"""WITH {FACTS}{TESTS} SELECT month_start AS source_month, 'revspan' AS generator, true AS is_dated,
        {len(lines)} AS n_lines, '{",".join(lines)}' AS fact_ids,
        concat_ws(chr(10), {", ".join(f"coalesce({line}, '')" for line in lines.values())}) AS summary FROM mom"""


def _kpi_tail(start: str, end: str) -> str:
    growth = f"CASE WHEN {start} >= 200000 THEN {scaled(f'{end} - {start}', start, 1000000)} END"
    label = f"CASE WHEN {start} >= 200000 THEN {scaled(f'{end} - {start}', start, 1000)} END"
    return (
        f"{shown(f'({growth})', 10000)} AS growth_pct, "
        f"coalesce(format('{{:.1f}}%', {shown(f'({label})', 10)}), 'n/a (base too small)') AS growth_label"
    )


DECLARED_ACCOUNTS = """
  CAST(c_custkey AS VARCHAR) AS account_id, c_name AS account_name, c_mktsegment AS industry,
  n_name AS country, a.signup_date, CASE WHEN c_custkey % 3 = 0 THEN 'partner' ELSE 'organic' END
  AS referral_source, a.plan_tier, c_custkey % 100 + 1 AS seats, c_custkey % 10 = 0 AS is_trial,
  a.churn_flag"""

ORACLES: dict[str, str] = {
    "subscription_timeline": f"""WITH {SUBS}{TIMELINE}
        SELECT subscription_id, account_id, start_date, end_date, plan_tier,
               {money('cents', 'mrr_amount')}, upgrade_flag, downgrade_flag,
               coalesce(end_date >= start_date, false) AS churn_flag, next_start_date, effective_end_date
        FROM timeline""",
    "calendar_months": f"WITH {SUBS}{CAL} SELECT month_start, month_end FROM cal",
    "account_month_panel": f"""WITH {PANEL} SELECT month_start, account_id,
        {money('cents', 'mrr')}, plan_tier, industry FROM panel""",
    "account_movements": f"""WITH {MOVES} SELECT month_start, account_id,
        {money('cur', 'current_mrr')}, {money('prior', 'prior_mrr')},
        {money('delta', 'mrr_delta')}, kind AS movement_type FROM moves""",
    "sql_over_views": f"""WITH {MOVES} SELECT month_start, month_end, kind AS movement_type,
        count(*) AS n_accounts, {money('sum(delta)', 'moved')}
        FROM moves JOIN cal USING (month_start) WHERE kind <> 'unchanged' GROUP BY 1, 2, 3""",
    "mrr_waterfall": f"WITH {WATERFALL} SELECT month_start, {WATERFALL_COLUMNS} FROM wf",
    "gross_net_churn_nrr": f"""WITH {WATERFALL} SELECT month_start, {money('starting', 'starting_mrr')},
        {money('exp', 'expansion_mrr')}, {money('contr', 'contraction_mrr')},
        {money('churned', 'churned_mrr')}, {RATE_COLUMNS} FROM rates""",
    "cohort_assignment": f"WITH {SUBS}{COHORT} SELECT account_id, cohort_month FROM cohorts",
    "cohort_sizes": f"WITH {SUBS}{COHORT} SELECT cohort_month, cohort_size FROM sizes",
    "cohort_retention": f"""WITH {RETENTION} SELECT cohort_month, months_since_signup, cohort_size,
        active AS active_accounts, {shown('pct', 10)} AS retention_pct FROM retention""",
    "logo_churn_by_tier": f"""WITH {ACCTS}{CHURN} SELECT segment AS plan_tier, n AS n_accounts,
        {big('x', 'n_churned')}, {shown('rate', 10)} AS churn_rate_pct
        FROM churn WHERE dimension = 'plan_tier'""",
    "logo_churn_by_industry": f"""WITH {ACCTS}{CHURN} SELECT segment AS industry, n AS n_accounts,
        {big('x', 'n_churned')}, {shown('rate', 10)} AS churn_rate_pct
        FROM churn WHERE dimension = 'industry'""",
    "monthly_mrr_by_tier": f"""WITH {PANEL} SELECT month_start, plan_tier,
        count(*) AS active_accounts, {money('sum(cents)', 'total_mrr')},
        {shown(scaled('CAST(sum(cents) AS HUGEINT)', 'count(*)', 1), 100)} AS avg_mrr_per_account
        FROM panel WHERE plan_tier IS NOT NULL GROUP BY 1, 2""",
    "monthly_mrr_by_industry": f"""WITH {PANEL} SELECT month_start, industry,
        count(*) FILTER (cents > 0) AS active_accounts, {money('sum(cents)', 'total_mrr')},
        {shown(scaled('CAST(sum(cents) FILTER (cents > 0) AS HUGEINT)',
                      'count(*) FILTER (cents > 0)', 1), 100)} AS avg_mrr_per_account
        FROM panel GROUP BY 1, 2""",
    "segment_contingency": f"""WITH {ACCTS}{CHURN} SELECT dimension, segment,
        {big('x', 'n_churned')}, {big('n - x', 'n_not_churned')} FROM churn""",
    "chi_square_segments": f"""WITH {ACCTS}{TESTS} SELECT dimension, round(stat, 3) AS chi2,
        {big('dof', 'dof')}, round(p, 4) AS p_value, p < 0.05 AS significant FROM chi""",
    "z_test_segments": f"""WITH {ACCTS}{TESTS} SELECT dimension, seg_a AS segment_a,
        seg_b AS segment_b, {shown('rate_a', 10)} AS churn_pct_a, {shown('rate_b', 10)} AS churn_pct_b,
        round(z, 3) AS z, round(p, 4) AS p_value, p < 0.05 AS significant FROM ztest""",
    "segment_extremes": f"""WITH {ACCTS}{TESTS} SELECT dimension, hi.segment AS highest_segment,
        {shown('hi.rate', 10)} AS highest_rate_pct, lo.segment AS lowest_segment,
        {shown('lo.rate', 10)} AS lowest_rate_pct FROM hi JOIN lo USING (dimension)""",
    "mom_change": f"""WITH {FACTS} SELECT month_start, {money('ending', 'ending_mrr')},
        {money('prior_ending', 'prior_month_ending_mrr')}, {money('change', 'mrr_change_dollars')},
        {shown('growth', 100)} AS mom_mrr_growth_pct FROM mom""",
    "latest_month_facts": f"""WITH {FACTS} SELECT month_start, {WATERFALL_COLUMNS}, {RATE_COLUMNS},
        {MEAN_COLUMNS}, {money('prior_ending', 'prior_month_ending_mrr')}, n_months,
        {money('change', 'mrr_change_dollars')}, {shown('growth', 100)} AS mom_mrr_growth_pct
        FROM mom ORDER BY month_start DESC LIMIT 1""",
    "period_mean_rates": f"""WITH {WATERFALL}, m AS (SELECT {_mean('gross')} AS avg_gross,
        {_mean('net')} AS avg_net, {_mean('nrr')} AS avg_nrr FROM rates)
        SELECT {MEAN_COLUMNS} FROM m""",
    "metrics_snapshot": _snapshot(),
    "snapshot_json_roundtrip": _snapshot(),
    "fact_sheet": _fact_sheet(),
    "fact_provenance": f"""WITH {SUBS}{CAL} SELECT month_start AS source_month,
        'revspan' AS generator, CAST(18 AS BIGINT) AS n_facts, true AS is_dated FROM cal""",
    "month_domain": f"WITH {SUBS}{CAL} SELECT strftime(month_start, '%Y-%m') AS month FROM cal",
    "segment_domain": f"""WITH {ACCTS}{CHURN} SELECT dimension, segment FROM churn
        WHERE segment IS NOT NULL""",
    "explorer_requests": f"WITH {ACCTS}{CAL}{CHURN}{REQUESTS} SELECT * FROM requests",
    "waterfall_in_range": f"""WITH {WATERFALL} SELECT month_start, {WATERFALL_COLUMNS} FROM wf
        WHERE month_start BETWEEN DATE '1997-03-01' AND DATE '1998-06-01'""",
    "segment_in_range": f"""WITH {PANEL} SELECT month_start, industry,
        count(*) FILTER (cents > 0) AS active_accounts, {money('sum(cents)', 'total_mrr')},
        {shown(scaled('CAST(sum(cents) FILTER (cents > 0) AS HUGEINT)',
                      'count(*) FILTER (cents > 0)', 1), 100)} AS avg_mrr_per_account
        FROM panel WHERE industry = 'BUILDING'
          AND month_start BETWEEN DATE '1997-03-01' AND DATE '1998-06-01' GROUP BY 1, 2""",
    "measurable_rates": f"""WITH {WATERFALL} SELECT month_start, {money('starting', 'starting_mrr')},
        {money('exp', 'expansion_mrr')}, {money('contr', 'contraction_mrr')},
        {money('churned', 'churned_mrr')}, {RATE_COLUMNS} FROM rates WHERE gross IS NOT NULL""",
    "range_kpis_all": f"""WITH {WATERFALL}{CHURN}{REQUESTS}, k AS (
          SELECT request_id, start_month, end_month, max_by(ending, month_start) AS e,
                 min_by(starting, month_start) AS s, {_mean('gross')} AS g, {_mean('net')} AS n
          FROM requests JOIN rates ON month_start BETWEEN start_month AND end_month
          WHERE dimension = 'all' GROUP BY 1, 2, 3)
        SELECT request_id, start_month, end_month, {money('e', 'ending_mrr')},
               {money('s', 'range_start_mrr')}, {shown('g', 10)} AS avg_gross_churn_pct,
               {shown('n', 10)} AS avg_net_churn_pct, {_kpi_tail('s', 'e')} FROM k""",
    "range_kpis_segment": f"""WITH {WATERFALL}{CHURN}{SEG_MONTHLY}{REQUESTS}, m AS (
          SELECT request_id, {_mean('nrr')} AS nrr FROM requests
          JOIN rates ON month_start BETWEEN start_month AND end_month GROUP BY 1),
        k AS (
          SELECT r.request_id, r.dimension, r.segment, start_month, end_month,
                 coalesce(max_by(total, month_start), 0) AS e,
                 coalesce(min_by(total, month_start), 0) AS s
          FROM requests r LEFT JOIN seg_monthly g ON g.dimension = r.dimension
               AND g.segment = r.segment AND month_start BETWEEN start_month AND end_month
          WHERE r.dimension <> 'all' GROUP BY ALL)
        SELECT k.request_id, k.dimension, k.segment, start_month, end_month,
               {money('e', 'ending_mrr')}, {money('s', 'range_start_mrr')},
               {shown('m.nrr', 10)} AS business_avg_nrr_pct, {shown('c.rate', 10)} AS logo_churn_pct,
               {_kpi_tail('s', 'e')}
        FROM k JOIN m USING (request_id)
        LEFT JOIN churn c ON c.dimension = k.dimension AND c.segment = k.segment""",
    "trend_series": f"""WITH {WATERFALL}{CHURN}{SEG_MONTHLY}{REQUESTS}
        SELECT request_id, dimension, segment, month_start, {money('ending', 'mrr')},
               CAST(NULL AS BIGINT) AS active_accounts
        FROM requests JOIN wf ON month_start BETWEEN start_month AND end_month
        WHERE dimension = 'all'
        UNION ALL
        SELECT request_id, r.dimension, r.segment, month_start, {money('total', 'mrr')}, active
        FROM requests r JOIN seg_monthly g ON g.dimension = r.dimension AND g.segment = r.segment
             AND month_start BETWEEN start_month AND end_month""",
    "waterfall_long": f"""WITH {WATERFALL}
        SELECT month_start, 'new_mrr' AS movement_type, {money('new', 'amount')} FROM wf
        UNION ALL SELECT month_start, 'expansion_mrr', {money('exp', 'amount')} FROM wf
        UNION ALL SELECT month_start, 'contraction_mrr', {money('contr', 'amount')} FROM wf
        UNION ALL SELECT month_start, 'churned_mrr', {money('churned', 'amount')} FROM wf""",
    "rates_long": f"""WITH {WATERFALL}
        SELECT month_start, 'gross_mrr_churn_rate_pct' AS metric, {shown('gross', 100)} AS pct
        FROM rates WHERE gross IS NOT NULL
        UNION ALL SELECT month_start, 'net_mrr_churn_rate_pct', {shown('net', 100)}
        FROM rates WHERE gross IS NOT NULL""",
    "waterfall_stack": f"""WITH {WATERFALL} SELECT month_start, {money('new', 'new_mrr')},
        {money('exp', 'expansion_mrr')}, {money('new', 'expansion_bottom')},
        {money('contr', 'contraction_mrr')}, {money('churned', 'churned_mrr')},
        {money('contr', 'churned_bottom')}, {money('ending', 'ending_mrr')} FROM wf""",
    "cohort_heatmap": f"""WITH {RETENTION} SELECT strftime(cohort_month, '%Y-%m') AS cohort, """
    + ", ".join(
        f"max(CASE WHEN months_since_signup = {i} THEN {shown('pct', 10)} END) AS m{i}"
        for i in range(80)
    ) + " FROM retention GROUP BY 1",
    "segment_churn_series": f"""WITH {ACCTS}{CHURN} SELECT segment, n AS n_accounts,
        {big('x', 'n_churned')}, {shown('rate', 10)} AS churn_rate_pct,
        row_number() OVER (ORDER BY rate DESC, segment NULLS LAST) AS position
        FROM churn WHERE dimension = 'industry'""",
    "segment_comparison": f"""WITH {ACCTS}{CHURN} SELECT dimension, segment, n AS n_accounts,
        {big('x', 'n_churned')}, {shown('rate', 10)} AS churn_rate_pct,
        row_number() OVER (PARTITION BY dimension ORDER BY rate DESC, segment NULLS LAST) AS position
        FROM churn""",
    "duplicate_keys": " UNION ALL ".join(
        f"""SELECT 'feature_usage' AS table_name, '{name}' AS key_column,
            CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
            count(*) FILTER (n > 1) AS n_reused_keys,
            CAST(sum(n) - count(*) AS BIGINT) AS n_rows_reusing_a_key
            FROM (SELECT {col}, count(*) AS n FROM events GROUP BY 1)"""
        for name, col in (("usage_id", "event_id"), ("subscription_id", "user_id"))
    ),
    "reused_keys": """SELECT user_id AS subscription_id, count(*) AS n_rows FROM events
        GROUP BY 1 HAVING count(*) > 1""",
    "overlap_rate": f"""WITH {SUBS}{TIMELINE} SELECT count(*) AS n_pairs,
        count(*) FILTER (end_date >= next_start_date) AS n_overlapping FROM timeline
        WHERE end_date IS NOT NULL AND next_start_date IS NOT NULL""",
    "signup_gap": f"""WITH {ACCTS}, g AS (SELECT f.start_date - signup_date AS gap
          FROM accts JOIN first_sub f USING (account_id))
        SELECT count(*) AS n_accounts, count(*) FILTER (gap > 0) AS n_with_gap,
               {shown(scaled('CAST(sum(gap) AS HUGEINT)', 'count(*)', 10), 10)} AS avg_gap_days,
               {big('max(gap)', 'max_gap_days')} FROM g""",
    "orphans": """
        SELECT 'subscriptions.account_id' AS reference, count(*) AS n_orphan_rows,
               count(DISTINCT o_custkey) AS n_orphan_keys
        FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'support_tickets.account_id', count(*), count(DISTINCT user_id)
        FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'churn_events.account_id', count(*), count(DISTINCT o_custkey)
        FROM orders WHERE o_orderstatus = 'F'
          AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
          AND o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'feature_usage.subscription_id', count(*), count(DISTINCT user_id)
        FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders)""",
    "constraints": f"""WITH {ACCTS}
        SELECT 'accounts' AS table_name, count(*) AS n_rows, 'account_id' AS column_name,
               count(*) - count(account_id) AS n_nulls,
               count(account_id) - count(DISTINCT account_id) AS n_duplicates FROM accts
        UNION ALL SELECT 'accounts', count(*), 'account_name', count(*) - count(account_name), NULL
        FROM accts
        UNION ALL SELECT 'accounts', count(*), 'signup_date', count(*) - count(signup_date), NULL
        FROM accts
        UNION ALL SELECT 'subscriptions', count(*), 'subscription_id',
               count(*) - count(subscription_id),
               count(subscription_id) - count(DISTINCT subscription_id) FROM subs
        UNION ALL SELECT 'subscriptions', count(*), 'account_id', count(*) - count(account_id), NULL
        FROM subs
        UNION ALL SELECT 'subscriptions', count(*), 'start_date', count(*) - count(start_date), NULL
        FROM subs
        UNION ALL SELECT 'support_tickets', count(*), 'ticket_id', count(*) - count(event_id),
               count(event_id) - count(DISTINCT event_id) FROM events
        UNION ALL SELECT 'support_tickets', count(*), 'account_id', count(*) - count(user_id), NULL
        FROM events
        UNION ALL SELECT 'support_tickets', count(*), 'submitted_at', count(*) - count(ts), NULL
        FROM events
        UNION ALL SELECT 'feature_usage', count(*), 'usage_pk', 0, 0 FROM events
        UNION ALL SELECT 'feature_usage', count(*), 'usage_id', count(*) - count(event_id), NULL
        FROM events
        UNION ALL SELECT 'feature_usage', count(*), 'subscription_id', count(*) - count(user_id), NULL
        FROM events
        UNION ALL SELECT 'feature_usage', count(*), 'usage_date', count(*) - count(ts), NULL
        FROM events
        UNION ALL SELECT 'churn_events', count(*), 'churn_event_id', count(*) - count(subscription_id),
               count(subscription_id) - count(DISTINCT subscription_id)
        FROM subs WHERE end_date IS NOT NULL
        UNION ALL SELECT 'churn_events', count(*), 'account_id', count(*) - count(account_id), NULL
        FROM subs WHERE end_date IS NOT NULL
        UNION ALL SELECT 'churn_events', count(*), 'churn_date', 0, NULL
        FROM subs WHERE end_date IS NOT NULL""",
    "coverage": f"""WITH {ACCTS}
        SELECT 'accounts' AS table_name, count(*) AS n_rows, min(signup_date) AS first_day,
               max(signup_date) AS last_day FROM accts
        UNION ALL SELECT 'subscriptions', count(*), min(start_date), max(start_date) FROM subs
        UNION ALL SELECT 'feature_usage', count(*), min(CAST(ts AS DATE)), max(CAST(ts AS DATE))
        FROM events
        UNION ALL SELECT 'support_tickets', count(*), min(CAST(ts AS DATE)), max(CAST(ts AS DATE))
        FROM events
        UNION ALL SELECT 'churn_events', count(*), min(end_date), max(end_date) FROM subs
        WHERE end_date IS NOT NULL""",
    "identity_breaks": f"""WITH {WATERFALL} SELECT count(*) AS n_months,
        count(*) FILTER (starting + new + exp + contr + churned <> ending) AS n_breaks FROM wf""",
    "continuity_breaks": f"""WITH {WATERFALL}, p AS (
          SELECT ending, lead(starting) OVER (ORDER BY month_start) AS next_start FROM wf)
        SELECT count(*) AS n_pairs, count(*) FILTER (ending <> next_start) AS n_breaks
        FROM p WHERE next_start IS NOT NULL""",
    "nrr_breaks": f"""WITH {WATERFALL} SELECT count(*) AS n_months,
        count(*) FILTER (abs(nrr + net - 10000) > 1) AS n_breaks FROM rates WHERE nrr IS NOT NULL""",
    "panel_uniqueness": f"""WITH {PANEL} SELECT count(*) AS n_active_cells,
        max(n_matches) AS max_matches, count(*) FILTER (n_matches > 1) AS n_violations
        FROM panel WHERE n_matches > 0""",
    "panel_completeness": f"""WITH {PANEL}, s AS (SELECT (SELECT count(*) FROM panel) AS n_rows,
          (SELECT count(*) FROM customer) AS n_accounts, (SELECT count(*) FROM cal) AS n_months)
        SELECT *, n_rows = n_accounts * n_months AS is_complete FROM s""",
    "churn_reconciliation": f"""WITH {ACCTS}, per AS (
          SELECT account_id, bool_or(coalesce(end_date >= start_date, false)) AS s,
                 bool_or(end_date IS NOT NULL) AS e FROM subs GROUP BY 1)
        SELECT coalesce(churn_flag, false) AS account_flag, coalesce(s, false) AS subscription_flag,
               coalesce(e, false) AS event_flag, count(*) AS n_accounts
        FROM accts FULL JOIN per USING (account_id) GROUP BY 1, 2, 3""",
    "segment_tieout": f"""WITH {WATERFALL}{SEG_MONTHLY}, d AS (
          SELECT DISTINCT dimension FROM seg_monthly),
        t AS (SELECT dimension, month_start, sum(total) AS total FROM seg_monthly GROUP BY 1, 2)
        SELECT d.dimension, count(*) AS n_months,
               count(*) FILTER (coalesce(t.total, 0) <> wf.ending) AS n_breaks
        FROM d CROSS JOIN wf LEFT JOIN t ON t.dimension = d.dimension
             AND t.month_start = wf.month_start GROUP BY 1""",
    "csv_accounts": f"""WITH {ACCTS} SELECT {DECLARED_ACCOUNTS}
        FROM customer JOIN accts a ON a.account_id = c_custkey
        LEFT JOIN nation ON n_nationkey = customer.c_nationkey""",
    "csv_subscriptions": f"""WITH {SUBS} SELECT CAST(subscription_id AS VARCHAR) AS subscription_id,
        CAST(account_id AS VARCHAR) AS account_id, start_date, end_date, plan_tier,
        subscription_id % 50 + 1 AS seats, {money('cents', 'mrr_amount')},
        {money('cents * 12', 'arr_amount')}, is_trial, plan_tier = '1-URGENT' AS upgrade_flag,
        plan_tier = '5-LOW' AS downgrade_flag, coalesce(end_date >= start_date, false) AS churn_flag,
        CASE WHEN subscription_id % 3 = 0 THEN 'annual' ELSE 'monthly' END AS billing_frequency,
        subscription_id % 2 = 0 AS auto_renew_flag FROM subs""",
    "csv_feature_usage": """SELECT CAST(event_id AS VARCHAR) AS usage_id,
        CAST(user_id AS VARCHAR) AS subscription_id, CAST(ts AS DATE) AS usage_date,
        event_type AS feature_name, event_id % 5 + 1 AS usage_count,
        CAST(floor(value) AS BIGINT) AS usage_duration_secs,
        CAST(event_type = 'error' AS BIGINT) AS error_count, event_id % 7 = 0 AS is_beta_feature
        FROM events""",
    "usage_surrogate_key": """SELECT count(*) AS n_rows, count(*) AS n_distinct_keys,
        CAST(0 AS BIGINT) AS n_null_keys FROM events""",
    "csv_support_tickets": """SELECT CAST(event_id AS VARCHAR) AS ticket_id,
        CAST(user_id AS VARCHAR) AS account_id, date_trunc('second', ts) AS submitted_at,
        CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts)
             + to_minutes(CAST(floor(value) AS BIGINT)) END AS closed_at,
        CASE WHEN event_id % 4 <> 0 THEN CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) END
        AS resolution_time_hours, event_type AS priority,
        CAST(floor(value) AS BIGINT) AS first_response_time_minutes,
        CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 6 AS DOUBLE) END AS satisfaction_score,
        event_type = 'error' AS escalation_flag FROM events""",
    "csv_churn_events": f"""WITH {SUBS} SELECT CAST(subscription_id AS VARCHAR) AS churn_event_id,
        CAST(account_id AS VARCHAR) AS account_id, end_date AS churn_date, plan_tier AS reason_code,
        {money('cents', 'refund_amount_usd')}, plan_tier = '1-URGENT' AS preceding_upgrade_flag,
        plan_tier = '5-LOW' AS preceding_downgrade_flag, false AS is_reactivation,
        'left "' || plan_tier || '",' || chr(10) || 'with regret' AS feedback_text
        FROM subs WHERE end_date IS NOT NULL""",
}
ORACLES["mrr_waterfall_from_movements"] = ORACLES["mrr_waterfall"]
ORACLES["metric_csv_roundtrip"] = ORACLES["mrr_waterfall"]
ORACLES["metric_exports"] = " UNION ALL ".join(
    f"""SELECT '{metric}' AS metric, count(*) AS n_rows, count({measure}) AS n_measured,
        CAST(sum(CAST({measure} AS DECIMAL(38,2))) AS DOUBLE) AS total FROM ({ORACLES[query]})"""
    for metric, query, measure in (
        ("mrr_waterfall", "mrr_waterfall", "ending_mrr"),
        ("gross_net_churn_and_nrr", "gross_net_churn_nrr", "nrr_pct"),
        ("cohort_retention", "cohort_retention", "retention_pct"),
        ("segment_plan_tier_churn", "logo_churn_by_tier", "churn_rate_pct"),
        ("segment_monthly_mrr", "monthly_mrr_by_tier", "avg_mrr_per_account"),
        ("segment_industry_churn", "logo_churn_by_industry", "churn_rate_pct"),
        ("segment_monthly_industry_mrr", "monthly_mrr_by_industry", "avg_mrr_per_account"),
    )
)
ORACLES["sql_metrics"] = ORACLES["metric_exports"]
ORACLES["sql_metric_in_range"] = ORACLES["waterfall_in_range"]


def _as_loaded(sql: str, until: str = "9999-01-01") -> str:
    """The same over the subscriptions that started before a day, with ids as text, as the CSV files hold them."""
    return sql.replace("SELECT o_orderkey AS subscription_id", "SELECT CAST(o_orderkey AS VARCHAR) AS subscription_id", 1).replace(
        "ON l_orderkey = o_orderkey)", f"ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '{until}')", 1)


ORACLES["refresh_versions"] = " UNION ALL ".join(
    f"""SELECT CAST({version} AS BIGINT) AS version, 'accounts' AS table_name, count(*) AS n_rows, 0.0 AS total FROM customer
        UNION ALL SELECT {version}, 'subscriptions', * FROM (
          {_as_loaded(f"WITH {SUBS} SELECT count(*), {shown('CAST(sum(cents) AS HUGEINT)', 100)} FROM subs", until)})
        UNION ALL SELECT {version}, 'mrr_waterfall', * FROM (
          {_as_loaded(f"WITH {WATERFALL} SELECT count(*), {shown('CAST(sum(ending) AS HUGEINT)', 100)} FROM wf", until)})"""
    for version, until in ((1, "1997-01-01"), (2, "9999-01-01"))
)
ORACLES["summary_documents"] = _summaries()
ORACLES["usage_dense_key"] = """SELECT row_number() OVER (ORDER BY CAST(ts AS DATE), CAST(user_id AS VARCHAR),
    CAST(event_id AS VARCHAR)) AS usage_pk, CAST(ts AS DATE) AS usage_date, CAST(user_id AS VARCHAR) AS subscription_id,
    CAST(event_id AS VARCHAR) AS usage_id FROM events"""
ORACLES["range_kpis_from_store"] = f"""SELECT * FROM ({ORACLES["range_kpis_segment"]})
    WHERE start_month = DATE '1997-01-01' AND end_month = DATE '1997-12-01'"""
# An account has paid before when the running maximum of its earlier month-end revenue is positive.
ORACLES["new_mrr_split"] = f"""WITH {MOVES}, seen AS (
      SELECT *, coalesce(max(cur) OVER (PARTITION BY account_id ORDER BY month_start
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS paid_before FROM moves),
    split AS (
      SELECT month_start, {_flow('new')} AS new,
             CAST(coalesce(sum(delta) FILTER (kind = 'new' AND NOT paid_before), 0) AS HUGEINT) AS first_time,
             CAST(coalesce(sum(delta) FILTER (kind = 'new' AND paid_before), 0) AS HUGEINT) AS again,
             count(*) FILTER (kind = 'new' AND NOT paid_before) AS n_first,
             count(*) FILTER (kind = 'new' AND paid_before) AS n_returning FROM seen GROUP BY month_start)
    SELECT month_start, {money('new', 'new_mrr')}, {money('first_time', 'first_mrr')}, {money('again', 'returning_mrr')},
           n_first, n_returning FROM split"""


def _one_pass() -> str:
    def row(audit: str, subject: str, checked: str, breaks: str, days: str = "NULL, NULL", source: str = "") -> str:
        return (f"SELECT '{audit}' AS audit, '{subject}' AS subject, CAST({checked} AS BIGINT) AS n_checked, "
                f"CAST({breaks} AS BIGINT) AS n_breaks, {days} {source}")

    parts = [
        row("coverage", "accounts", "count(*)", "NULL", "min(signup_date) AS first_day, max(signup_date) AS last_day", "FROM accts"),
        row("coverage", "subscriptions", "count(*)", "NULL", "min(start_date), max(start_date)", "FROM subs"),
        *[row("not_null", f"{name}.{c}", "count(*)", f"count(*) - count({c})", source=f"FROM {table}")
          for name, table, columns in (("accounts", "accts", ("account_id", "signup_date")),
                                       ("subscriptions", "subs", ("subscription_id", "account_id", "start_date")))
          for c in columns],
        row("completeness", "account_month_mrr", "(SELECT count(*) FROM panel)",
            "(SELECT count(*) FROM accts) * (SELECT count(*) FROM cal) - (SELECT count(*) FROM panel)"),
        *[row(audit, "mrr_waterfall", checked, "n_breaks", source=f"FROM ({ORACLES[query]})")
          for audit, query, checked in (("identity", "identity_breaks", "n_months"), ("continuity", "continuity_breaks", "n_pairs"),
                                        ("nrr", "nrr_breaks", "n_months"))],
    ]
    return f"WITH {PANEL}\n" + "\nUNION ALL\n".join(parts)


ORACLES["audits_in_one_pass"] = _one_pass()
