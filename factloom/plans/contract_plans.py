"""Queries for formula contracts, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..sources import fixtures as fx
from .shapes import FACTS, FORMULA_CASES

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def first_sql(*words: str) -> str:
    return "list_filter(m, lambda x: " + " OR ".join(f"contains(x, '{w}')" for w in words) + ")[1]"


REVENUE = first_sql("revenue", "net_sales")
ROLES_SQL = f"""{FACTS}, {FORMULA_CASES}, names AS (SELECT case_id, list_sort(list(DISTINCT metric)) AS m FROM formula_facts GROUP BY case_id),
  asked AS (SELECT case_id, q, a, coalesce(m, []) AS m FROM formula_cases LEFT JOIN names USING (case_id)),
  typed AS (SELECT *, CASE WHEN contains(q, 'tax rate') OR contains(q, 'effective tax') THEN 'tax_rate_ratio' WHEN contains(q, 'inventory turnover') THEN 'inventory_turnover'
    WHEN contains(a, 'current ratio') OR contains(q, 'liquidity') THEN 'current_ratio' WHEN contains(q, 'gross margin') OR contains(q, 'gpm') THEN 'gross_margin'
    WHEN contains(q, 'operating margin') OR (contains(q, 'margin') AND {first_sql('operating_income')} IS NOT NULL) THEN 'operating_margin' WHEN contains(q, 'sg&a') THEN 'cost_sga_ratio'
    WHEN contains(q, 'growth') AND {REVENUE} IS NOT NULL THEN 'revenue_growth' WHEN contains(q, 'eps') OR contains(q, 'per share') THEN 'eps_reconciliation' ELSE 'ambiguous_manual_review' END AS t FROM asked),
  roles AS (SELECT case_id, t AS formula_type,
    CASE t WHEN 'tax_rate_ratio' THEN coalesce(list_filter(m, lambda x: contains(x, 'income_tax') AND x <> coalesce({first_sql('before_income_taxes')}, ''))[1], {first_sql('income_tax')}, 'income_tax_provision') WHEN 'inventory_turnover' THEN coalesce({first_sql('cost_of_sales')}, 'cost_of_sales')
      WHEN 'current_ratio' THEN coalesce({first_sql('current_assets')}, 'current_assets') WHEN 'gross_margin' THEN coalesce({first_sql('gross_profit')}, 'gross_profit') WHEN 'operating_margin' THEN coalesce({first_sql('operating_income')}, 'operating_income')
      WHEN 'cost_sga_ratio' THEN coalesce({first_sql('cost_of_sales')}, 'cost_of_sales') WHEN 'revenue_growth' THEN coalesce({REVENUE}, 'revenue') WHEN 'eps_reconciliation' THEN coalesce({first_sql('net_income')}, 'net_income') ELSE '' END AS numerator,
    CASE t WHEN 'tax_rate_ratio' THEN coalesce({first_sql('before_income_taxes')}, 'earnings_before_income_taxes') WHEN 'inventory_turnover' THEN coalesce({first_sql('inventories', 'inventory')}, 'inventories')
      WHEN 'current_ratio' THEN coalesce({first_sql('current_liabilities')}, 'current_liabilities') WHEN 'gross_margin' THEN coalesce({REVENUE}, 'revenue') WHEN 'operating_margin' THEN coalesce({REVENUE}, 'revenue')
      WHEN 'cost_sga_ratio' THEN coalesce({first_sql('selling_general_and_administrative')}, 'selling_general_and_administrative_expenses') WHEN 'revenue_growth' THEN 'prior_period_revenue'
      WHEN 'eps_reconciliation' THEN coalesce({first_sql('weighted_average', 'shares')}, 'weighted_average_shares') ELSE '' END AS denominator FROM typed)"""


@query("fc1_roles_of_questions", f"WITH {ROLES_SQL} SELECT *, formula_type = 'ambiguous_manual_review' AS ambiguous FROM roles")
def _(spark, d):
    r = contracts.resolve(fx.formula_cases(spark, d), fx.formula_facts(spark, d))
    return r.select("case_id", "formula_type", "numerator", "denominator", "ambiguous")


def six(x: str) -> str:
    return f"sign({x}) * floor(abs({x}) * 1000000 + 0.5) / 1000000.0::DOUBLE"


def value_sql(role: str) -> str:
    return f"arg_max(value, place) FILTER (contains(metric, {role}))"


@query(
    "fc2_targets_by_formula",
    f"""WITH {ROLES_SQL}, v AS (SELECT r.case_id, formula_type AS t, f.year AS y, {value_sql('numerator')} AS n, {value_sql('denominator')} AS d FROM roles r JOIN formula_facts f USING (case_id) WHERE numerator <> '' GROUP BY ALL),
    ratio AS (SELECT case_id, t, t || '_' || y AS slot, CASE WHEN t IN ('tax_rate_ratio', 'gross_margin', 'operating_margin') THEN abs(n) / abs(d) * 100 WHEN t = 'cost_sga_ratio' THEN abs(n) / abs(d) ELSE n / d END AS x, CASE WHEN t IN ('current_ratio', 'cost_sga_ratio') THEN 'ratio' WHEN t = 'eps_reconciliation' THEN 'amount' ELSE 'percentage' END AS unit, [y] AS years FROM v WHERE t NOT IN ('inventory_turnover', 'revenue_growth') AND n IS NOT NULL AND d <> 0),
    growth AS (SELECT case_id, t, 'revenue_growth_' || y || '_vs_' || y0 AS slot, (n - n0) / abs(n0) * 100 AS x, 'percentage' AS unit, [y, y0] AS years FROM (SELECT *, lag(n) OVER w AS n0, lag(y) OVER w AS y0 FROM v WHERE t = 'revenue_growth' AND n IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY y)) WHERE n0 <> 0),
    turns AS (SELECT a.case_id, a.t, 'inventory_turnover_' || a.y AS slot, a.n / ((a.d + b.d) / 2) AS x, 'ratio' AS unit, [a.y, b.y] AS years FROM v a JOIN v b ON b.case_id = a.case_id AND b.y = a.y - 1 WHERE a.t = 'inventory_turnover' AND a.n IS NOT NULL AND a.d + b.d <> 0 QUALIFY row_number() OVER (PARTITION BY a.case_id ORDER BY a.y DESC) = 1)
    SELECT case_id, t AS formula_type, slot, {six('x')} AS expected, unit, years FROM (SELECT * FROM ratio UNION ALL SELECT * FROM growth UNION ALL SELECT * FROM turns)""",
)
def _(spark, d):
    f = fx.formula_facts(spark, d)
    return contracts.targets(contracts.resolve(fx.formula_cases(spark, d), f), f)


@query(
    "fc2_strict_targets",
    f"""WITH {FACTS}, {FORMULA_CASES}, v AS (SELECT case_id, kind, year AS y, arg_max(value, place) FILTER (contains(metric, 'net_income')) AS net, arg_max(value, place) FILTER (contains(metric, 'diluted_earnings_per_common_share')) AS eps,
      arg_max(value, place) FILTER (contains(metric, 'total_noninterest_expense')) AS cost, arg_max(value, place) FILTER (contains(metric, 'net_interest_income')) AS nii, arg_max(value, place) FILTER (contains(metric, 'income_before_taxes')) AS ibt,
      arg_max(value, place) FILTER (contains(metric, 'total_other_income')) AS other FROM formula_facts WHERE kind >= 10 GROUP BY ALL),
    g AS (SELECT *, lag(net) OVER w AS net0, lag(eps) OVER w AS eps0, lag(y) OVER w AS y0 FROM v WINDOW w AS (PARTITION BY case_id ORDER BY y)),
    s AS (SELECT case_id, 'growth_and_eps_change' AS t, 'net_income_growth_' || y || '_vs_' || y0 AS slot, (net - net0) / abs(net0) * 100 AS x, 'percentage' AS unit, [y, y0] AS years FROM g WHERE kind = 10 AND net0 <> 0
      UNION ALL SELECT case_id, 'growth_and_eps_change', 'diluted_eps_change_' || y || '_vs_' || y0, eps - eps0, 'amount', [y, y0] FROM g WHERE kind = 10 AND y0 IS NOT NULL
      UNION ALL SELECT case_id, 'noninterest_expense_ratio', 'noninterest_expense_ratio_' || y, abs(cost) / abs(nii) * 100, 'percentage', [y] FROM g WHERE kind = 11 AND nii <> 0
      UNION ALL SELECT case_id, 'bank_operating_profit_margin', 'ibt_to_net_interest_plus_other_income_margin_' || y, ibt / (nii + other) * 100, 'percentage', [y] FROM g WHERE kind = 12 AND nii + other <> 0)
    SELECT case_id, t AS formula_type, slot, {six('x')} AS expected, unit, years FROM s""",
)
def _(spark, d):
    f = fx.formula_facts(spark, d)
    return contracts.targets(contracts.resolve_strictly(fx.formula_cases(spark, d), f), f)


PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)"


@query(
    "fc3_derivation_contracts",
    rf"""WITH o AS (SELECT o_orderkey AS k, CAST({PRICE} AS DOUBLE) AS p, {PRICE} AS price FROM orders),
    c AS (SELECT k, p, price, CASE WHEN k % 3 <> 0 THEN 'tatqa_arithmetic' ELSE 'finqa_program' END AS kind,
      CASE WHEN k % 9 = 0 THEN [5.0::DOUBLE] WHEN k % 3 = 0 THEN [p, 100, 0, p, 1, -2] WHEN k % 3 = 1 THEN [p, 1250, k, 7.5] ELSE [12.0::DOUBLE] END AS ns,
      CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN k % 100 ELSE p END AS e FROM o),
    x AS (SELECT *, CASE WHEN e IS NULL THEN 'answer_not_numeric' WHEN len(ns) < 2 THEN 'too_few_operands' END AS reason,
      CASE WHEN k % 3 = 0 THEN CASE WHEN k % 7 = 1 THEN 'percentage' ELSE 'amount' END WHEN k % 5 = 0 THEN 'USD_millions' WHEN k % 5 = 1 THEN 'percentage' ELSE 'amount' END AS unit FROM c)
    SELECT k AS case_id, kind, CASE WHEN reason IS NULL THEN ns ELSE [] END AS operands, CASE WHEN reason IS NULL THEN CASE WHEN k % 3 = 0 THEN 'finqa_program_answer' ELSE 'final_result' END END AS slot,
      CASE WHEN reason IS NULL THEN e END AS expected, unit, CASE WHEN reason IS NULL THEN CASE WHEN k % 3 <> 0 THEN greatest(0.5, 0.02 * abs(e)) WHEN unit = 'percentage' THEN 0.1 ELSE greatest(0.05, 0.005 * abs(e)) END END AS tolerance,
      CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN (p - 100) / p * -2 END AS computed, reason FROM x""",
)
def _(spark, d):
    c = contracts.from_derivations(fx.derivation_cases(spark, d))
    return c.select("case_id", "kind", F.col("facts.value").alias("operands"), "slot", "expected", "unit", "tolerance", "computed", "reason")
