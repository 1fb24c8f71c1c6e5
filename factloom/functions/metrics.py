"""Metric names: the dictionary of canonical names and the rules for names it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical name, then its aliases.
DICTIONARY = {
    "total_revenue": ("revenue", "revenues", "sales", "net sales", "total revenues", "total revenue", "net revenue"),
    "total_net_revenue": ("total net revenue", "total net revenues"),
    "cost_of_sales": ("cost of revenue", "cost of revenues", "cost of goods sold", "cost of sales", "total cost of revenue", "cogs"),
    "gross_profit": ("gross profit", "total gross profit", "gross income"),
    "operating_income": ("operating income", "income from operations", "operating earnings", "loss from operations", "operating income loss"),
    "operating_expense": ("operating expenses", "total operating expenses", "opex"),
    "net_income": ("net income", "net earnings", "net income loss", "net loss", "net earnings loss"),
    "net_income_attributable_common": ("net income available to common shares", "net income attributable to common shareholders", "net income attributable to common stockholders"),
    "research_and_development_expense": ("research and development", "research and development expense", "research and development expenses", "r&d", "rd"),
    "selling_general_admin_expense": ("selling general and administrative", "selling general and administrative expense", "general and administrative", "sales and marketing", "sg&a", "sga"),
    "interest_expense": ("interest expense", "interest income expense net", "interest expense net"),
    "income_tax_expense": ("provision for income taxes", "income tax expense", "provision for taxes", "tax provision", "income taxes"),
    "income_before_taxes": ("income before taxes", "earnings before taxes", "income before provision for income taxes", "income loss before income taxes", "ebt"),
    "total_assets": ("total assets",),
    "total_liabilities": ("total liabilities",),
    "stockholders_equity": ("stockholders equity", "shareholders equity", "total equity", "total stockholders equity"),
    "cash_and_equivalents": ("cash and cash equivalents", "cash equivalents", "cash"),
    "total_debt": ("total debt", "debt", "borrowings"),
    "depreciation_amortization": ("depreciation and amortization", "depreciation", "amortization", "d&a"),
    "ebit": ("ebit", "earnings before interest and taxes"),
    "ebitda": ("ebitda",),
    "net_earned_premiums": ("net earned premiums", "premiums earned", "earned premiums"),
    "total_employees": ("employees", "total employees", "workforce", "headcount"),
    "diluted_eps": ("diluted eps", "diluted earnings per share", "net income per share diluted", "earnings per share diluted", "eps diluted"),
    "basic_eps": ("basic eps", "basic earnings per share", "net income per share basic", "earnings per share basic", "eps basic"),
    "diluted_shares": ("weighted average diluted shares", "weighted-average shares diluted", "diluted shares", "weighted-average shares used to compute diluted"),
    "basic_shares": ("weighted average basic shares", "weighted-average shares basic", "basic shares", "weighted-average shares used to compute basic"),
    "dividends_paid": ("dividends paid", "cash dividends", "dividends"),
    "capital_expenditure": ("capital expenditures", "capital expenditure", "purchases of property and equipment", "capex"),
    "inventory": ("inventory", "inventories"),
    "accounts_receivable": ("accounts receivable", "receivables", "trade receivables"),
    "long_term_debt": ("long-term debt", "long term debt"),
    "current_assets": ("current assets", "total current assets"),
    "current_liabilities": ("current liabilities", "total current liabilities"),
    "retained_earnings": ("retained earnings", "accumulated deficit"),
}


# Slugs that name no metric, and so does whatever begins like the first.
BLOCKED = ("source_value", "program_operand", "operand", "value", "amount", "number")


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


# Rules for slugs that are no alias, the first that holds decides; a null result means "no metric".
RULES = (
    (_has("available_to_common", "available_common", "attributable_to_common"), "net_income_attributable_common"),
    (f"{_has('share')} AND {_has('weighted', 'average', 'outstanding')} AND {_has('diluted')}", "diluted_shares"),
    (f"{_has('share')} AND {_has('weighted', 'average', 'outstanding')}", "basic_shares"),
    (f"{_has('other', 'product', 'subscription', 'segment')} AND {_has('revenue', 'sales')}", None),
    (f"{_has('cost')} AND {_has('revenue', 'sales', 'goods_sold')}", "cost_of_sales"),
    (f"{_has('gross')} AND {_has('profit')}", "gross_profit"),
    (f"{_has('operating', 'operations')} AND {_has('income', 'loss', 'earnings')}", "operating_income"),
    (f"{_has('operating')} AND {_has('expense')}", "operating_expense"),
    (f"{_has('net')} AND {_has('income', 'earnings', 'loss')} AND ({_has('per_share')} OR right(m, 4) = '_eps') AND {_has('diluted')}", "diluted_eps"),
    (f"{_has('net')} AND {_has('income', 'earnings', 'loss')} AND ({_has('per_share')} OR right(m, 4) = '_eps')", "basic_eps"),
    (f"{_has('net')} AND {_has('income', 'earnings', 'loss')}", "net_income"),
    (f"({_has('revenue')} OR m = 'sales' OR right(m, 6) = '_sales') AND NOT {_has('cost')}", "total_revenue"),
    (f"{_has('diluted')} AND {_has('eps', 'per_share')}", "diluted_eps"),
    (f"{_has('basic')} AND {_has('eps', 'per_share')}", "basic_eps"),
    (f"{_has('diluted')} AND {_has('share')}", "diluted_shares"),
    (f"{_has('basic')} AND {_has('share')}", "basic_shares"),
    (_has("tax"), "income_tax_expense"),
    (_has("income_before", "earnings_before_tax"), "income_before_taxes"),
    (f"{_has('research')} AND {_has('development')}", "research_and_development_expense"),
    (f"{_has('selling', 'general', 'administrative', 'marketing')} AND {_has('expense')}", "selling_general_admin_expense"),
    (_has("employee", "workforce", "headcount"), "total_employees"),
)
RULE_SQL = "CASE " + " ".join(f"WHEN {c} THEN {'NULL' if r is None else repr(r)}" for c, r in RULES) + " END"


def slug(c: Column) -> Column:
    """Lower case, ``&`` as and, runs of other characters as one underscore, none at the ends."""
    s = F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "_")
    return F.trim(s, F.lit("_"))


def dictionary(spark: SparkSession) -> DataFrame:
    """(alias, canonical): slugs of names and aliases, each once; a later entry would win."""
    rows = [(k, a, n) for n, (k, v) in enumerate(DICTIONARY.items()) for a in (k, *v)]
    d = spark.createDataFrame(rows, "canonical string, alias string, n int").withColumn("alias", slug(F.col("alias")))
    return d.groupBy("alias").agg(F.max_by("canonical", "n").alias("canonical"))


def canonical(df: DataFrame, raw: str = "raw_metric", out: str = "metric") -> DataFrame:
    """df with the canonical metric of ``raw``: the dictionary, then the rules, else null, as where the name is blocked.

    The dictionary has a fixed size.
    """
    d = F.broadcast(dictionary(df.sparkSession).withColumnRenamed("alias", "m"))
    with_slug = df.withColumn("m", slug(F.col(raw))).join(d, "m", "left")
    blocked = F.col("m").isin("", *BLOCKED) | F.col("m").startswith(BLOCKED[0])
    return with_slug.withColumn(out, F.when(~blocked, F.coalesce("canonical", F.expr(RULE_SQL)))).drop("m", "canonical")


_VALUES = ", ".join(f"({n}, '{k}', '{a}')" for n, (k, v) in enumerate(DICTIONARY.items()) for a in (k, *v))
SLUG_SQL = "trim(regexp_replace(replace(lower(trim(coalesce({0}, ''))), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')"
#: dict(m, canonical) for DuckDB.
DICT_SQL = f"dict AS (SELECT {SLUG_SQL.format('alias')} AS m, max_by(canonical, n) AS canonical FROM (VALUES {_VALUES}) v(n, canonical, alias) GROUP BY 1)"
