"""The same tables as in sources.fixtures, as common table expressions for DuckDB."""

FACTS = """
lines AS (
  SELECT 'S' || l_suppkey AS ticker, CAST(year(l_shipdate) + 20 AS INTEGER) AS year, l_returnflag AS ordinal,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t,
    CAST(l_quantity AS DECIMAL(12,2)) AS q
  FROM lineitem
), facts_raw AS (
  SELECT ticker, year, ordinal, unnest(['total_revenue', 'operating_expense', 'income_tax_expense', 'cost_of_sales']) AS metric,
    unnest([CAST(sum(p * (1 - d)) AS DOUBLE), CAST(sum(p * d) AS DOUBLE), CAST(sum(p * t) AS DOUBLE), CAST(sum(q * 100) AS DOUBLE)]) AS value
  FROM lines GROUP BY ticker, year, ordinal
), cells AS (
  SELECT ticker, year, CAST(sum(p * (1 - d)) AS DOUBLE) AS rev, CAST(sum(p * d) AS DOUBLE) AS ex, CAST(sum(p * t) AS DOUBLE) AS tax,
    CAST(sum(q * 100) AS DOUBLE) AS cost
  FROM lines GROUP BY ticker, year
), facts AS (
  SELECT ticker, year,
    unnest(['total_revenue', 'operating_expense', 'income_tax_expense', 'cost_of_sales', 'gross_profit', 'operating_income', 'net_income']) AS metric,
    unnest([rev, ex, tax, cost, rev - cost, rev - cost - ex, rev - cost - ex - tax]) AS value
  FROM cells
)"""

OBSERVATIONS = (
    FACTS
    + """, sobs AS (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS s FROM facts_raw), observations AS (
  SELECT 'case_' || s AS case_id, ticker,
    CASE WHEN metric = 'total_revenue' AND s % 3 = 0 THEN 'Net Sales' WHEN metric = 'cost_of_sales' AND s % 2 = 0 THEN 'cost of goods sold'
      WHEN metric = 'operating_expense' AND s % 5 = 0 THEN 'G&A' ELSE metric END AS raw_metric,
    CASE WHEN s % 13 = 0 THEN 1999 ELSE year END AS year,
    CASE WHEN s % 17 = 0 AND ordinal = 'A' THEN CAST(year AS DOUBLE) ELSE round(value, 2) END AS value,
    CASE WHEN s % 11 = 0 THEN '' ELSE 'currency_millions' END AS unit,
    CASE WHEN s % 7 = 0 AND ordinal = 'N' THEN '' ELSE metric || ' was reported' END AS quote, ordinal
  FROM sobs
)"""
)

TRACES = """
ev AS (
  SELECT *, CAST(floor(value * (1 + (event_id % 7 - 3) * 0.005::DOUBLE) * 100) AS BIGINT) AS cents FROM events
), traces AS (
  SELECT event_id AS trace_id, event_id // 5 AS case_id, 'm' || (event_id % 5) AS method, event_type AS dataset,
    CAST(user_id % 3 AS INTEGER) AS level, round(value, 2) AS expected,
    CASE WHEN event_id % 11 = 0 THEN ''
      WHEN event_id % 3 = 0 THEN 'Answer: $' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
      WHEN event_id % 3 = 1 THEN (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '%'
      ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' in FY 2020' END AS answer,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'a / b = c' END AS calculation,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
  FROM ev
)"""

JUDGMENTS = """
judgments AS (
  SELECT doc_id AS item, 'm' || (doc_id % 4) AS method, 'j' || j AS judge,
    CASE WHEN (doc_id + j) % 97 <> 0 THEN CAST((doc_id * (2 * j + 1) + n_chars) % 3 AS INTEGER) END AS code
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS j)
)"""

SLOTTED = """
slot_lines AS (
  SELECT l_orderkey AS trace_id, list({'n': l_linenumber, 'said': said, 'expected': expected} ORDER BY l_linenumber, said, expected)[1:4] AS lines FROM (
    SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN '$' || CAST(p AS VARCHAR) WHEN 1 THEN CAST(p * 0.01::DECIMAL(3,2) AS VARCHAR) || '%'
      WHEN 2 THEN CAST(p * 1.003::DECIMAL(4,3) AS VARCHAR) WHEN 3 THEN CAST(p * 1.015::DECIMAL(4,3) AS VARCHAR) WHEN 4 THEN 'not given'
      ELSE CAST(p * 0.001::DECIMAL(4,3) AS VARCHAR) || ' thousand' END AS said,
      CASE WHEN l_linenumber = 4 AND l_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(p AS VARCHAR) END AS expected
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem WHERE l_linenumber <= 4 AND l_quantity >= 15)) GROUP BY l_orderkey
), slotted AS (
  SELECT o_orderkey AS trace_id, o_orderstatus AS dataset, ['graph_neo4j_v8', 'graph_neo4j_v9', 'vector_only', 'hybrid'][o_orderkey % 4 + 1] AS method,
    ['finqa_program', 'revenue_growth', 'tatqa_arithmetic'][o_orderkey % 3 + 1] AS formula_type,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'case_' || o_orderkey || ' in 2020: ' || coalesce(array_to_string(list_transform(list_filter(lines, lambda x: x.n % 2 = 1), lambda x: x.said), '; '), '') END AS final_answer,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'ratio: ' END || coalesce(array_to_string(list_transform(list_filter(lines, lambda x: x.n % 2 = 0), lambda x: x.said), '; '), '') END AS calculation,
    coalesce(lines, []) AS lines, CASE WHEN o_orderkey % 2 = 0 THEN 'amount' ELSE 'percentage' END AS unit, o_orderkey % 19 = 0 AS failed,
    CASE WHEN o_orderkey % 17 = 0 THEN 1.0::DOUBLE END AS earlier_ac, CASE WHEN o_orderkey % 34 = 0 THEN 0.875::DOUBLE END AS earlier_nc
  FROM orders LEFT JOIN slot_lines ON trace_id = o_orderkey
)"""

#: SLOTTED with a slot for every line.
SLOTTED_WHOLE = SLOTTED.replace("[1:4] AS lines", " AS lines").replace(" WHERE l_linenumber <= 4 AND l_quantity >= 15", "")

FORMULA_CASES = """
formula_cases AS (
  SELECT c_custkey AS case_id, c_custkey % 13 AS kind, 'S' || (c_custkey % 10 + 1) AS ticker,
    ['what was the effective tax rate?', 'how did inventory turnover develop?', 'assess liquidity over the years.', 'compare gross margin.', 'is the margin improving?',
     'how does the cost/sg&a ratio move?', 'what drove growth?', 'reconcile eps.', 'who audits the company?', 'explain the effective tax charge.', 'net inc growth and eps impact?',
     'what is the noninterest exp ratio?', 'operating profit margin of the bank?'][c_custkey % 13 + 1] AS q, CASE WHEN c_custkey % 26 = 8 THEN 'the current ratio fell.' ELSE '' END AS a
  FROM customer
), formula_facts AS (
  SELECT case_id, kind, CASE
      WHEN kind = 0 AND metric = 'income_tax_expense' THEN 'provision_for_income_taxes' WHEN kind = 0 AND metric = 'operating_income' THEN 'income_before_income_taxes'
      WHEN kind = 1 AND metric = 'operating_expense' THEN 'inventories' WHEN kind = 2 AND metric = 'total_revenue' THEN 'current_assets' WHEN kind = 2 AND metric = 'cost_of_sales' THEN 'current_liabilities'
      WHEN kind = 5 AND metric = 'operating_expense' THEN 'selling_general_and_administrative' WHEN kind = 7 AND metric = 'cost_of_sales' THEN 'weighted_average_shares'
      WHEN kind = 9 AND metric = 'income_tax_expense' THEN 'levies' WHEN kind = 10 AND metric = 'cost_of_sales' THEN 'diluted_earnings_per_common_share'
      WHEN kind = 11 AND metric = 'operating_expense' THEN 'total_noninterest_expense' WHEN kind IN (11, 12) AND metric = 'total_revenue' THEN 'net_interest_income'
      WHEN kind = 12 AND metric = 'operating_income' THEN 'income_before_taxes' WHEN kind = 12 AND metric = 'gross_profit' THEN 'total_other_income' ELSE metric END AS metric, year, value, place
  FROM formula_cases JOIN (SELECT ticker, metric, year, value, ascii(ordinal) AS place FROM facts_raw UNION ALL SELECT ticker, metric, year, value, 1000 FROM facts) USING (ticker)
)"""
