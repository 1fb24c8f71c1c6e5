"""Queries for answers with several slots, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import slots
from ..sources import fixtures as fx
from .shapes import SLOTTED

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def numbers_sql(t: str) -> str:
    """DuckDB has no look-behind: the one character after a letter or underscore that could begin a number goes first."""
    clean = rf"regexp_replace(regexp_replace({t}, '{text.ID_WORD}', ' ', 'g'), '([A-Za-z_])[-($0-9]', '\1~', 'g')"
    raw = rf"list_filter(regexp_extract_all({clean}, '(?i){text.SCALED_NUMBER}'), lambda r: NOT regexp_full_match(trim(r), '20\d\d'))"
    bare = r"TRY_CAST(trim(regexp_replace(trim(lower(trim(r)), '()'), '[$,%]|percent|millions?|billions?|thousands?', '', 'g')) AS DOUBLE)"
    value = f"CASE WHEN starts_with(trim(r), '(') AND ends_with(trim(r), ')') THEN -{bare} ELSE {bare} END"
    factor = "CASE WHEN contains(lower(r), 'billion') THEN 1e9 WHEN contains(lower(r), 'million') THEN 1e6 WHEN contains(lower(r), 'thousand') THEN 1e3 ELSE 1.0 END::DOUBLE"
    return f"list_filter(list_transform({raw}, lambda r: struct_pack(v := {value}, s := ({value}) * {factor}, p := contains(r, '%') OR contains(lower(r), 'percent'))), lambda n: n.v IS NOT NULL)"


def rounded_sql(x: str) -> str:
    return f"sign({x}) * floor(abs({x}) * 10000 + 0.5) / 10000.0::DOUBLE"


BOTH = "final_answer || chr(10) || calculation"
MOVED = "CASE WHEN step THEN CASE WHEN e = 0 THEN v WHEN v / e BETWEEN 80 AND 120 THEN v / 100 WHEN v / e BETWEEN 0.008 AND 0.012 THEN v * 100 ELSE v END ELSE v END"
SCORED_SQL = f"""{SLOTTED}, s0 AS (SELECT *, {numbers_sql(BOTH)} AS ns, formula_type = 'finqa_program' AND NOT starts_with(method, 'graph') AS step FROM slotted),
  s1 AS (SELECT trace_id, step, formula_type, list_distinct(flatten(list_transform(ns, lambda n: [n.v, n.s]))) AS vs, unnest(lines) AS l FROM s0),
  s2 AS (SELECT trace_id, l.n AS n, l.said AS said, TRY_CAST(l.expected AS DOUBLE) AS e, formula_type, step, vs FROM s1),
  s3 AS (SELECT *, list_min(list_transform(vs, lambda v: abs({MOVED} - e))) AS gap, CASE WHEN formula_type = 'revenue_growth' THEN greatest(0.1, 0.005 * abs(e)) ELSE greatest(0.5, 0.02 * abs(e)) END AS tol FROM s2),
  s4 AS (SELECT trace_id, count(*) AS k, bool_and(coalesce(gap <= tol, false)) AS numeric_ok, count_if(coalesce(gap <= tol, false)) AS hits,
    list_sum(list(coalesce(greatest(0.0, 1 - least(gap / greatest(abs(e), 1.0), 1.0)), 0.0) ORDER BY n, said, e)) AS close,
    coalesce(string_agg('slot_' || n, ';' ORDER BY n, said, e) FILTER (coalesce(gap <= tol, false)), '') AS matched, coalesce(string_agg('slot_' || n, ';' ORDER BY n, said, e) FILTER (NOT coalesce(gap <= tol, false)), '') AS missing FROM s3 GROUP BY trace_id),
  s5 AS (SELECT t.*, coalesce(k, 0) AS k, coalesce(numeric_ok, false) AS numeric_ok, CASE WHEN k > 0 THEN {rounded_sql('hits / k')} ELSE 0.0 END::DOUBLE AS recall0, CASE WHEN k > 0 THEN {rounded_sql('close / k')} ELSE 0.0 END::DOUBLE AS nc0,
    coalesce(matched, '') AS matched, coalesce(missing, '') AS missing, final_answer <> '' AND calculation <> '' AS format_ok, contains(calculation, 'ratio') OR contains(calculation, '%') AS calculation_ok FROM slotted t LEFT JOIN s4 USING (trace_id)),
  s6 AS (SELECT *, numeric_ok AND format_ok AND calculation_ok AND NOT failed AS ok FROM s5),
  scored AS (SELECT *, ok OR coalesce(earlier_ac = 1, false) AS success, coalesce(earlier_ac = 1, false) AND NOT ok AS kept,
    CASE WHEN failed THEN 'provider_error' WHEN ok THEN 'none' WHEN NOT format_ok THEN 'answer_format_error' WHEN k = 0 THEN 'no_target_slots' WHEN NOT numeric_ok THEN 'formula_target_mismatch' ELSE 'scoring_uncertain' END AS reason FROM s6)"""


@query("sf5_scaled_numbers", f"WITH {SLOTTED}, n AS (SELECT trace_id, unnest({numbers_sql(BOTH)}) AS n, generate_subscripts({numbers_sql(BOTH)}, 1) AS place FROM slotted) SELECT trace_id, CAST(place AS INTEGER) AS place, n.v AS value, n.s AS scaled, n.p AS percent FROM n")
def _(spark, d):
    n = text.scaled_numbers(slots.both_texts())
    return fx.slotted_traces(spark, d).select("trace_id", F.posexplode(n).alias("place", "n")).select("trace_id", (F.col("place") + 1).alias("place"), "n.*")


@query("sc1_multi_slot_scorer", f"WITH {SCORED_SQL} SELECT trace_id, CAST(success AS INTEGER) AS ac, CASE WHEN kept THEN 1.0 ELSE recall0 END AS recall, CASE WHEN kept THEN coalesce(earlier_nc, nc0) ELSE nc0 END AS nc, matched, missing FROM scored")
def _(spark, d):
    return slots.score(fx.slotted_traces(spark, d)).select("trace_id", "ac", "recall", "nc", "matched", "missing")


@query("sc3_multi_slot_reasons", f"WITH {SCORED_SQL} SELECT trace_id, CASE WHEN kept THEN 'none' ELSE reason END AS failure_reason, CASE WHEN kept THEN 'original_success_preserved' END AS note FROM scored")
def _(spark, d):
    return slots.score(fx.slotted_traces(spark, d)).select("trace_id", "failure_reason", "note")


POINTS = "CASE WHEN {1} OR abs({0}) > 1 THEN {0} ELSE {0} * 100 END"
NEAR = "abs({0} - {1}) <= greatest({2} * greatest(abs({0}), abs({1})), {3})"
RATIO = "CASE WHEN n.p THEN n.v / 100 ELSE n.v END"


def same_sql(unit: str) -> str:
    """Whether a number n agrees with a plain expected number e."""
    percent = f"({NEAR.format(POINTS.format('e', f'{unit} = ' + chr(39) + 'percentage' + chr(39)), POINTS.format('n.v', 'n.p'), 1e-9, 0.1)} OR {NEAR.format('e', RATIO, 0.01, 0.0015)})"
    small = NEAR.format("e", "n.v", 0.01, 0.01)
    other = f"({NEAR.format('e', 'n.s', 0.005, 0.01)} OR {NEAR.format('e', 'n.v', 0.005, 0.01)})"
    return f"CASE WHEN {unit} = 'percentage' OR n.p THEN {percent} WHEN abs(e) < 100 AND abs(n.v) < 100 THEN {small} ELSE {other} END"


RECALL_SQL = f"""{SLOTTED}, r0 AS (SELECT *, {numbers_sql(BOTH)} AS ns FROM slotted), r1 AS (SELECT *, unnest(lines) AS l FROM r0), r2 AS (SELECT *, TRY_CAST(l.expected AS DOUBLE) AS e FROM r1),
  r3 AS (SELECT trace_id, avg(CAST(e IS NOT NULL AND len(list_filter(ns, lambda n: {same_sql('unit')})) > 0 AS DOUBLE)) AS sr, avg(CAST(e IS NOT NULL AND len(list_filter(ns, lambda n: {same_sql("'amount'")})) > 0 AND (trace_id % 5 = 0 OR contains(final_answer, '2020') OR contains(calculation, '2020')) AS DOUBLE)) AS fr FROM r2 GROUP BY trace_id),
  r4 AS (SELECT t.*, coalesce(sr, 0.0) AS sr, coalesce(fr, 0.0) AS fr, final_answer <> '' AND calculation <> '' AS f, contains(calculation, 'ratio') OR contains(calculation, '%') AS c FROM slotted t LEFT JOIN r3 USING (trace_id))"""


@query(
    "sc4_slot_recall_v7",
    f"""WITH {RECALL_SQL} SELECT trace_id, {rounded_sql('sr')} AS recall, {rounded_sql('fr')} AS fact_recall, CAST(sr >= 0.8 AND f AND c AS INTEGER) AS ac, CAST(sr >= 0.8 AND f AND c AND fr >= 0.8 AS INTEGER) AS ac_faithful,
    CASE WHEN NOT f THEN 'answer_format_error' WHEN sr < 0.8 THEN 'formula_target_mismatch' WHEN NOT c THEN 'scoring_uncertain' ELSE 'none' END AS failure_reason,
    CASE WHEN NOT f THEN 'answer_format_error' WHEN fr < 0.5 THEN 'required_fact_missing' WHEN len(lines) = 0 THEN 'expected_answer_ambiguous' WHEN sr < 0.8 THEN 'formula_target_mismatch' WHEN NOT c OR fr < 0.8 THEN 'scoring_uncertain' ELSE 'none' END AS gated_reason FROM r4""",
)
def _(spark, d):
    return slots.score_by_recall(fx.slotted_traces(spark, d)).select("trace_id", "recall", "fact_recall", "ac", "ac_faithful", "failure_reason", "gated_reason")


@query("ag1_multi_slot_summary", f"WITH {SCORED_SQL}, m AS (SELECT method, dataset, count(*) AS n, sum(CAST(success AS INTEGER)) AS success, count_if(NOT kept AND reason = 'provider_error') AS provider_errors FROM scored GROUP BY ALL) SELECT method, dataset, n, CAST(success AS BIGINT) AS success, provider_errors FROM m")
def _(spark, d):
    s = slots.score(fx.slotted_traces(spark, d))
    return s.groupBy("method", "dataset").agg(F.count("*").alias("n"), F.sum("ac").alias("success"), F.count_if(F.col("failure_reason") == "provider_error").alias("provider_errors"))
