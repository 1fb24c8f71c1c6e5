"""All queries of the library proper, and their SQL twins."""

from . import check_plans, contract_plans, evidence_plans, gate_plans, graph_plans, hygiene_plans, io_plans, score_plans, slot_plans, text_plans, upkeep_plans

_PLANS = (text_plans, graph_plans, score_plans, io_plans, slot_plans, contract_plans, upkeep_plans, evidence_plans, gate_plans, check_plans, hygiene_plans)


def queries():
    return {k: f for p in _PLANS for k, f in p.Q.items()}


def oracle_sql():
    return {k: s for p in _PLANS for k, s in p.SQL.items()}
