"""Each query against its SQL equivalent on the smallest tables."""

import math
import re

import duckdb
import pytest

from paperloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["lines", "line_items", "receipt_fields", "document_type", "routing", "reconcile", "norm_money", "norm_date", "signed_money", "latency_p95", "alert_hold", "registry_active", "calibration_bins", "box_overlap", "percentiles", "stress", "entity_f1", "detector_taxonomy", "semantic_columns", "label_files", "region_files", "reply_transactions", "document_results", "statement_triggers", "grid_items", "statement_header", "sql_normalised", "sql_split_tokens", "sql_grid", "alerts_live", "document_states", "archive_members", "upserted_state", "account_running", "kind_sessions", "choose_span", "region_tokens", "order_inversions", "word_error_rate", "measured_stages", "stream_batches", "run_report", "routing_rates"]


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else None if isinstance(v, float) else v
    return sorted(([clean(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name, most", [("line_items", 2), ("reconcile", 2), ("grid_items", 2), ("table_mode", 2), ("statement_header", 2), ("document_results", 3), ("statement_triggers", 4)])
def test_documents_are_dealt_once(spark, name, most):
    """Shuffles of the plan: the rendering's by customer, the documents' own, and one more where kinds come together."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange (?:hash|range|single|round)", plan, re.I)) <= most


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["receipt_fields", "candidate_features"])
def test_receipts_take_no_row_a_token(spark, name):
    """A page is one row: one shuffle, and neither windows nor sorts of tokens, lines or candidates."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange (?:hash|range|single|round)", plan, re.I)) == 1 and "Window" not in plan and "SortAggregate" not in plan


def test_candidates_bring_value_and_features_together(spark):
    """What learned_fields scores: one shuffle, no join of candidates with themselves."""
    from paperloom.operators import layout
    from paperloom.plans.dialect import Spark, run

    rows = run(spark, SF, layout.features(Spark(), more=f", {layout.NORM} AS norm"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    want = run(spark, SF, layout.candidates(Spark())).select("doc_id", "line_idx", "field", "norm")
    assert rows.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(rows.select(*want.columns)).isEmpty()


@pytest.mark.parametrize("name", ["table_mode", "grid_items", "reconcile", "statement_triggers", "line_items"])
def test_statements_take_no_row_a_token(spark, name):
    """A page is one row: the only windows are those of the customers' running sums, and what is dealt by page are transactions."""
    from paperloom.plans.dialect import run

    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    windows = lambda text: len(re.findall(r"\bWindow \[", text))
    mine = plan(QUERIES[name](spark, SF))
    assert windows(mine) == windows(plan(run(spark, SF, "SELECT * FROM running_orders"))) and "Join" not in mine
    assert len(re.findall(r"\bExchange hash", mine)) <= 2


def test_routing_rates_take_one_row_a_document(spark):
    """Types and key fields come from one row a document: no join but that of suppliers with their nations, no window but those of the running sums."""
    from paperloom.plans.dialect import run

    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    mine, base = plan(QUERIES["routing_rates"](spark, SF)), plan(run(spark, SF, "SELECT * FROM running_orders"))
    assert len(re.findall(r"\w+Join ", mine)) == 1 and len(re.findall(r"\bWindow \[", mine)) == len(re.findall(r"\bWindow \[", base))
