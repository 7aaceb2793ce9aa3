"""The review of whole documents on pages made by hand, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout as L
from paperloom.operators import pages as G
from paperloom.operators import statements as T
from paperloom.operators import structure
from paperloom.plans.dialect import Spark

SCHEMA = "doc_id string, tok_idx int, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def page(name, *lines, conf=0.95):
    """Lines of (x, text) tokens, 40 apart; a lone text is a line of one token."""
    out = []
    for n, line in enumerate(lines):
        for x, text in [(40, line)] if isinstance(line, str) or line is None else line:
            out.append((name, len(out), text, float(x), 20.0 + 40 * n, float(x) + 80, 40.0 + 40 * n, conf))
    return out


HEAD = ("Some Bank", "ACCOUNT STATEMENT", "Account No: 1234 5678 9012", "Account Holder: An Nguyen ", "Period: 01/02/2024 - 28/02/2024 (03/03/2024)", "Opening Balance: 1,000.00", "Closing Balance: 1,350.00")
TABLE = ([(40, "Date"), (200, "Description"), (400, "Amount"), (560, "Balance")], [(40, "01/02/2024"), (200, "Coffee"), (400, "(50.00)"), (560, "950.00")], [(40, "02/02/2024"), (200, "Pay"), (400, "400.00"), (560, "1,350.00")])
DOCS = [
    page("good", "Shop Abc", "Invoice No: HD0042", "Date: 05/03/2024", [(40, "Total"), (200, "45.50")], "Visa"),
    page("accents", "Cửa hàng", "Ngày: 05/03/2024", [(40, "Tổng cộng:"), (200, "45.50")], "Hóa đơn AB0012", "Tiền mặt"),
    page("no date", "Shop", "receipt", [(40, "Total"), (200, "60,000")]),
    page("subtotal", "Shop", "receipt", "Date: 05/03/2024", [(40, "Total"), (200, "10.00"), (400, "40.00")]),
    page("odd date", "Shop", "receipt", "Date: 45/13/1999", [(40, "Total"), (200, "9.00")]),
    page("unsure", "Shop", "receipt", "05/03/2024", [(40, "Total"), (200, "9.00")], conf=0.2),
    page("small", "Shop", "receipt", "Date: 05/03/2024", "Total 0.25"),
    page("statement", *HEAD, *TABLE, [(40, "03/02/2024"), (200, "Fee"), (400, "x"), (560, "1,350.00")]),
    page("few columns", *HEAD[:3], [(40, "Date"), (200, "Description"), (400, "Ref")], "a", "b", "c"),
    page("off", *HEAD, TABLE[0], [(40, "01/02/2024"), (200, "Coffee"), (400, "50.00"), (560, "950.00")]),
    page("bare number", "Some Bank", "statement of balance", "1234567890", "Closing Balance: 5.00", *TABLE, [(40, "03/02/2024"), (200, "Fee"), (400, "0.00"), (560, "1,350.00")]),
    page("order", "ỦY NHIỆM CHI", "Remitter: A Co", "From account: 111 222 333", "Người hưởng: B Co", "TK huong: 444 555 666", "Số tiền: 5,000.00", "Nội dung: x: y", "Ngày: 05/03/2024"),
    page("order without", "PAYMENT ORDER", "beneficiary: B Co", "remitter: C", "Amount: none", "Date: 05/03/1990"),
    page("empty", None, ""),
]
BLUR = {"good": 99.0, "subtotal": 100.0}
SKEW = {"accents": -9.0, "small": 6.0, "statement": 7.9}
WANT = {
    "good": ("receipt", "", 1), "accents": ("receipt", "geometry_risk:skew=-9.0", 1), "no date": ("receipt", "missing:date,implausible_total:60000.0", 1),
    "subtotal": ("receipt", "total_may_be_subtotal:got=10.0,max_seen=40.00", 1), "odd date": ("receipt", "implausible_year:1999,implausible_month:13,implausible_day:45", 1),
    # the date's line names no date: 0.6 * 0.4 + 0.4 * (0.5 * 0.2 + 0.5)
    "unsure": ("receipt", "low_conf:date=0.48", 1), "small": ("receipt", "implausibly_small_total:0.25", 1),
    # 1000 - 50 = 950, 950 + 400 = 1350, and a row without an amount, which doesn't follow
    "statement": ("bank_statement", "low_table_reconciliation:0.667", 1), "few columns": ("bank_statement", "missing:closing_balance,low_table_reconciliation:0.0,missing_statement_columns,sparse_statement_rows:0", 1),
    "off": ("bank_statement", "low_table_reconciliation:0.0,sparse_statement_rows:1", 1), "bare number": ("bank_statement", "low_table_reconciliation:0.667", 1),
    "order": ("payment_order", "", 0), "order without": ("payment_order", "missing:beneficiary_account,missing:amount,implausible_year:1990", 1), "empty": ("bank_statement", "missing:account_number,missing:closing_balance,low_table_reconciliation:0.0", 1),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [t for d in DOCS for t in d]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.createOrReplaceTempView("hand_tokens")
    number = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("doc_id")]
    return G.documents(frame).withColumn("blur", number(BLUR)).withColumn("skew", number(SKEW))


def test_reviews(docs):
    got = {r.doc_id: (r.doc_type, ",".join(r.reasons), r.needs_review, r.quality_pass) for r in G.reviewed(docs).collect()}
    assert {k: v[:3] for k, v in got.items()} == WANT
    assert {k for k, v in got.items() if not v[3]} == {"good"}


def test_fields(docs):
    got = {r.doc_id: {f.field: (f.value, round(f.confidence, 3)) for f in r.fields} for r in G.extracted(docs).collect()}
    assert {f: v for f, (v, _) in got["good"].items()} == {"merchant_name": "shop abc", "date": "2024-03-05", "total_amount": "45.5", "invoice_id": "HD0042", "payment_method": "CARD"}
    assert {f: v for f, (v, _) in got["accents"].items()} == {"merchant_name": "cửa hàng", "date": "2024-03-05", "total_amount": "45.5", "invoice_id": "AB0012", "payment_method": "CASH"}
    assert got["no date"]["date"] == (None, 0.0) and got["good"]["date"] == ("2024-03-05", 0.99)
    assert got["statement"] == {"bank_name": ("some bank", 0.85), "account_number": ("123456789012", 0.82), "account_holder": ("an nguyen", 0.82), "statement_period": ("01/02/2024 - 28/02/2024", 0.82), "opening_balance": ("1000.00", 0.82), "closing_balance": ("1350.00", 0.82)}
    assert got["bare number"]["account_number"] == ("1234567890", 0.78) and got["bare number"]["statement_period"] == (None, 0.0)
    assert got["order"] == {"bank_name": ("ủy nhiệm chi", 0.85), "sender_name": ("a co", 0.82), "sender_account": ("111222333", 0.82), "beneficiary_name": ("b co", 0.82), "beneficiary_account": ("444555666", 0.82), "amount": ("5000.00", 0.82), "content": ("x: y", 0.82), "date": ("2024-03-05", 0.82)}


def test_knobs(docs):
    loose = G.Knobs(least={"date": 0.4}, needed={"receipt": ("date",)}, sharp=50, skew=10, reconciled=0.5, few_items=0)
    got = {r.doc_id: ",".join(r.reasons) for r in G.reviewed(docs, loose).collect()}
    assert got["unsure"] == "" and got["accents"] == "" and got["statement"] == "" and got["few columns"] == "low_table_reconciliation:0.0,missing_statement_columns" and got["order without"] == "implausible_year:1990"


def test_a_document_takes_one_shuffle(spark, docs):
    plan = G.reviewed(docs).select("doc_id", "reasons")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_one_pass_tables_equal_sql(spark, docs):
    tokens = spark.table("hand_tokens")
    for fast, slow in ((T.items(tokens), L.items(Spark(), "SELECT * FROM hand_tokens")), (T.cells(tokens), L.cells(Spark(), "SELECT * FROM hand_tokens")), (T.header(tokens).select("doc_id", "yrow", "col", "cx"), f"SELECT doc_id, yrow, col, cx FROM ({L.header(Spark(), 'SELECT * FROM hand_tokens')}) h")):
        want = spark.sql(slow)
        assert sorted(map(tuple, fast.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert T.items(tokens).count() == 7


def test_line_fields_equal_the_row_form(spark, docs):
    """Fields of statements and orders by SQL over lines."""
    rows = {(r.doc_id, f.field): (f.value, round(f.confidence, 3)) for r in G.extracted(docs).collect() for f in r.fields}
    for sql, names in ((L.statement_fields, ("statement", "few columns", "off", "bare number")), (L.order_fields, ("order", "order without"))):
        got = {(r.doc_id, r.field): (r.value, round(float(r.confidence), 3)) for r in spark.sql(sql(Spark(), "SELECT * FROM hand_tokens")).filter(F.col("doc_id").isin(*names)).collect()}
        assert got == {k: v for k, v in rows.items() if k[0] in names}


def test_subtotal_and_sanity(spark):
    fields = "SELECT * FROM VALUES ('a', 'total_amount', '10.0'), ('b', 'total_amount', '20.0'), ('c', 'total_amount', null), ('d', 'total_amount', '-1.0') AS f(doc_id, field, value)"
    tokens = "SELECT * FROM VALUES ('a', 0, '21.00'), ('a', 1, '2,000'), ('b', 0, '41.99'), ('b', 1, '99999'), ('c', 0, '5.00'), ('d', 0, '5.00') AS t(doc_id, tok_idx, text)"
    assert [tuple(r) for r in spark.sql(L.subtotal(Spark(), fields, tokens)).collect()] == [("a", 10.0, 21.0)]  # 2,000 looks like a year


def test_tags_by_true_values(spark):
    tokens = "SELECT * FROM VALUES ('a', 0, 'Shop'), ('a', 1, ' ABC '), ('a', 2, '2024'), ('a', 3, '0305'), ('a', 4, '45,50'), ('a', 5, 'Visa'), ('a', 6, '45'), ('b', 0, '45') AS t(doc_id, tok_idx, text)"
    gold = "SELECT * FROM VALUES ('a', 'date', '2024-03-05'), ('a', 'total_amount', '45.50'), ('a', 'merchant_name', 'Shop Abc'), ('b', 'date', null) AS g(doc_id, field, gold)"
    got = {(r.doc_id, r.tok_idx): r.tag for r in spark.sql(structure.bio(Spark(), tokens, gold)).collect()}
    assert [got["a", k] for k in range(7)] == ["B-MERCHANT", "I-MERCHANT", "B-DATE", "I-DATE", "B-TOTAL", "O", "B-TOTAL"] and got["b", 0] == "O"


def test_header_cells_that_compete(spark, monkeypatch):
    """Cells that could name columns {0}, {0, 1}, {1, 2}, ...: each takes the first one that none before it has taken, however long the chain."""
    could = [{0}, {0, 1}, {1, 2}, {2, 3}, {3, 4}, {4, 5}, {5, 6}, {0, 6}]
    rows = ", ".join(f"('d', {c}L, 't{c}', {o})" for c, own in enumerate(could) for o in sorted(own))
    monkeypatch.setattr(structure, "cell_columns", lambda d: f"SELECT * FROM VALUES {rows} AS c(doc_id, cell, text, ord)")
    got = {r.cell: r.col for r in spark.sql(structure.semantic_columns(Spark())).collect()}
    names = list(L.COLUMNS)
    taken, want = set(), {}
    for c, own in enumerate(could):
        free = sorted(own - taken)
        if free:
            want[c] = names[free[0]]
            taken.add(free[0])
    assert got == want
