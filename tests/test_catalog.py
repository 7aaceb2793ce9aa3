"""Functions for SQL callers on rows made by hand; nothing here goes through the SQL builders."""

import math

import pytest

from paperloom.functions import catalog, normalise


@pytest.fixture(scope="module")
def sql(spark):
    catalog.register(spark)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


@pytest.mark.parametrize(
    "call, want",
    [
        ("norm_money('12/03/2024 total 1,234.50')", 1234.5), ("norm_money('25.12.2018')", None), ("norm_money(null)", None), ("norm_money('a 12 b')", None), ("norm_money('1,2345')", 1234.0), ("norm_money('9.00')", 9.0),
        ("norm_date('on 1 / 2 / 24')", "2024-02-01"), ("norm_date('31-12-1999x')", "1999-12-31"), ("norm_date('1.2.345')", "0345-02-01"), ("norm_date('')", None), ("norm_date('45/13/2020')", "2020-13-45"),
        ("norm_text('  A\\t\\nB ')", "a b"), ("norm_text(null)", ""), ("norm_payment('Quét QR / CARD')", "CARD"), ("norm_payment('Tiền Mặt')", "CASH"), ("norm_payment('Thẻ')", "THẺ"), ("norm_payment('x')", None),
        ("norm_invoice('hd0042')", "HD0042"), ("norm_invoice('h12')", None), ("signed_money('(1 234.50)')", -1234.5), ("signed_money('500 DR')", -500.0), ("signed_money('500 DRX')", 500.0), ("signed_money('- 20,000 CR')", -20000.0),
        ("signed_money('')", None), ("signed_money('05/03/2025 700')", 2025700.0), ("account_number('12 34 56 78')", "12345678"), ("account_number('1234567')", None), ("account_number('123 456', 6)", "123456"),
        ("norm_field('total_amount', '1,000')", "1000.0"), ("norm_field('merchant_name', ' A  B')", "a b"), ("kv_value('sender_account', 'TK: 123 456')", "123456"), ("kv_value('opening_balance', '(5,000) x')", "-5000.0"), ("kv_value('content', 'a: B: c ')", "b: c"),
        ("kv_value('date', 'Date: 5/3/25')", "2025-03-05"), ("kv_value('content', 'x:')", None), ("diacritic_ratio('tổng')", 0.25), ("diacritic_ratio('')", 0.0), ("cjk_ratio('一a')", 0.5), ("cer('kitten', 'sitting')", 3 / 7), ("cer(null, '')", 0.0), ("cer('a', null)", 1.0),
        ("similarity('ab', 'abcd')", 0.5), ("anls('ab', 'abcd')", 0.5), ("anls('a', 'abcd')", 0.0), ("exact_match(' A', 'a ')", True), ("f1_score(0, 3, 0)", 0.0), ("f1_score(2, 1, 1)", 0.6667), ("f1_score(1, 0, 1)", 0.6667),
        # |8 - 6| and |1.5 - 2| over 12 predictions
        ("calibration_error(array(named_struct('n', 10L, 'confidence', 8D, 'hits', 6L), named_struct('n', 2L, 'confidence', 1.5D, 'hits', 2L)))", 0.2083),
    ],
)
def test_scalar(sql, call, want):
    ((got,),) = sql(f"SELECT {call}")
    assert got == want or (isinstance(want, float) and math.isclose(got, want))


def test_quantiles(sql):
    buckets = lambda *n: "array(" + ", ".join(f"named_struct('le', {le}D, 'n', {k}L)" for le, k in zip((10, 20, 1e9), n)) + ")"
    got = sql(f"SELECT histogram_quantile(0.5D, {buckets(0, 4, 8)}), histogram_quantile(0.25D, {buckets(4, 4, 8)}), histogram_quantile(0.9D, {buckets(4, 4, 8)}), histogram_quantile(0.5D, {buckets(0, 0, 0)})")
    assert got == [(20.0, 5.0, 20.0, None)]  # the open bucket gives its lower bound


def test_scalar_functions_run_as_built_in_expressions(spark, sql):
    plan = spark.sql("SELECT norm_money(CAST(id AS STRING)) AS m FROM range(10)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_split_merged_token(sql):
    rows = "VALUES ('Tổng cộng: 500 Cash Date: 1/2/24', 0D, 320D), ('Date: 1', 0D, 10D), ('only a date in here', 0D, 10D), ('', 3D, 7D), (null, 1D, 2D), ('Date Total', 0D, 1D), ('the card cash  ', 0D, 15D), ('xx Date cash', null, 5D) t(s, a, b)"
    got = {}
    for s, part, text, x0, x1 in sql(f"SELECT t.s, p.* FROM {rows}, LATERAL split_merged_token(t.s, t.a, t.b) p"):
        got.setdefault(s, []).append((part, text, x0, x1))
    assert got["Tổng cộng: 500 Cash Date: 1/2/24"] == [(1, "Tổng cộng: 500", 0.0, 150.0), (2, "Cash", 150.0, 200.0), (3, "Date: 1/2/24", 200.0, 320.0)]
    assert got["Date: 1"] == [(1, "Date: 1", 0.0, 10.0)] and got["only a date in here"] == [(1, "only a date in here", 0.0, 10.0)]
    assert got[""] == [(1, "", 3.0, 7.0)] and got[None] == [(1, "", 1.0, 2.0)]
    assert got["Date Total"] == [(1, "Date", 0.0, 0.5), (2, "Total", 0.5, 1.0)]
    assert got["the card cash  "] == [(1, "the card cash", 0.0, 15.0)]  # one kind alone: the first of its longest keywords
    assert [(p, t) for p, t, *_ in got["xx Date cash"]] == [(1, "xx Date"), (2, "cash")] and got["xx Date cash"][0][2:] == (None, None)


def test_reply_transactions(sql):
    reply = '[{"date": "1/2/2024", "description": "Xy", "amount": "5,000.00 DR", "balance": 300}, null, 7, {}, {"description": 5, "amount": -1200}, "x"]'
    assert sql(f"SELECT p.* FROM reply_transactions('{reply}') p") == [(1, "2024-02-01", "xy", -5000.0, 300.0), (2, None, None, None, None), (3, None, "5", -1200.0, None)]
    for none in ("''", "CAST(null AS STRING)", "'{}'", "'[1, 2'", "'3'"):
        assert sql(f"SELECT * FROM reply_transactions({none})") == []


def test_table_grid(sql):
    boxes = "('a', 'row', 0L, null, null, 0D, null, 10D), ('a', 'row', 1L, null, null, 20D, null, 30D), ('a', 'row', 2L, null, null, 40D, null, 50D), ('a', 'column', 0L, null, 0D, null, 50D, null), ('a', 'column', 1L, null, 60D, null, 100D, null), ('a', 'header', 0L, null, null, 5D, null, 25D)"
    tokens = "('a', 'token', 1L, 'right', 60D, 0D, 80D, 10D), ('a', 'token', 2L, 'left', 10D, 2D, 20D, 8D), ('a', 'token', 3L, 'between', 54D, 12D, 56D, 18D), ('a', 'token', 0L, 'two', 62D, 1D, 78D, 9D), ('a', 'token', 4L, null, 0D, 90D, 2D, 99D), ('b', 'token', 0L, 'alone', 0D, 0D, 1D, 1D)"
    got = sql(f"SELECT * FROM table_grid(TABLE(SELECT * FROM VALUES {boxes}, {tokens} AS t(doc_id, kind, idx, text, x0, y0, x1, y1)))")
    # rows 0 and 1 overlap the header equally, so the lower one on the page is it; what ties goes to the lowest box
    assert sorted(got) == [("a", 0, 0, "left", 1, 0), ("a", 0, 1, "between two right", 3, 0), ("a", 2, 0, "", 1, 0)]


def test_grid_header(sql):
    rows = "VALUES ('a', 'row', 0L, null, null, 0D, null, 10D), ('a', 'row', 1L, null, null, 10D, null, 20D), ('a', 'column', 0L, null, 0D, null, 9D, null), ('a', 'header', 0L, null, null, 8D, null, 12D), ('a', 'token', 0L, 't', 0D, 11D, 2D, 19D) AS t(doc_id, kind, idx, text, x0, y0, x1, y1)"
    assert sql(f"SELECT * FROM table_grid(TABLE(SELECT * FROM {rows}))") == [("a", 1, 0, "t", 1, 1)]


@pytest.mark.parametrize("call", ["reply_transactions(3)", "split_merged_token('a', 1D)", "table_grid(TABLE(SELECT 1 AS doc_id))"])
def test_wrong_arguments_are_refused(spark, sql, call):
    with pytest.raises(Exception, match="takes"):
        spark.sql(f"SELECT * FROM {call}")


def test_column_functions_agree(spark, sql):
    from pyspark.sql import functions as F

    texts = ["1,234.50", "Total: 12/03/24 (500) DR", None, "", "TK 1234 5678 9012", "ab1234 visa", "Thẻ tiền mặt", "- 7.25", "7.2.19 1,000", "(x) 900)"]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    frame.createOrReplaceTempView("catalog_texts")
    s = F.col("s")
    both = spark.sql("SELECT s, norm_money(s) AS a, norm_date(s) AS b, signed_money(s) AS c, norm_payment(s) AS d, norm_invoice(s) AS e, account_number(s) AS f, norm_text(s) AS g FROM catalog_texts")
    cols = frame.select(s, normalise.norm_money(s).alias("a"), normalise.norm_date(s).alias("b"), normalise.signed_money(s).alias("c"), normalise.norm_payment(s).alias("d"), normalise.norm_invoice(s).alias("e"), normalise.account_number(s).alias("f"), normalise.norm_text(s).alias("g"))
    assert sorted(both.collect(), key=repr) == sorted(cols.collect(), key=repr)


def test_grid_cells(sql):
    """The same cells as table_grid gives, from arrays; ties of rows, columns and header, tokens outside all boxes, and no boxes."""
    rows = [(0, 0.0, 10.0), (1, 10.0, 20.0), (2, 30.0, 40.0)]
    columns = [(0, 0.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 190.0)]
    tokens = [(k, t, x, y) for k, (t, x, y) in enumerate([("a", 25.0, 5.0), ("b", 50.0, 10.0), (None, 60.0, 10.0), ("c", 300.0, 25.0), ("d", -9.0, 99.0), ("e", 20.0, 5.0), ("f", 25.0, 5.0)])]
    real = lambda v: f"CAST({v} AS DOUBLE)"
    text = lambda v: "null" if v is None else f"'{v}'"
    boxes = lambda of: f"array({', '.join(f'struct({k}L AS idx, {real(a)} AS lo, {real(b)} AS hi)' for k, a, b in of)})"
    arrays = f"array({', '.join(f'struct({k}L AS idx, {text(t)} AS text, {real(x)} AS x, {real(y)} AS y)' for k, t, x, y in tokens)})"
    flat = [f"('a', 'row', {k}L, null, 0D, {real(a)}, 0D, {real(b)})" for k, a, b in rows] + [f"('a', 'column', {k}L, null, {real(a)}, 0D, {real(b)}, 0D)" for k, a, b in columns]
    flat += [f"('a', 'token', {k}L, {text(t)}, {real(x)}, {real(y)}, {real(x)}, {real(y)})" for k, t, x, y in tokens] + ["('a', 'header', 0L, null, 0D, 5D, 0D, 15D)"]
    want = sql(f"SELECT r, c, text, n, header FROM table_grid(TABLE(SELECT * FROM VALUES {', '.join(flat)} AS t(doc_id, kind, idx, text, x0, y0, x1, y1))) ORDER BY r, c")
    cells = lambda head, of=rows: f"grid_cells({arrays}, {boxes(of) if of else 'slice(' + boxes(rows) + ', 1, 0)'}, {boxes(columns)}, {head})"
    pick = "SELECT x.r, x.c, x.text, x.n, x.header FROM (SELECT explode(cells) AS x FROM (SELECT {} AS cells) c) e"
    assert sql(pick.format(cells("struct(5D AS lo, 15D AS hi)"))) == want and len(want) == 4 and {w[4] for w in want} == {0, 1}
    assert {r[4] for r in sql(pick.format(cells("CAST(null AS STRUCT<lo: DOUBLE, hi: DOUBLE>)")))} == {0}
    assert sql(pick.format(cells("struct(5D AS lo, 15D AS hi)", None))) == []


def test_sql_grid_takes_no_row_a_token(spark):
    """A page is one row of the plan, and no Python runs."""
    from paperloom.plans.registry import QUERIES

    plan = QUERIES["sql_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 2 and "Python" not in plan and "Union" not in plan and "Join" not in plan
