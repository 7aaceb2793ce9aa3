"""One row a document: its lines, its table, what classifies it, its fields, and whether a person must look at it.

The tokens are dealt by doc_id once; lines, rows, cells and all that follows are expressions over a document's arrays, as a page has few
tokens. So the whole way from tokens to the review has no window and no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.render import let
from . import layout as L
from . import statements as T
from .statements import S

LINE = "struct<line:int,text:string,x0:double,y0:double,x1:double,y1:double,conf:double>"


@dataclass(frozen=True)
class Knobs:
    """What may be set: least confidences (by field, and of other fields), the fields that each kind needs, the least blur score, the skew that is a risk, the share of rows that must reconcile, and when a table is sparse."""

    least: dict[str, float] = field(default_factory=lambda: dict(L.LEAST))
    least_other: float = L.LEAST_OTHER
    needed: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(L.NEEDED))
    sharp: float = 100.0
    rotated: float = 5.0
    skew: float = 8.0
    reconciled: float = 0.7
    few_items: int = 3
    many_rows: int = 6


def documents(tokens: DataFrame) -> DataFrame:
    """tokens: pages with toks, or doc_id, tok_idx, text, x0, y0, x1, y1, conf. Returns doc_id, lines (by their place), body (lower-case text in the order of tokens), n, n_money, gaps, seen (the largest plausible amount), n_rows, cols, items and rate (the share of a table's tokens that its grid holds)."""
    near = "get(s, i - 1).cy IS NULL OR abs(get(s, i).cy - get(s, i - 1).cy) <= 0.6 * greatest(get(s, i - 1).y1 - get(s, i - 1).y0, 1)"
    words = "array_join(filter(sort_array(transform(l, x -> struct(x.x0 AS x0, x.tok AS tok, x.text AS text))), x -> trim(x.text) <> '').text, ' ')"
    lines = f"transform({T.groups('s', near)}, (l, n) -> struct(n AS line, {words} AS text, array_min(l.x0) AS x0, array_min(l.y0) AS y0, array_max(l.x1) AS x1, array_max(l.y1) AS y1, array_min(l.conf) AS conf))"
    bare = "trim(replace(replace(x.text, ',', ''), ' ', ''))"
    seen = let("v", bare, "CASE WHEN v RLIKE '^[0-9]{1,6}([.][0-9]{1,2})?$' AND try_cast(v AS DOUBLE) BETWEEN 0.1 AND 50000 AND NOT try_cast(v AS DOUBLE) BETWEEN 1900 AND 2100 THEN try_cast(v AS DOUBLE) END")
    columns = {
        "lines": f"CAST({lines} AS array<{LINE}>)", "body": "array_join(transform(sort_array(transform(s, x -> struct(x.tok AS tok, lower(x.text) AS text))), x -> x.text), ' ')", "n": "CAST(size(s) AS BIGINT)",
        "n_money": "CAST(size(filter(s, x -> x.text RLIKE '[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+[.][0-9]{2}')) AS BIGINT)", "gaps": "CAST(size(filter(sequence(1, size(s)), i -> get(s, i).cy - get(s, i - 1).cy > 12)) AS BIGINT)",
        "seen": f"array_max(transform(s, x -> {seen}))",
    }
    out = T.pages(tokens).withColumn("s", F.expr(T.down("toks"))).withColumn("p", F.expr(f"CASE WHEN toks IS NOT NULL THEN {let('s', 's', T.placing('s'))} END"))
    table = {"n_rows": "CAST(size(p.rows) AS BIGINT)", "cols": "p.cols", "items": T.transactions("p"), "rate": T.rated("p")}
    own = [F.expr(f"CASE WHEN s IS NOT NULL THEN {let('s', 's', sql)} END").alias(c) for c, sql in columns.items()] + [F.expr(let("p", "p", sql)).alias(c) for c, sql in table.items()]
    return out.select(*[c for c in out.columns if c not in ("toks", "s", "p")], *own)


def _count(words) -> Column:
    return sum((F.expr(f"CAST((length(body) - length(replace(body, '{w}', ''))) / {len(w)} AS BIGINT)") for w in words), F.lit(0).cast("long"))


def doc_type() -> Column:
    """The kind whose keywords occur most often; of those that tie the first of statement, receipt and payment order."""
    return F.when((F.col("stmt") >= F.col("rcpt")) & (F.col("stmt") >= F.col("po")), "bank_statement").when(F.col("rcpt") >= F.col("po"), "receipt").otherwise("payment_order")


def _receipt_fields(names=("merchant_name", *L.ANCHOR_WORDS)) -> str:
    """SQL of a receipt's fields: for each the line of the highest score that has a value, the earlier one of those that tie."""
    pay = "CASE " + " ".join(f"WHEN contains(l.low, '{k}') THEN '{v}'" for k, v in L.PAYMENT) + " END"
    text = f"transform(lines, x -> struct(x.line AS line, x.text AS text, lower(x.text) AS low, (x.x0 + x.x1) / 2 AS cx, (x.y0 + x.y1) / 2 AS cy, x.y1 AS y1, x.conf AS conf, regexp_extract(x.text, '{L.DATE}', 0) AS said))"
    # without a date there is nothing to blank
    amount = f"round(try_cast(replace(nullif(regexp_extract(CASE WHEN l.said <> '' THEN regexp_replace(l.text, '{L.DATE}', ' ') ELSE l.text END, '{L.MONEY}', 0), ''), ',', '') AS DOUBLE), 2)"
    values = {"date": ("dt", f"CASE WHEN l.said <> '' THEN {T.day('l.said')} END"), "total_amount": ("amt", amount), "invoice_id": ("inv", S.rx("upper(l.text)", "[A-Z]{1,4}[0-9]{3,}")), "payment_method": ("pay", pay)}
    facts = f"transform({text}, l -> struct(l.line AS line, l.low AS low, l.cx AS cx, l.cy AS cy, l.y1 AS y1, l.conf AS conf, {', '.join(f'{sql} AS {c}' for f, (c, sql) in values.items() if f in names) or 'null AS none'}))"
    near_of = [f"'near_{f}', filter(facts, a -> {L.says(words, 'a.low')})" for f, words in L.ANCHOR_WORDS.items() if f in names]
    most = ["'most', array_max(transform(facts, f -> nullif(f.amt, 0)))"] if "total_amount" in names else []
    page = "named_struct(" + ", ".join(["'facts', facts", *near_of, "'height', array_max(transform(facts, f -> f.y1))", *most]) + ")"
    out = []
    for name, norm in (("merchant_name", "h.low"), ("date", "h.dt"), ("total_amount", "CAST(h.amt AS STRING)"), ("invoice_id", "h.inv"), ("payment_method", "h.pay")):
        if name not in names:
            continue
        words = L.ANCHOR_WORDS.get(name)
        near = f"coalesce(array_max(transform(p.near_{name}, a -> greatest(0, 1 - (abs(a.cx - h.cx) + abs(a.cy - h.cy)) / 1000))), 0)" if words else "0"
        score = "1 - h.cy / p.height" if not words else f"0.5 * {near} + 0.5 * (CASE WHEN h.amt = p.most THEN 1 ELSE 0 END)" if name == "total_amount" else f"0.4 + 0.6 * ({near})"
        scored = f"transform(transform(filter(p.facts, h -> {norm} IS NOT NULL), h -> named_struct('line', h.line, 'value', {norm}, 'conf', h.conf, 'score', CAST({score} AS DOUBLE))), h -> named_struct('less', -round(h.score, 9), 'line', h.line, 'value', h.value, 'conf', h.conf, 'score', h.score))"
        best = f"array_min({scored})"
        out.append(f"named_struct('field', '{name}', 'best', {best})")
    fields = f"transform(array({', '.join(out)}), r -> named_struct('field', r.field, 'value', r.best.value, 'confidence', CASE WHEN r.best IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(round(least(1, 0.6 * r.best.score + 0.4 * (0.5 * r.best.conf + 0.5)), 3) AS DOUBLE) END))"
    return let("facts", facts, let("p", page, fields))


def _line_fields(anchors, value, account: bool) -> str:
    """SQL of the fields of a statement or a payment order: what each field's first line with a keyword says. Lines are lower-cased once, and an account number is looked for elsewhere only where no line states one."""
    out = ["named_struct('field', 'bank_name', 'value', get(ls, 0).low, 'confidence', CAST(0.85 AS DOUBLE))"]
    for name, words in anchors.items():
        said = let("line", f"get(filter(ls, l -> {L.says(words, 'l.low')}), 0).text", value(S, name))
        other = f"get(filter(transform(ls, l -> {L.digits(S, 'l.text', 8)}), v -> v IS NOT NULL), 0)" if account and name == "account_number" else "CAST(null AS STRING)"
        known = let("said", said, f"named_struct('said', said, 'other', CASE WHEN said IS NULL THEN {other} END)")
        out.append(let("v", known, f"named_struct('field', '{name}', 'value', coalesce(v.said, v.other), 'confidence', CAST(CASE WHEN v.said IS NOT NULL THEN 0.82 WHEN v.other IS NOT NULL THEN 0.78 ELSE 0 END AS DOUBLE))"))
    return let("ls", "transform(lines, l -> struct(l.text AS text, lower(l.text) AS low))", f"array({', '.join(out)})")


FIELDS = "array<struct<field:string,value:string,confidence:double>>"


def with_fields(docs: DataFrame, kind: str) -> DataFrame:
    """documents(), all of one kind, with their fields (field, value, confidence)."""
    by = {"bank_statement": lambda: _line_fields(L.STATEMENT_ANCHORS, L.statement_value, True), "payment_order": lambda: _line_fields(L.ORDER_ANCHORS, L.order_value, False), "receipt": _receipt_fields}
    return docs.withColumn("fields", F.expr(by[kind]()).cast(FIELDS))


def routed(docs: DataFrame, kind: Column, keys: dict[str, str]) -> DataFrame:
    """documents() with doc_type, what the document is taken for, and key, the field that keys names for its true kind."""
    only = lambda anchors, of: {keys[of]: anchors[keys[of]]}
    value = lambda sql: F.element_at(F.expr(sql).cast(FIELDS), -1).getField("value")
    key = F.when(kind == "receipt", value(_receipt_fields((keys["receipt"],)))).when(kind == "bank_statement", value(_line_fields(only(L.STATEMENT_ANCHORS, "bank_statement"), L.statement_value, True)))
    typed = docs.withColumn("stmt", _count(L.STATEMENT)).withColumn("rcpt", _count(L.RECEIPT)).withColumn("po", _count(L.ORDER)).withColumn("doc_type", doc_type())
    return typed.withColumn("key", key.otherwise(value(_line_fields(only(L.ORDER_ANCHORS, "payment_order"), L.order_value, False))))


def balance(name: str) -> Column:
    """A field of with_fields() as a number."""
    return _value(name).try_cast("double")


def extracted(docs: DataFrame) -> DataFrame:
    """documents() with doc_type and fields (field, value, confidence) by what the document is taken for; line items stay with statements only. Where docs have read (receipts.typed()), it is known to be a receipt and read by then."""
    typed = docs.withColumn("stmt", _count(L.STATEMENT)).withColumn("rcpt", _count(L.RECEIPT)).withColumn("po", _count(L.ORDER)).withColumn("doc_type", doc_type())
    by = F.when(F.col("doc_type") == "bank_statement", F.expr(_line_fields(L.STATEMENT_ANCHORS, L.statement_value, True)).cast(FIELDS))
    by = by.when(F.col("doc_type") == "payment_order", F.expr(_line_fields(L.ORDER_ANCHORS, L.order_value, False)).cast(FIELDS)).otherwise(F.expr(_receipt_fields()).cast(FIELDS))
    if "read" in docs.columns:
        read = F.col("read").isNotNull()
        typed = typed.withColumn("doc_type", F.when(read, "receipt").otherwise(F.col("doc_type"))).withColumn("seen", F.when(read, F.col("read.seen")).otherwise(F.col("seen")))
        by = F.when(read, F.col("read.fields").cast(FIELDS)).otherwise(by)
    return typed.withColumn("fields", by).withColumn("items", F.when(F.col("doc_type") == "bank_statement", F.col("items")).otherwise(F.slice("items", 1, 0)))


def _fixed(x, places: str = "0.00") -> Column:
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit(places))


def _own(name: str) -> Column:
    return F.get(F.filter("fields", lambda f: f.field == name), 0)


def _value(name: str) -> Column:
    return _own(name).getField("value")


def reviewed(docs: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """extracted() with row_reconcile, quality_pass, reasons (in the order of the guards) and needs_review.

    docs may hold a page's blur score and skew; where these are null or missing the page passes. A reason is a missing or unsure field that the kind needs, an implausible date or
    total, a total that may be a subtotal, a skewed page, and of statements: rows that don't reconcile, columns that are missing, a sparse table.
    """
    d = extracted(docs)
    for c in ("blur", "skew"):
        d = d.withColumn(c, (F.col(c) if c in docs.columns else F.lit(None)).cast("double"))
    kind, reasons = F.col("doc_type"), []
    for name, needed in knobs.needed.items():
        for f in needed:
            value, conf = _value(f), F.coalesce(_own(f).getField("confidence"), F.lit(0.0))
            unsure = F.when(conf < knobs.least.get(f, knobs.least_other), F.concat(F.lit(f"low_conf:{f}="), _fixed(conf)))
            reasons.append(F.when(kind == name, F.when(value.isNull(), F.lit(f"missing:{f}")).otherwise(unsure)))
    d = d.withColumn("dt", _value("date")).withColumn("total", F.when(kind == "receipt", _value("total_amount").try_cast("double")))
    flags = F.expr(f"filter(array({L.date_flags(S)}), x -> x IS NOT NULL)")
    after = [F.expr(L.total_flag(S))]
    after.append(F.when((F.col("total") > 0) & (F.col("seen") >= 2.1 * F.col("total")), F.concat(F.lit("total_may_be_subtotal:got="), F.col("total").cast("string"), F.lit(",max_seen="), _fixed("seen"))))
    skewed = (F.abs("skew") > knobs.rotated) & (F.abs("skew") >= knobs.skew)
    after.append(F.when(skewed, F.concat(F.lit("geometry_risk:skew="), _fixed("skew", "0.0"))))
    is_statement = kind == "bank_statement"
    d = d.withColumn("row_reconcile", F.when(is_statement, T.balance_share(F.col("items"), balance("opening_balance")).cast("double")))
    after.append(F.when(F.col("row_reconcile") < knobs.reconciled, F.concat(F.lit("low_table_reconciliation:"), F.col("row_reconcile").cast("string"))))
    after.append(F.when(is_statement & F.col("cols").isNotNull() & ~T.columns_ok(F.col("cols")), F.lit("missing_statement_columns")))
    after.append(F.when(is_statement & (F.size("items") < knobs.few_items) & (F.col("n_rows") >= knobs.many_rows), F.concat(F.lit("sparse_statement_rows:"), F.size("items").cast("string"))))
    known = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    d = d.withColumn("reasons", F.concat(known(reasons), flags, known(after))).withColumn("quality_pass", F.coalesce(F.col("blur") >= knobs.sharp, F.lit(True)).cast("int"))
    return d.withColumn("needs_review", ((F.size("reasons") > 0) | (F.col("quality_pass") == 0)).cast("int")).drop("dt", "total", "stmt", "rcpt", "po")


def review_by_joins(d, quality: str) -> str:
    """The same review as SQL, table by table: the check of reviewed(). quality: SQL of blur and skew by a document's number k. d: the dialect."""
    from ..sources import render

    kinds = {"receipt": L.fields(d), "bank_statement": L.statement_fields(d), "payment_order": L.order_fields(d)}
    fields = " UNION ALL ".join(f"SELECT f.doc_id, '{kind}' AS kind, f.field, f.value, CAST(f.confidence AS DOUBLE) AS confidence FROM ({sql}) f" for kind, sql in kinds.items())
    every = sorted({f for needed in L.NEEDED.values() for f in needed} | {"date"})
    wide = ", ".join(f"max(CASE WHEN field = '{f}' THEN f.value END) AS v_{f}, max(CASE WHEN field = '{f}' THEN f.confidence END) AS c_{f}" for f in every)
    typed = f"SELECT t.doc_id, t.doc_type, {wide} FROM ({L.document_type(d)}) t LEFT JOIN ({fields}) f ON f.doc_id = t.doc_id AND f.kind = t.doc_type GROUP BY t.doc_id, t.doc_type"
    reason = lambda kind, f: f"CASE WHEN doc_type = '{kind}' THEN CASE WHEN v_{f} IS NULL THEN 'missing:{f}' WHEN c_{f} < {L.LEAST.get(f, L.LEAST_OTHER)} THEN 'low_conf:{f}=' || {d.fixed2(f'c_{f}')} END END"
    needed = ", ".join(reason(kind, f) for kind, names in L.NEEDED.items() for f in names)
    words = {c: f"max(CASE WHEN col = '{c}' THEN 1 ELSE 0 END)" for c in L.COLUMNS}
    columns = f"SELECT doc_id, CASE WHEN {words['date']} + {words['description']} + {words['balance']} = 3 AND ({words['amount']} = 1 OR {words['debit']} + {words['credit']} = 2) THEN 1 ELSE 0 END AS ok FROM ({L.header(d)}) h GROUP BY doc_id"
    n_rows = f"SELECT doc_id, max(yrow) + 1 AS n FROM ({L.row_tokens(d, render.statements(d))}) w GROUP BY doc_id"
    n_items = f"SELECT doc_id, count(*) AS n FROM ({L.items(d)}) i GROUP BY doc_id"
    total = "CASE WHEN doc_type = 'receipt' THEN try_cast(v_total_amount AS DOUBLE) END"
    share = "CASE WHEN doc_type = 'bank_statement' THEN coalesce(CAST(row_reconcile AS DOUBLE), 0) END"
    all_reasons = ", ".join([
        needed, L.date_flags(d, "v_date"), L.total_flag(d, f"({total})"), f"CASE WHEN sub_seen IS NOT NULL THEN 'total_may_be_subtotal:got=' || CAST({total} AS STRING) || ',max_seen=' || {d.fixed2('sub_seen')} END",
        f"CASE WHEN abs(skew) > 5 AND abs(skew) >= 8 THEN 'geometry_risk:skew=' || CAST(round(CAST(skew AS DOUBLE), 1) AS STRING) END", f"CASE WHEN {share} < 0.7 THEN 'low_table_reconciliation:' || CAST({share} AS STRING) END",
        "CASE WHEN doc_type = 'bank_statement' AND columns_ok = 0 THEN 'missing_statement_columns' END", "CASE WHEN doc_type = 'bank_statement' AND coalesce(n_items, 0) < 3 AND n_rows >= 6 THEN 'sparse_statement_rows:' || CAST(coalesce(n_items, 0) AS STRING) END",
    ])
    joined = f"""SELECT t.*, s.seen AS sub_seen, r.row_reconcile, c.ok AS columns_ok, i.n AS n_items, w.n AS n_rows, q.blur, q.skew FROM ({typed}) t LEFT JOIN ({L.subtotal(d)}) s ON s.doc_id = t.doc_id LEFT JOIN ({L.reconcile(d)}) r ON r.doc_id = t.doc_id
      LEFT JOIN ({columns}) c ON c.doc_id = t.doc_id LEFT JOIN ({n_items}) i ON i.doc_id = t.doc_id LEFT JOIN ({n_rows}) w ON w.doc_id = t.doc_id JOIN ({quality}) q ON q.doc_id = t.doc_id"""
    return f"SELECT doc_id, doc_type, CASE WHEN reasons <> '' OR quality_pass = 0 THEN 1 ELSE 0 END AS needs_review, quality_pass, reasons, n_items FROM (SELECT doc_id, doc_type, CASE WHEN blur >= 100 THEN 1 ELSE 0 END AS quality_pass, concat_ws(',', {all_reasons}) AS reasons, CAST(CASE WHEN doc_type = 'bank_statement' THEN coalesce(n_items, 0) ELSE 0 END AS INT) AS n_items FROM ({joined}) j) x"
