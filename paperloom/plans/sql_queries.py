"""Queries in SQL alone, over the functions that functions/catalog.py registers. Their checks call none of these functions."""

from __future__ import annotations

from ..functions import catalog
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import statements as ST
from ..operators import structure as T
from ..sources import render as R
from ..sources.render import let
from .dialect import Duck, Spark, run

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}

D, S = Duck(), Spark()


def sql(name: str, covers: str, text: str, oracle: str) -> None:
    def query(spark, sf_dir):
        catalog.register(spark)
        return run(spark, sf_dir, text)

    QUERIES[name], ORACLE[name], COVERS[name] = query, oracle, covers


def messy(d):
    return f"SELECT doc_id, tok_idx, text FROM ({L.all_tokens(d)}) t"


_PAYMENT = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in L.PAYMENT) + " END"
sql(
    "sql_normalised", "N1 N2 N4 N5 N7 N8",
    f"SELECT doc_id, tok_idx, norm_money(text) AS money, norm_date(text) AS day, signed_money(text) AS amount, norm_payment(text) AS method, norm_invoice(text) AS invoice, account_number(text, 6) AS account FROM ({messy(S)}) m",
    f"SELECT doc_id, tok_idx, {L.money(D, 'text')} AS money, {L.date(D, 'text')} AS day, {L.signed(D, 'text')} AS amount, {_PAYMENT} AS method, {D.rx('upper(text)', '[A-Z]{1,4}[0-9]{3,}')} AS invoice, {D.rx('''replace(text, ' ', '')''', '[0-9]{6,}')} AS account FROM ({messy(D)}) m",
)
sql(
    "sql_text_scores", "A1 A2 A3 N24",
    f"SELECT item_id, round(cer(pred, gold), 6) AS cer, round(similarity(pred, gold), 6) AS similarity, round(anls(pred, gold), 6) AS anls, CASE WHEN exact_match(pred, gold) THEN 1 ELSE 0 END AS exact FROM ({E.pairs(S)}) p",
    E.text_scores(D),
)
sql(
    "sql_field_f1", "A4", f"SELECT field, f1_score(tp, fp, fn) AS f1 FROM ({E.counts(S)}) c",
    f"SELECT field, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM ({E.counts(D)}) c",
)
_SCORED = lambda d: f"SELECT greatest(CAST(ceil(confidence * 10) AS INT) - 1, 0) AS bin, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN pred = gold THEN 1 ELSE 0 END AS hit FROM ({E.gold_fields(d)}) g WHERE pred IS NOT NULL AND gold IS NOT NULL"
sql(
    "sql_calibration", "A5",
    f"SELECT calibration_error(collect_list(named_struct('n', n, 'confidence', confidence, 'hits', hits))) AS ece FROM (SELECT bin, count(*) AS n, sum(confidence) AS confidence, CAST(sum(hit) AS BIGINT) AS hits FROM ({_SCORED(S)}) s GROUP BY bin) b",
    f"SELECT round(sum(abs(c - h) * n) / sum(n), 4) AS ece FROM (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS h FROM ({_SCORED(D)}) s GROUP BY bin) b",
)
sql(
    "sql_quantiles", "M3 M9 M12",
    f"SELECT w, round(histogram_quantile(0.95D, b), 6) AS p95, round(histogram_quantile(0.5D, b), 6) AS p50 FROM (SELECT w, transform(array_sort(collect_list(struct(i, le, n))), x -> named_struct('le', x.le, 'n', x.n)) AS b FROM ({E.histogram(S)}) h GROUP BY w) g",
    f"SELECT a.w, a.value AS p95, b.value AS p50 FROM ({E.quantile(D, 0.95)}) a JOIN ({E.quantile(D, 0.5)}) b ON b.w = a.w",
)
sql(
    "sql_split_tokens", "L5",
    f"SELECT t.doc_id, t.tok_idx, p.part, p.text, round(p.x0, 4) AS x0, round(p.x1, 4) AS x1, t.conf FROM ({T.merged_tokens(S)}) t, LATERAL split_merged_token(t.text, t.x0, t.x1) p",
    T.split_merged(D, T.merged_tokens(D)),
)
#: The ledger's transactions as JSON lists, one a page, with entries that aren't objects at the end.
REPLIES = f"SELECT doc_id, '[' || listagg(to_json(named_struct('date', date_format(t, 'dd/MM/yyyy'), 'description', description, 'amount', format_number(amount, 2), 'balance', format_number(balance, 2))), ', ') WITHIN GROUP (ORDER BY row_idx) || ', null, 7]' AS reply FROM ({R.ledger(S)}) l GROUP BY doc_id"
sql(
    "sql_transactions", "N16 D6",
    f"SELECT r.doc_id, p.row_idx, p.date, p.description, p.amount, p.balance FROM ({REPLIES}) r, LATERAL reply_transactions(r.reply) p",
    f"SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, date, lower(description) AS description, amount, balance FROM ({R.ledger(D)}) l",
)
#: Statements with their rows and header, one row a page.
_PLACED = f"SELECT doc_id, {let('s', ST.down('toks'), ST.placing('s'))} AS p FROM ({R.statement_pages(S)}) o"
_BELOW = "slice(p.rows, p.h + 1, size(p.rows))"
sql(
    "sql_grid", "L14 L16",
    f"""
    SELECT doc_id, inline(filter(cells, x -> x.n > 0)) FROM (SELECT doc_id, grid_cells(
      transform(flatten({_BELOW}), x -> struct(CAST(x.tok AS BIGINT) AS idx, x.text AS text, x.cx AS x, x.cy AS y)),
      transform({_BELOW}, (r, i) -> struct(CAST(i AS BIGINT) AS idx, array_min(r.y0) AS lo, array_max(r.y1) AS hi)),
      transform(p.heads, (h, i) -> struct(CAST(i AS BIGINT) AS idx, h.x0 AS lo, coalesce(get(p.heads, i + 1).x0, h.x0 + 200) - 1 AS hi)),
      struct(array_min(get(p.rows, p.h).y0) AS lo, array_max(get(p.rows, p.h).y1) AS hi)) AS cells FROM ({_PLACED}) q) c""",
    f"SELECT doc_id, r, c, text, n, CASE WHEN r = 0 THEN 1 ELSE 0 END AS header FROM ({T.grid(D)}) g",
)
