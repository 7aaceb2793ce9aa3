"""Functions for SQL callers: scalar ones as SQL expressions, table functions in Python for lateral joins.

register(spark) creates them as temporary functions of a session. Scalar functions are inlined into the plan, so they run as built-in
expressions do. The table functions check their arguments in `analyze`:

    split_merged_token(text, x0, x1)   rows part, text, x0, x1: a token that names several kinds of field, cut where they are named
    reply_transactions(reply)          rows row_idx, date, description, amount, balance of a JSON list; entries that aren't objects drop out
    table_grid(TABLE(...))             rows doc_id, r, c, text, n, header: tokens of each document dealt to row and column boxes

table_grid takes doc_id, kind (token, row, column or header), idx, text, x0, y0, x1 and y1, and asks for the rows of a document together.
The scalar grid_cells deals the same way where a document is one row with arrays; it needs neither Python nor a row a token.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.layout import ANCHOR_TURNS
from ..operators.statements import groups
from ..sources.render import let
from . import normalise as N

_DATE, _MONEY = rf"r'{N.DATE}'", rf"r'{N.MONEY}'"
_amount = lambda s: f"round(try_cast(replace(nullif(regexp_extract({s}, {_MONEY}, 0), ''), ',', '') AS DOUBLE), 2)"
_KEYWORDS = " ".join(f"WHEN contains(norm_text(s), '{k}') THEN '{N.LABELS.get(k, k.upper())}'" for k in N.PAYMENT)
_share = lambda rest: f"CASE WHEN length(s) > 0 THEN (length(s) - length({rest})) / length(s) ELSE 0D END"



def _grid() -> str:
    """SQL of grid_cells: tokens by row and column box, then a cell for each run of them."""
    box = lambda at, boxes: f"coalesce(array_min(filter({boxes}, b -> {at} BETWEEN b.lo AND b.hi).idx), array_min(transform({boxes}, b -> struct(abs({at} - (b.lo + b.hi) / 2) AS far, b.idx AS idx))).idx)"
    dealt = f"sort_array(transform(tokens, x -> struct({box('x.y', 'rs')} AS r, {box('x.x', 'cs')} AS c, x.x AS x, x.idx AS idx, coalesce(x.text, '') AS text)))"
    head = "array_max(transform(CASE WHEN header IS NOT NULL THEN rs ELSE slice(rs, 1, 0) END, b -> struct(greatest(0D, least(b.hi, header.hi) - greatest(b.lo, header.lo)) AS share, b.idx AS idx))).idx"
    cell = "struct(get(q, 0).r AS r, get(q, 0).c AS c, array_join(q.text, ' ') AS text, CAST(size(q) AS BIGINT) AS n, CAST(coalesce(get(q, 0).r = hd, FALSE) AS INT) AS header)"
    runs = groups("g", "get(g, i - 1).r = get(g, i).r AND get(g, i - 1).c = get(g, i).c")
    body = let("hd", head, let("g", dealt, f"transform({runs}, q -> {cell})"))
    return let("rs", "row_boxes", let("cs", "column_boxes", f"CASE WHEN size(rs) > 0 AND size(cs) > 0 AND size(tokens) > 0 THEN {body} END"))


_BOXES = "ARRAY<STRUCT<idx: BIGINT, lo: DOUBLE, hi: DOUBLE>>"
#: Signature, type and body of each scalar function; later ones may call earlier ones.
SCALAR = (
    ("norm_text(s STRING)", "STRING", r"lower(trim(regexp_replace(coalesce(s, ''), r'\s+', ' ')))"),
    ("norm_money(s STRING)", "DOUBLE", _amount(f"regexp_replace(coalesce(s, ''), {_DATE}, ' ')")),
    ("date_parts(s STRING)", "ARRAY<STRING>", rf"split(regexp_replace(nullif(regexp_extract(s, {_DATE}, 0), ''), r'\s', ''), '[/.-]')"),
    ("norm_date(s STRING)", "STRING", "CASE WHEN date_parts(s) IS NOT NULL THEN concat_ws('-', CASE WHEN length(date_parts(s)[2]) = 2 THEN '20' || date_parts(s)[2] ELSE lpad(date_parts(s)[2], 4, '0') END, lpad(date_parts(s)[1], 2, '0'), lpad(date_parts(s)[0], 2, '0')) END"),
    ("norm_payment(s STRING)", "STRING", f"CASE {_KEYWORDS} END"),
    ("norm_invoice(s STRING)", "STRING", f"nullif(regexp_extract(upper(coalesce(s, '')), '{N.INVOICE}', 0), '')"),
    ("is_negative(s STRING)", "BOOLEAN", r"(startswith(trim(coalesce(s, '')), '(') AND contains(s, ')')) OR startswith(trim(coalesce(s, '')), '-') OR rlike(upper(coalesce(s, '')), r'(?<![\p{L}\p{N}_])DR(?![\p{L}\p{N}_])')"),
    ("signed_money(s STRING)", "DOUBLE", "CASE WHEN is_negative(s) THEN -1 ELSE 1 END * " + _amount("replace(coalesce(s, ''), ' ', '')")),
    ("account_number(s STRING, least INT DEFAULT 8)", "STRING", "nullif(regexp_extract(replace(s, ' ', ''), '[0-9]{' || least || ',}', 0), '')"),
    ("norm_field(field STRING, s STRING)", "STRING", "CASE field WHEN 'total_amount' THEN CAST(norm_money(s) AS STRING) WHEN 'date' THEN norm_date(s) WHEN 'payment_method' THEN norm_payment(s) WHEN 'invoice_id' THEN norm_invoice(s) ELSE norm_text(s) END"),
    ("kv_value(field STRING, line STRING)", "STRING", "CASE WHEN contains(field, 'account') THEN account_number(line, 6) WHEN contains(field, 'amount') OR contains(field, 'balance') THEN CAST(signed_money(line) AS STRING) WHEN field = 'date' THEN norm_date(line) ELSE nullif(lower(trim(substr(line, instr(line, ':') + 1))), '') END"),
    ("diacritic_ratio(s STRING)", "DOUBLE", _share(f"translate(s, '{N.VN_LETTERS}', '')")),
    ("cjk_ratio(s STRING)", "DOUBLE", _share("regexp_replace(s, '[一-鿿　-〿]', '')")),
    ("cer(pred STRING, gold STRING)", "DOUBLE", "CASE WHEN length(coalesce(gold, '')) = 0 THEN CASE WHEN length(coalesce(pred, '')) = 0 THEN 0D ELSE 1D END ELSE levenshtein(coalesce(pred, ''), gold) / length(gold) END"),
    ("similarity(pred STRING, gold STRING)", "DOUBLE", "1 - levenshtein(coalesce(pred, ''), coalesce(gold, '')) / greatest(length(coalesce(pred, '')), length(coalesce(gold, '')), 1)"),
    ("anls(pred STRING, gold STRING)", "DOUBLE", "CASE WHEN similarity(pred, gold) >= 0.5 THEN similarity(pred, gold) ELSE 0D END"),
    ("exact_match(pred STRING, gold STRING)", "BOOLEAN", "lower(trim(coalesce(pred, ''))) = lower(trim(coalesce(gold, '')))"),
    ("f1_score(tp BIGINT, fp BIGINT, fn BIGINT)", "DOUBLE", "CASE WHEN tp = 0 THEN 0D ELSE round(2D * tp / (2D * tp + fp + fn), 4) END"),
    # bins of predictions: their number, the sum of confidences and how many were right
    ("calibration_error(bins ARRAY<STRUCT<n: BIGINT, confidence: DOUBLE, hits: BIGINT>>)", "DOUBLE", "round(aggregate(bins, 0D, (a, b) -> a + abs(b.confidence - b.hits)) / aggregate(bins, 0L, (a, b) -> a + b.n), 4)"),
    # tokens by their centres; null without tokens, rows or columns
    (f"grid_cells(tokens ARRAY<STRUCT<idx: BIGINT, text: STRING, x: DOUBLE, y: DOUBLE>>, row_boxes {_BOXES}, column_boxes {_BOXES}, header STRUCT<lo: DOUBLE, hi: DOUBLE>)", "ARRAY<STRUCT<r: BIGINT, c: BIGINT, text: STRING, n: BIGINT, header: INT>>", _grid()),
    # cumulative buckets in order; the last is open and gives its lower bound
    ("bucket_of(q DOUBLE, b ARRAY<STRUCT<le: DOUBLE, n: BIGINT>>)", "INT", "array_position(transform(b, x -> x.n >= q * element_at(b, -1).n), true)"),
    ("bucket_from(k INT, b ARRAY<STRUCT<le: DOUBLE, n: BIGINT>>)", "STRUCT<le: DOUBLE, n: BIGINT>", "coalesce(get(b, k - 2), named_struct('le', 0D, 'n', 0L))"),
    ("histogram_quantile(q DOUBLE, b ARRAY<STRUCT<le: DOUBLE, n: BIGINT>>)", "DOUBLE", "CASE WHEN element_at(b, -1).n = 0 THEN NULL WHEN bucket_of(q, b) = size(b) THEN bucket_from(size(b), b).le ELSE bucket_from(bucket_of(q, b), b).le + (b[bucket_of(q, b) - 1].le - bucket_from(bucket_of(q, b), b).le) * (q * element_at(b, -1).n - bucket_from(bucket_of(q, b), b).n) / (b[bucket_of(q, b) - 1].n - bucket_from(bucket_of(q, b), b).n) END"),
)


def _want(name: str, given: list[AnalyzeArgument], types: tuple) -> None:
    if len(given) != len(types) or not all(isinstance(g.dataType, t) or g.dataType.typeName() == "void" for g, t in zip(given, types)):
        raise ValueError(f"{name} takes {', '.join(t.__name__.removesuffix('Type').lower() for t in types)}")


class SplitMergedToken:
    """Tokens of eight characters or more that name two kinds of field are cut where a kind is named past the fourth character.

    A kind stands where the longest of its keywords in the text first occurs. Boxes are cut in proportion to characters, blank parts drop out.
    """

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        _want("split_merged_token", list(given), (StringType, DoubleType, DoubleType))
        return AnalyzeResult(StructType().add("part", LongType()).add("text", StringType()).add("x0", DoubleType()).add("x1", DoubleType()))

    def eval(self, text: str, x0: float, x1: float):
        text, at = text or "", {}
        low = text.lower()
        if len(text) >= 8:
            for field, word in ANCHOR_TURNS:
                if field not in at and (place := low.find(word)) >= 0:
                    at[field] = place
        cuts = sorted({k for k in at.values() if k > 3}) if len(at) > 1 else []
        edges, n = [0, *cuts, len(text)], max(len(text), 1)
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip() or not text]
        for part, (a, b) in enumerate(parts or [(0, len(text))], 1):
            if x0 is None or x1 is None:
                yield part, text[a:b].strip(), None, None
            else:
                yield part, text[a:b].strip(), x0 + max(x1 - x0, 1) * a / n, x0 + max(x1 - x0, 1) * b / n if text else x1


def _day(s: str) -> str | None:
    if not (found := re.search(N.DATE, s)):
        return None
    d, m, y = re.split("[/.-]", re.sub(r"\s", "", found.group()))
    return f"{'20' + y if len(y) == 2 else y.zfill(4)}-{m.zfill(2)}-{d.zfill(2)}"


def _signed(s: str) -> float | None:
    s = s.strip()
    if not (found := re.search(N.MONEY, s.replace(" ", ""))):
        return None
    minus = (s.startswith("(") and ")" in s) or s.startswith("-") or re.search(r"(?<!\w)DR(?!\w)", s.upper())
    return round(float(found.group().replace(",", "")), 2) * (-1 if minus else 1)


class ReplyTransactions:
    """The objects of a JSON list, typed; a reply that isn't such a list gives no rows."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        _want("reply_transactions", list(given), (StringType,))
        schema = StructType().add("row_idx", IntegerType()).add("date", StringType()).add("description", StringType())
        return AnalyzeResult(schema.add("amount", DoubleType()).add("balance", DoubleType()))

    def eval(self, reply: str):
        try:
            rows = json.loads(reply or "")
        except ValueError:
            return
        text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x)
        for k, t in enumerate([t for t in rows if isinstance(t, dict)] if isinstance(rows, list) else [], 1):
            yield k, _day(text(t.get("date"))), text(t.get("description")).lower() or None, _signed(text(t.get("amount"))), _signed(text(t.get("balance")))


class TableGrid:
    """Deals a document's tokens to the row and the column whose box holds their centre, else to the nearest; of those that tie to the lowest.

    The header is the row that overlaps the header box most, the lowest on the page of those that tie; without a header box there is none.
    """

    _COLUMNS = ("doc_id", "kind", "idx", "text", "x0", "y0", "x1", "y1")

    def __init__(self):
        self.doc, self.tokens, self.rows, self.columns, self.head = None, [], [], [], None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        names = getattr(rows.dataType, "names", None)
        if not rows.isTable or not set(TableGrid._COLUMNS) <= set(names or ()):
            raise ValueError(f"table_grid takes TABLE(...) with the columns {', '.join(TableGrid._COLUMNS)}")
        schema = StructType().add("doc_id", rows.dataType["doc_id"].dataType).add("r", LongType()).add("c", LongType()).add("text", StringType()).add("n", LongType()).add("header", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("kind"), OrderingColumn("idx")])

    def eval(self, row):
        self.doc = row["doc_id"]
        if row["kind"] == "token":
            self.tokens.append(((row["x0"] + row["x1"]) / 2, row["idx"], (row["y0"] + row["y1"]) / 2, row["text"]))
        elif row["kind"] == "row":
            self.rows.append((row["idx"], row["y0"], row["y1"]))
        elif row["kind"] == "column":
            self.columns.append((row["idx"], row["x0"], row["x1"]))
        elif row["kind"] == "header":
            self.head = (row["y0"], row["y1"])

    def terminate(self):
        box = lambda at, boxes: min(boxes, key=lambda b: (not b[1] <= at <= b[2], 0 if b[1] <= at <= b[2] else abs(at - (b[1] + b[2]) / 2), b[0]))[0]
        if not self.rows or not self.columns:
            return
        header = None
        if self.head:
            header = max((max(0.0, min(hi, self.head[1]) - max(lo, self.head[0])), k) for k, lo, hi in self.rows)[1]
        cells: dict = {}
        for cx, _, cy, text in sorted(self.tokens, key=lambda t: t[:2]):
            cells.setdefault((box(cy, self.rows), box(cx, self.columns)), []).append(text or "")
        for (r, c), texts in sorted(cells.items()):
            yield self.doc, r, c, " ".join(texts), len(texts), int(r == header)


TABLE_FUNCTIONS = {"split_merged_token": SplitMergedToken, "reply_transactions": ReplyTransactions, "table_grid": TableGrid}


def register(spark: SparkSession) -> list[str]:
    """Creates all functions in the session; returns their names."""
    for signature, kind, body in SCALAR:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for name, cls in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
    return [signature.split("(")[0] for signature, _, _ in SCALAR] + list(TABLE_FUNCTIONS)
