"""Statement tables from pages that are one row each.

A page has few tokens, so its rows, header, cells and grid are expressions over its array of tokens (toks): no window, no join, no row a
token. All functions take such pages, or tables of tokens, which are dealt by doc_id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Spark
from ..sources.render import let
from . import layout as L

S = Spark()
#: A table names so many columns at least.
NAMED = 3
ORDS = {c: k for k, c in enumerate(L.COLUMNS)}
TOKEN = ("tok_idx", "text", "x0", "y0", "x1", "y1", "conf")


def pages(tokens: DataFrame) -> DataFrame:
    """A row for each document with its tokens as an array (toks), unless they are that already."""
    if "toks" in tokens.columns:
        return tokens
    return tokens.groupBy("doc_id").agg(F.collect_list(F.struct(*TOKEN)).alias("toks"))


def down(toks: str) -> str:
    """SQL of a page's tokens from the top."""
    return f"sort_array(transform({toks}, x -> struct((x.y0 + x.y1) / 2 AS cy, x.tok_idx AS tok, x.x0 AS x0, (x.x0 + x.x1) / 2 AS cx, x.text AS text, x.y0 AS y0, x.x1 AS x1, x.y1 AS y1, x.conf AS conf)))"


def groups(s: str, near: str) -> str:
    """SQL of the runs of an array s: an element i that isn't near the one before starts a new run."""
    starts = f"filter(sequence(0, size({s}) - 1), i -> i = 0 OR NOT coalesce({near}, FALSE))"
    return let("starts", starts, f"transform(starts, (a, n) -> slice({s}, a + 1, coalesce(get(starts, n + 1), size({s})) - a))")


def _could() -> str:
    """SQL of which columns a token x could name; most tokens are told by one pattern."""
    edge = "[^a-z0-9_À-ỹ]"
    any_word = "|".join(w for words in L.COLUMNS.values() for w in words)
    names = ", ".join(f"CASE WHEN w RLIKE '(^|{edge})({'|'.join(words)})({edge}|$)' THEN {k} END" for k, words in enumerate(L.COLUMNS.values()))
    return let("w", "lower(x.text)", f"CASE WHEN w RLIKE '{any_word}' THEN filter(array({names}), k -> k IS NOT NULL) ELSE CAST(array() AS ARRAY<INT>) END")


def placing(s: str) -> str:
    """SQL of a page's rows from the top (rows: its tokens from the left), the header's row (h, from 0, null without one), its tokens (heads: x0, cx, text, could) and its columns from the left (cols: cx, ord). s: what down() gives."""
    near = f"get({s}, i - 1).cy IS NULL OR abs(get({s}, i).cy - get({s}, i - 1).cy) <= 0.7 * greatest(get({s}, i).y1 - get({s}, i).y0, 1)"
    rows = f"transform({groups(s, near)}, r -> sort_array(transform(r, x -> struct(x.x0 AS x0, x.cy AS cy, x.tok AS tok, x.cx AS cx, x.text AS text, x.y0 AS y0, x.y1 AS y1))))"
    # a row that holds keywords of too few columns is told without a pattern
    said = " + ".join(f"CAST({L.says(words, 'w')} AS INT)" for words in L.COLUMNS.values())
    many = f"coalesce({let('w', 'lower(array_join(get(rows, i).text, chr(10)))', said)} >= {NAMED}, FALSE) AND size(array_distinct(flatten(transform(get(rows, i), x -> {_could()})))) >= {NAMED}"
    heads = f"CASE WHEN h IS NOT NULL THEN transform(get(rows, h), x -> struct(x.x0 AS x0, x.cx AS cx, x.text AS text, {_could()} AS could)) END"
    cols = f"sort_array(filter(array({', '.join(f'struct(get(filter(heads, q -> array_contains(q.could, {k})), 0).cx AS cx, {k} AS ord)' for k in ORDS.values())}), q -> q.cx IS NOT NULL))"
    whole = let("cols", f"CASE WHEN h IS NOT NULL THEN {cols} END", "struct(rows AS rows, h AS h, heads AS heads, cols AS cols)")
    return let("rows", rows, let("h", f"array_min(filter(sequence(0, size(rows) - 1), i -> {many}))", let("heads", heads, whole)))


def dealt(p: str, body: str) -> str:
    """SQL of an array with `body` for each row below the header of a placed page p; null without a header. body names the row's number (y) and its tokens dealt to the column that holds their left edge (own: ord, text)."""
    mids = f"filter(transform(sequence(1, size({p}.cols) - 1), i -> (get({p}.cols, i - 1).cx + get({p}.cols, i).cx) / 2), b -> b IS NOT NULL)"
    own = f"transform(r, x -> struct(get({p}.cols, size(filter(mids, b -> b <= x.x0))).ord AS ord, x.text AS text))"
    below = f"transform(slice({p}.rows, {p}.h + 2, size({p}.rows)), (r, j) -> {let('y', f'CAST({p}.h + 1 + j AS BIGINT)', let('own', own, body))})"
    return f"CASE WHEN {p}.h IS NOT NULL THEN {let('mids', mids, below)} END"


def day(text: str) -> str:
    """The date in a text, as layout.date finds it, by one pattern."""
    year = "split_part(d, '/', 3)"
    return let("d", f"translate(regexp_extract({text}, '{L.DATE}', 0), '.- ', '//')", f"CASE WHEN d <> '' THEN (CASE WHEN length({year}) = 2 THEN '20' || {year} ELSE lpad({year}, 4, '0') END) || '-' || lpad(split_part(d, '/', 2), 2, '0') || '-' || lpad(split_part(d, '/', 1), 2, '0') END")


def amount(text: str) -> str:
    """The amount in a text, as layout.signed finds it, by one pattern."""
    negative = f"((trim({text}) LIKE '(%' AND {text} LIKE '%)%') OR trim({text}) LIKE '-%' OR (contains(upper({text}), 'DR') AND upper({text}) RLIKE '(^|[^A-Z0-9_])DR([^A-Z0-9_]|$)'))"
    value = f"round(try_cast(replace(nullif(regexp_extract(replace({text}, ' ', ''), '{L.MONEY}', 0), ''), ',', '') AS DOUBLE), 2)"
    return let("v", value, f"CASE WHEN v IS NULL THEN v WHEN {negative} THEN -v ELSE v END")


def _transactions(lines: str, at: str) -> str:
    """SQL of the transactions among lines (date, ds, am, deb, cre, ba as texts): at, date, description, amount, balance."""
    kept = f"filter({lines}, l -> l.date RLIKE '{L.PLAIN_DATE}' AND NOT lower(l.ds) RLIKE '{L.FOOTER}')"
    paired = let("m", f"struct(coalesce({amount('l.deb')}, 0) AS de, coalesce({amount('l.cre')}, 0) AS cr)", "CASE WHEN m.de <> 0 OR m.cr <> 0 THEN abs(m.cr) - abs(m.de) END")
    values = f"struct(l.{at} AS {at}, {day('l.date')} AS date, nullif(lower(l.ds), '') AS description, CASE WHEN l.am <> '' THEN {amount('l.am')} ELSE {paired} END AS amount, {amount('l.ba')} AS balance)"
    return f"filter(transform({kept}, l -> {values}), l -> l.amount IS NOT NULL OR l.balance IS NOT NULL)"


ITEM = "array<struct<yrow:bigint,date:string,description:string,amount:double,balance:double>>"
_CELLS = {"date": "date", "description": "ds", "amount": "am", "debit": "deb", "credit": "cre", "balance": "ba"}


def transactions(p: str) -> str:
    """SQL of the transactions (yrow, date, description, amount, balance) of a placed page p, in the order of rows; none without a header."""
    cell = lambda c: f"trim(array_join(filter(own, o -> o.ord = {ORDS[c]}).text, ' '))"
    lines = dealt(p, f"struct(y AS y, {', '.join(f'{cell(c)} AS {a}' for c, a in _CELLS.items())})")
    return f"CAST(coalesce({_transactions(lines, 'y')}, array()) AS {ITEM})"


def placed(tokens: DataFrame) -> DataFrame:
    """pages() with what placing() finds (p)."""
    return pages(tokens).withColumn("p", F.expr(let("s", down("toks"), placing("s"))))


def _each(rows: DataFrame, array: str) -> DataFrame:
    """doc_id and the columns of each element of an array, which is found once; documents where it is null or empty drop out."""
    return rows.select("doc_id", F.expr(f"inline({let('p', 'p', array)})"))


def _name(ord_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in L.COLUMNS]), ord_ + 1)


def header(tokens: DataFrame) -> DataFrame:
    """doc_id, yrow, col, cx, ord of the columns that the header row names."""
    return _each(placed(tokens), "transform(p.cols, q -> struct(CAST(p.h AS BIGINT) AS yrow, q.cx AS cx, q.ord AS ord))").select("doc_id", "yrow", _name(F.col("ord")).alias("col"), "cx", "ord")


def cells(tokens: DataFrame) -> DataFrame:
    texts = "filter(own, o -> o.ord = k AND o.text IS NOT NULL).text"
    joined = let("ts", texts, "CASE WHEN size(ts) > 0 THEN trim(array_join(ts, ' ')) END")
    cell = f"struct(y AS yrow, k AS ord, {joined} AS text)"
    every = f"flatten({dealt('p', f'transform(array_distinct(filter(own, o -> o.ord IS NOT NULL).ord), k -> {cell})')})"
    return _each(placed(tokens), every).select("doc_id", "yrow", _name(F.col("ord")).alias("col"), "text")


def items(tokens: DataFrame) -> DataFrame:
    """Transactions: doc_id, row_idx (from 1), date, description, amount, balance."""
    return _each(placed(tokens), f"transform({transactions('p')}, (i, k) -> struct(CAST(k + 1 AS BIGINT) AS row_idx, i.date AS date, i.description AS description, i.amount AS amount, i.balance AS balance))")


def columns_ok(cols: Column) -> Column:
    """Whether a table has all that a statement needs: date, description, balance, and an amount or both its sides."""
    has = lambda c: F.exists(cols, lambda h: h.ord == ORDS[c])
    return F.coalesce(has("date") & has("description") & has("balance") & (has("amount") | (has("debit") & has("credit"))), F.lit(False))


def balance_share(items_: Column, opening: Column) -> Column:
    """Share of rows whose balance follows from the last known one, to three places; 0 without rows. A page has few rows, so this is a fold over them."""
    start = F.struct(opening.cast("double").alias("prev"), F.lit(0).alias("ok"))

    def step(a: Column, i: Column) -> Column:
        good = F.coalesce(F.abs(a.prev + i.amount - i.balance) < 1, F.lit(False))
        return F.struct(F.coalesce(i.balance, a.prev).alias("prev"), (a.ok + good.cast("int")).alias("ok"))

    ok = F.aggregate(items_, start, step, lambda a: a.ok)
    return F.when(F.size(items_) > 0, F.round(ok / F.size(items_), 3)).otherwise(F.lit(0.0))


def closes(items_: Column, opening: Column, closing: Column) -> Column:
    """1 if the opening balance and all known amounts give the closing one, else 0."""
    amounts = F.filter(F.transform(items_, lambda i: i.amount), lambda a: a.isNotNull())
    total = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(amounts) > 0) & (F.abs(F.round(opening + total, 2) - closing) < 1), 1).otherwise(0)


# ---- the grid of a table


def gridding(p: str) -> str:
    """SQL of the tokens of a placed page p from the header row down (r, c, cx, tok, text), with the row and the column of the table that they are dealt to; null without a header.

    Row boxes are those of the clustered rows, column boxes reach from one header cell to the next. A token goes to the box that holds its
    centre, else to the nearest; of those that tie to the lowest. It can only move to a neighbouring row.
    """
    boxes = f"transform({p}.rows, (r, i) -> struct(CAST(i AS BIGINT) AS k, array_min(r.y0) AS lo, array_max(r.y1) AS hi))"
    columns = f"transform({p}.heads, (q, i) -> struct(CAST(i AS BIGINT) AS k, q.x0 AS lo, coalesce(get({p}.heads, i + 1).x0, q.x0 + 200) - 1 AS hi))"
    own = lambda at, of: f"coalesce(get(filter({of}, b -> {at} BETWEEN b.lo AND b.hi), 0).k, array_min(transform({of}, b -> struct(abs({at} - (b.lo + b.hi) / 2) AS far, b.k AS k))).k)"
    near = f"slice(boxes, greatest(i, {p}.h + 1), CASE WHEN i > {p}.h THEN 3 ELSE 2 END)"
    row = f"transform(get({p}.rows, i), x -> struct({own('x.cy', 'near')} - {p}.h AS r, {own('x.cx', 'columns')} AS c, x.cx AS cx, x.tok AS tok, x.text AS text))"
    every = f"flatten(transform(sequence({p}.h, size({p}.rows) - 1), i -> {let('near', near, row)}))"
    return f"CASE WHEN {p}.h IS NOT NULL THEN {let('boxes', boxes, let('columns', columns, every))} END"


def _cells(p: str) -> str:
    """SQL of the cells (r, c, text, n) of a placed page's grid, row by row."""
    same = "get(g, i - 1).r = get(g, i).r AND get(g, i - 1).c = get(g, i).c"
    cell = "struct(get(q, 0).r AS r, get(q, 0).c AS c, array_join(q.text, ' ') AS text, CAST(size(q) AS BIGINT) AS n)"
    return f"CASE WHEN {p}.h IS NOT NULL THEN {let('g', f'sort_array({gridding(p)})', f'transform({groups("g", same)}, q -> {cell})')} END"


def grid(tokens: DataFrame) -> DataFrame:
    """doc_id, r, c, text, n: the cells of the grid."""
    return _each(placed(tokens), _cells("p"))


def named(heads: Column) -> Column:
    """The column (ord) of each header cell: from the left, a cell takes the first column that it could name and no cell before it has taken; null if there is none."""
    start = F.array().cast("array<int>")

    def take(done: Column, h: Column) -> Column:
        free = F.array_min(F.filter(F.coalesce(h.could, start), lambda k: ~F.array_contains(done, k)))
        return F.concat(done, F.array(F.coalesce(free, F.lit(-1))))

    return F.transform(F.aggregate(heads, start, take), lambda k: F.when(k >= 0, k))


def contaminated(heads: Column) -> Column:
    """Whether a header cell that names a column already holds what a row would: a date, an amount, an account number, a footer word."""

    def bad(h: Column, own: Column) -> Column:
        amount = F.replace(h.text, F.lit(" "), F.lit("")).rlike(L.MONEY)
        kinds = ((("date",), h.text.rlike(L.DATE)), (("amount", "balance", "debit", "credit"), amount), (("ref",), F.replace(h.text, F.lit(" "), F.lit("")).rlike("[0-9]{8,}")), (("description",), F.lower(h.text).rlike(L.FOOTER)))
        out = F.lit(False)
        for names, holds in kinds:
            out = out | (own.isin(*[ORDS[n] for n in names]) & holds)
        return F.coalesce(out, F.lit(False))

    return F.exists(F.zip_with(heads, named(heads), bad), lambda x: x)


def grid_items(tokens: DataFrame) -> DataFrame:
    """Transactions of the grid below its header row, by the columns that the header cells name: doc_id, row_idx, date, description, amount, balance."""
    t = placed(tokens).withColumn("own", named(F.col("p.heads")))
    cell = lambda c: f"coalesce(get(filter(l, x -> get(own, CAST(x.c AS INT)) = {ORDS[c]}), 0).text, '')"
    lines = f"transform({groups('cells', 'get(cells, i - 1).r = get(cells, i).r')}, l -> struct(get(l, 0).r AS row_idx, {', '.join(f'{cell(c)} AS {a}' for c, a in _CELLS.items())}))"
    below = let("own", "own", let("cells", f"filter({_cells('p')}, x -> x.r > 0)", f"CASE WHEN size(cells) > 0 THEN {_transactions(lines, 'row_idx')} END"))
    return _each(t, below)


def rated(p: str) -> str:
    """SQL of the share of a placed table's tokens that its grid holds; null without a header."""
    return let("g", gridding(p), "round(size(filter(g, x -> x.r IS NOT NULL AND x.c IS NOT NULL)) / greatest(size(g), 1), 3)")


def modes(tokens: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, rate (the share of a table's tokens that its grid holds), contaminated, chosen: the grid's reading is taken with a clean header and a rate of `least`."""
    found = f"CASE WHEN p.h IS NOT NULL THEN array(struct({rated('p')} AS rate, p.heads AS heads)) END"
    out = _each(placed(tokens), found).withColumn("contaminated", contaminated(F.col("heads")).cast("int"))
    good = (F.col("contaminated") == 0) & (F.col("rate") >= least)
    return out.select("doc_id", "rate", "contaminated", F.when(good, "structure").otherwise("rules").alias("chosen"))


def head_columns(tokens: DataFrame) -> DataFrame:
    """doc_id, cell, text, col of the header cells that name a column."""
    one = placed(tokens).select("doc_id", F.col("p.heads").alias("heads"))
    both = one.select("doc_id", F.posexplode(F.zip_with("heads", named(F.col("heads")), lambda h, k: F.struct(h.text.alias("text"), k.alias("ord")))).alias("cell", "x")).filter("x.ord is not null")
    return both.select("doc_id", F.col("cell").cast("long").alias("cell"), "x.text", _name(F.col("x.ord")).alias("col"))


def triggers(docs: DataFrame) -> DataFrame:
    """Why a statement's table is not to be trusted: doc_id, reasons. docs: doc_id, n_rows, cols, items, rate and the opening balance that the page states."""
    why = [
        F.when(balance_share(F.col("items"), F.col("opening")) < 0.7, "reconcile"), F.when(~columns_ok(F.col("cols")), "missing_columns"), F.when(F.coalesce("rate", F.lit(0.0)) < 0.75, "assignment"),
        F.when((F.size("items") < 3) & (F.col("n_rows") >= 6), "few_items"),
    ]
    return docs.select("doc_id", F.concat_ws(",", *why).alias("reasons"))
