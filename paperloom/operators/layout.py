"""Layout, extraction and routing operators as SQL over token tables. d is the dialect."""

from __future__ import annotations

from ..functions.normalise import LABELS
from ..functions.normalise import PAYMENT as PAYMENT_WORDS
from ..sources import render

#: Money and date patterns of amounts in tables.
MONEY = "[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]{1,2})?|[0-9]+[.][0-9]{2}|[0-9]{3,}"
DATE = "[0-9]{1,2} *[/.-] *[0-9]{1,2} *[/.-] *[0-9]{2,4}"
#: Keywords of the receipt fields, of table columns, of document kinds and of footers.
ANCHOR_WORDS = {
    "date": ("date", "ngay", "ngày"), "total_amount": ("total", "amount", "sum", "tong cong", "tổng cộng", "thanh tien", "thành tiền", "tong", "tổng"),
    "invoice_id": ("invoice", "bill", "receipt", "no", "hoa don", "hóa đơn", "so hd", "số hđ", "ma gd", "mã gd"),
    "payment_method": ("cash", "card", "qr", "visa", "momo", "tien mat", "tiền mặt", "the", "thẻ", "payment", "chuyen khoan"),
}
#: Keywords with their turn: of a field's keywords in a text the longest counts, of those the first in the list.
ANCHOR_TURNS = sorted(((f, w) for f, words in ANCHOR_WORDS.items() for w in words), key=lambda x: -len(x[1]))
ANCHORS = "(VALUES " + ",".join(f"({k},'{f}','{w}')" for k, (f, w) in enumerate(ANCHOR_TURNS)) + ")"
COLUMNS = {
    "date": ("date", "ngay", "ngày"), "description": ("desc", "description", "dien giai", "diễn giải", "noi dung", "nội dung"), "amount": ("amount", "so tien", "số tiền"),
    "debit": ("debit", "withdrawal", "no", "nợ"), "credit": ("credit", "deposit", "co", "có"), "balance": ("balance", "so du", "số dư"), "ref": ("ref", "soct", "so ct", "số ct"),
}
STATEMENT = ("statement", "sao ke", "sao kê", "balance", "so du", "số dư", "account no", "so tai khoan", "số tài khoản", "opening", "closing")
RECEIPT = ("total", "tong cong", "tổng cộng", "invoice", "hoa don", "hóa đơn", "thanh tien", "thành tiền", "receipt")
ORDER = ("payment order", "uy nhiem chi", "ủy nhiệm chi", "beneficiary", "nguoi huong", "người hưởng", "remitter", "ben chuyen", "to account", "tk huong")
FOOTER = "total|tong|tổng|closing|ending|so du cuoi|số dư cuối|c/f|carried"
FIELDS = "(VALUES ('merchant_name', 0), ('date', 1), ('total_amount', 2), ('invoice_id', 3), ('payment_method', 4))"
#: Least confidence by field, the one of other fields, and the fields that a receipt needs.
LEAST, LEAST_OTHER, REQUIRED = {"date": 0.75, "total_amount": 0.80, "merchant_name": 0.65}, 0.75, ("date", "total_amount")


def money(d, s):
    return f"round(try_cast(replace({d.rx(d.ra(s, DATE, ' '), MONEY)}, ',', '') AS DOUBLE), 2)"


def date(d, s):
    r = d.ra(d.ra(d.rx(s, DATE), " ", ""), "[.-]", "/")
    y = d.part(r, "/", 3)
    return f"CASE WHEN {d.rx(s, DATE)} IS NOT NULL THEN (CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE lpad({y}, 4, '0') END) || '-' || lpad({d.part(r, '/', 2)}, 2, '0') || '-' || lpad({d.part(r, '/', 1)}, 2, '0') END"


def signed(d, s):
    v = f"round(try_cast(replace({d.rx(f'''replace({s}, ' ', '')''', MONEY)}, ',', '') AS DOUBLE), 2)"
    negative = f"((trim({s}) LIKE '(%' AND {s} LIKE '%)%') OR trim({s}) LIKE '-%' OR {d.has(f'upper({s})', '(^|[^A-Z0-9_])DR([^A-Z0-9_]|$)')})"
    return f"CASE WHEN {negative} THEN -{v} ELSE {v} END"


def lines(d, tokens, factor=0.6, h="greatest(ph, 1)"):
    """Gap sessionisation over the y centres, then tokens joined by x."""
    return f"""
    SELECT doc_id, CAST(line AS BIGINT) AS line_idx, {d.agg("nullif(trim(text), '')", 'x0, tok_idx')} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(conf) AS conf, count(*) AS n_tokens FROM (
      SELECT *, sum(CASE WHEN pcy IS NULL OR abs(cy - pcy) <= {factor} * {h} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM (
        SELECT *, lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx) AS pcy, lag(hh) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx) AS ph FROM (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS hh FROM ({tokens}) t0) t1) t2) t3
    GROUP BY doc_id, line"""


#: Payment words and what they stand for.
PAYMENT = tuple((k, LABELS.get(k, k.upper())) for k in PAYMENT_WORDS)


def line_facts(d, tokens=None, more=""):
    """Receipt lines with what every field may need: values, the page's extent and largest amount, and how near an anchor of each field is.

    One pass over the lines of a document: the anchors' centres are gathered by a window (a page has few lines) instead of a self-join.
    """
    if d.name == "spark":
        return f"SELECT doc_id, inline_outer(facts){more} FROM ({pages(d, tokens, more)}) p"
    over = "OVER (PARTITION BY doc_id)"
    pay = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN '{v}'" for k, v in PAYMENT) + " END"
    near = ", ".join(f"coalesce({d.best(f'at_{f}', 'h', 'greatest(0, 1 - (abs(cx - h.cx) + abs(cy - h.cy)) / 1000)')}, 0) AS near_{f}" for f in ANCHOR_WORDS)
    at = ", ".join(f"{d.gather(f'CASE WHEN {says(ANCHOR_WORDS[f])} THEN {d.point()} END', over)} AS at_{f}" for f in ANCHOR_WORDS)
    return f"""
    SELECT *, {near} FROM (
      SELECT *, max(nullif(amt, 0)) {over} AS max_amt, max(y1) {over} AS page_h, max(x1) {over} AS page_w, max(y1 - y0) {over} AS line_h, {at} FROM (
        SELECT *, (y0 + y1) / 2 AS cy, (x0 + x1) / 2 AS cx, lower(text) AS low, {money(d, 'text')} AS amt, {date(d, 'text')} AS dt, {d.rx('upper(text)', '[A-Z]{1,4}[0-9]{3,}')} AS inv, {pay.replace('low', 'lower(text)')} AS pay
        FROM ({lines(d, tokens or render.receipts(d))}) ln) m) g"""


#: Receipt's tokens that a page holds as an array, in the order of lines.
TOKEN = "named_struct('cy', (y0 + y1) / 2, 'tok', tok_idx, 'hh', y1 - y0, 'text', text, 'x0', x0, 'y0', y0, 'x1', x1, 'y1', y1, 'conf', conf)"


def _let(name, value, body):
    """SQL of body with a value found once under a name; a column of an inner SELECT would be found anew by each element of a lambda that names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _read_page(d, tokens, select, body):
    """Spark only: one row a receipt from one grouping of its tokens (of its orders, if these aren't given), with SQL of what its lines say as body.

    body may name ls, the lines; v, their texts and values as arrays by line: low, day, inv, dt, pay, amt; and w, the page's height and largest amount and the centres of each field's anchors.
    A page has few tokens, so all that are expressions over its arrays: no window, no row a token or a line. Values stand in arrays of their own, as an element of a lambda's result is copied whole.
    """
    grouped = f"SELECT doc_id, collect_list({TOKEN}) AS own FROM ({tokens}) t GROUP BY doc_id" if tokens else render.receipt_pages(d)
    near = "get(toks, i - 1).cy IS NULL OR abs(get(toks, i).cy - get(toks, i - 1).cy) <= 0.6 * greatest(get(toks, i - 1).hh, 1)"
    starts = f"filter(sequence(0, size(toks) - 1), i -> i = 0 OR NOT coalesce({near}, FALSE))"
    # most lines have one token, which needs no sorting
    words = "nullif(CASE WHEN size(g) = 1 THEN trim(get(g, 0).text) ELSE array_join(sort_array(transform(g, x -> struct(x.x0, x.tok, nullif(trim(x.text), '') AS w))).w, ' ') END, '')"
    line = f"named_struct('line', n, 'text', {words}, 'x0', array_min(g.x0), 'y0', array_min(g.y0), 'x1', array_max(g.x1), 'y1', array_max(g.y1), 'conf', array_min(g.conf), 'n_tokens', size(g))"
    lines_ = _let("starts", starts, f"transform(starts, (s, n) -> {_let('g', 'slice(toks, s + 1, coalesce(get(starts, n + 1), size(toks)) - s)', line)})")
    low, day = "transform(ls, l -> lower(l.text))", f"transform(ls, l -> translate(regexp_extract(l.text, '{DATE}', 0), '.- ', '//'))"
    inv = "transform(transform(ls, l -> regexp_extract(upper(l.text), '[A-Z]{1,4}[0-9]{3,}', 0)), x -> nullif(x, ''))"
    dt = "transform(u.day, x -> CASE WHEN x <> '' THEN " + _let("p", "split(x, '/')", "(CASE WHEN length(get(p, 2)) = 2 THEN '20' || get(p, 2) ELSE lpad(get(p, 2), 4, '0') END) || '-' || lpad(get(p, 1), 2, '0') || '-' || lpad(get(p, 0), 2, '0')") + " END)"
    # without a date there is nothing to blank; a text that is no number costs try_cast an exception
    bare = f"transform(ls, (l, i) -> regexp_extract(CASE WHEN get(u.day, i) <> '' THEN regexp_replace(l.text, '{DATE}', ' ') ELSE l.text END, '{MONEY}', 0))"
    amt = f"transform({bare}, x -> CASE WHEN x <> '' THEN round(try_cast(replace(x, ',', '') AS DOUBLE), 2) END)"
    pay = "transform(u.low, x -> CASE " + " ".join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in PAYMENT) + " END)"
    said = ", ".join(f"'says_{f}', transform(u.low, x -> {says(words_, 'x')})" for f, words_ in ANCHOR_WORDS.items())
    at = ", ".join(f"'at_{f}', transform(filter(ls, (l, i) -> get(v.says_{f}, i)), l -> named_struct('cx', {CX}, 'cy', {CY}))" for f in ANCHOR_WORDS)
    whole = f"named_struct('max_amt', array_max(filter(v.amt, a -> a <> 0)), 'page_h', array_max(ls.y1), {at})"
    values = f"named_struct('low', u.low, 'inv', u.inv, 'dt', {dt}, 'amt', {amt}, 'pay', {pay}, {said})"
    page = _let("ls", _let("toks", "sort_array(own)", lines_), _let("u", f"named_struct('low', {low}, 'day', {day}, 'inv', {inv})", _let("v", values, _let("w", whole, body))))
    return f"SELECT doc_id, {select.format(page)} FROM ({grouped}) p"


#: A line's centre.
CX, CY = "(l.x0 + l.x1) / 2", "(l.y0 + l.y1) / 2"


def _near(f):
    """SQL of how near an anchor of the field is to line l."""
    return f"coalesce(array_max(transform(w.at_{f}, h -> greatest(0, 1 - (abs({CX} - h.cx) + abs({CY} - h.cy)) / 1000))), 0)"


def pages(d, tokens=None, more=""):
    """Spark only: one row a receipt, with facts, the rows of line_facts() as an array. more: further columns of render.receipt_pages()."""
    own = ", ".join(f"'{c}', l.{c}" for c in "text x0 y0 x1 y1 conf".split())
    values = ", ".join(f"'{c}', get(v.{c}, i)" for c in "low amt dt inv pay".split())
    near = ", ".join(f"'near_{f}', {_near(f)}" for f in ANCHOR_WORDS)
    page = "'max_amt', w.max_amt, 'page_h', w.page_h, 'page_w', e.page_w, 'line_h', e.line_h"
    facts = f"transform(ls, (l, i) -> named_struct('line_idx', CAST(l.line AS BIGINT), {own}, 'n_tokens', CAST(l.n_tokens AS BIGINT), 'cy', {CY}, 'cx', {CX}, {values}, {page}, {near}))"
    extent = "named_struct('page_w', array_max(ls.x1), 'line_h', array_max(transform(ls, x -> x.y1 - x.y0)))"
    return _read_page(d, tokens, "{} AS facts" + more, _let("e", extent, facts))


def best_values(d, tokens=None, more=""):
    """Spark only: for each receipt and field the norm value, score and confidence of the line of the highest score that has a value, the earliest of those that tie. An expression over a page's lines. more: as in pages()."""
    out = []
    for ord_, (f, c) in enumerate((("merchant_name", "low"), ("date", "dt"), ("total_amount", "amt"), ("invoice_id", "inv"), ("payment_method", "pay"))):
        value = f"get(v.{c}, l.line)"
        score = {"merchant_name": f"1 - {CY} / w.page_h", "total_amount": f"0.5 * {_near(f)} + 0.5 * (CASE WHEN {value} = w.max_amt THEN 1 ELSE 0 END)"}.get(f) or f"0.4 + 0.6 * {_near(f)}"
        best = f"array_min(transform(filter(ls, (l, i) -> get(v.{c}, i) IS NOT NULL), l -> named_struct('less', -round(CAST({score} AS DOUBLE), 9), 'line', l.line)))"
        of_best = _let("l", f"get(ls, {best}.line)", f"named_struct('field', '{f}', 'ord', {ord_}, 'value', CAST({value} AS STRING), 'score', CAST({score} AS DOUBLE), 'conf', l.conf)")
        out.append(of_best)
    found = f"array({', '.join(out)})"
    return f"SELECT doc_id, inline_outer(found){more} FROM ({_read_page(d, tokens, '{} AS found' + more, found)}) q"


def by_field(values, other):
    return "CASE f.field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


#: What a line says of a field f.field.
NORM = by_field({"total_amount": "CAST(amt AS STRING)", "date": "dt", "invoice_id": "inv", "payment_method": "pay"}, "low")


def candidates(d, tokens=None, more=""):
    """Receipt lines with norm values and rule scores per field. more: as in pages()."""
    near = by_field({f: f"near_{f}" for f in ANCHOR_WORDS}, "0")
    score = by_field({"merchant_name": "1 - cy / page_h", "total_amount": "0.5 * near_total_amount + 0.5 * (CASE WHEN amt = max_amt THEN 1 ELSE 0 END)"}, f"0.4 + 0.6 * ({near})")
    return f"SELECT doc_id, line_idx, f.field, f.ord, text, conf, {near} AS prox, cy, page_h, {NORM} AS norm, {score} AS score{more} FROM ({line_facts(d, tokens, more)}) m CROSS JOIN {FIELDS} AS f(field, ord)"


def features(d, tokens=None, more=""):
    """The eleven numbers of each candidate (line and field) and its field as five flags. more: further columns as SQL."""
    has = lambda c: f"CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    share = lambda a, b: f"round(CAST({a} AS DOUBLE) / greatest({b}, 1), 6)"
    numbers = {
        "conf": "CAST(conf AS DOUBLE)", "y_share": share("cy", "page_h"), "x_share": share("cx", "page_w"), "height_share": share("y1 - y0", "page_h"),
        "digit_share": share(f"length(text) - length({d.ra('text', '[0-9]', '')})", "length(text)"), "is_money": has(d.has("text", MONEY)), "is_date": has(d.has("text", DATE)), "length_share": "CAST(least(length(text), 40) AS DOUBLE) / 40",
        "is_largest": has("amt IS NOT NULL AND max_amt IS NOT NULL AND amt >= max_amt"), "prox": f"round(CAST({by_field({f: f'near_{f}' for f in ANCHOR_WORDS}, '0')} AS DOUBLE), 6)", "is_tallest": has("y1 - y0 >= line_h - 0.000001"),
    }
    flags = {f"field_{k}": has(f"f.field = '{k}'") for k in ("merchant_name", *ANCHOR_WORDS)}
    return f"SELECT doc_id, line_idx, f.field, {', '.join(f'{v} AS {k}' for k, v in {**numbers, **flags}.items())}{more} FROM ({line_facts(d, tokens)}) m CROSS JOIN {FIELDS} AS f(field, ord)"


def fields(d, tokens=None, more=""):
    """Argmax per field over candidates with a value; the earliest line wins ties. more: as in pages()."""
    first = lambda x: f"min_by(CASE WHEN norm IS NOT NULL THEN {x} END, CASE WHEN norm IS NOT NULL THEN {d.pair('-round(score, 9)', 'line_idx')} END)"
    best = best_values(d, tokens, more) if d.name == "spark" else f"SELECT doc_id, field, ord, {first('norm')} AS value, {first('score')} AS score, {first('conf')} AS conf FROM ({candidates(d, tokens)}) c GROUP BY doc_id, field, ord"
    return f"""
    SELECT doc_id, field, ord, value, CASE WHEN value IS NULL THEN 0 ELSE round(least(1, 0.6 * score + 0.4 * (0.5 * conf + 0.5)), 3) END AS confidence{more} FROM (
      {best}) b"""


def row_tokens(d, tokens):
    """Tokens with cx, cy, their row (yrow, from 0 at the top) and place (pos) among the tokens of the document, row by row from the left."""
    return f"""
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY yrow, x0, cy, tok_idx) AS pos FROM (
      SELECT *, sum(CASE WHEN pcy IS NULL OR abs(cy - pcy) <= 0.7 * greatest(y1 - y0, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS yrow FROM (
        SELECT *, (x0 + x1) / 2 AS cx, lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx) AS pcy FROM (SELECT *, (y0 + y1) / 2 AS cy FROM ({tokens}) t0) t1) t2) t3"""


def names_column(d, text, col):
    """Whether a keyword of the column stands in the text as a whole word."""
    edge = "[^a-z0-9_À-ỹ]"
    return d.has(f"lower({text})", f"(^|{edge})({'|'.join(COLUMNS[col])})({edge}|$)")


def header_rows(d, tokens):
    """The first row of each document that names three columns or more, with the centre of each column's first token (c0, c1, ...; null where it isn't named)."""
    centres = ", ".join(f"min_by(CASE WHEN m{k} THEN cx END, CASE WHEN m{k} THEN pos END) AS c{k}" for k in range(len(COLUMNS)))
    named = ", ".join(f"{names_column(d, 'text', c)} AS m{k}" for k, c in enumerate(COLUMNS))
    count = " + ".join(f"CASE WHEN c{k} IS NULL THEN 0 ELSE 1 END" for k in range(len(COLUMNS)))
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY yrow) AS first FROM (
      SELECT doc_id, yrow, {centres} FROM (SELECT doc_id, yrow, pos, cx, {named} FROM ({row_tokens(d, tokens)}) r) n GROUP BY doc_id, yrow) g WHERE {count} >= 3) f WHERE first = 1"""


def header(d, tokens=None):
    """doc_id, yrow, col, cx of the columns that the header row names, from the left."""
    if d.name == "spark" and tokens is None:
        return "SELECT * FROM statement_columns"
    pick = "CASE k.ord " + " ".join(f"WHEN {k} THEN h.c{k}" for k in range(len(COLUMNS))) + " END"
    names = ", ".join(f"({k}, '{c}')" for k, c in enumerate(COLUMNS))
    return f"SELECT * FROM (SELECT h.doc_id, CAST(h.yrow AS BIGINT) AS yrow, k.col, k.ord, {pick} AS cx FROM ({header_rows(d, tokens or render.statements(d))}) h CROSS JOIN (VALUES {names}) AS k(ord, col)) u WHERE cx IS NOT NULL"


def cells(d, tokens=None):
    """Tokens below the header dealt to columns by their left edge against the midpoints of the header's centres."""
    if d.name == "spark" and tokens is None:
        return "SELECT * FROM statement_cells"
    tokens = tokens or render.statements(d)
    return f"""
    SELECT t.doc_id, CAST(t.yrow AS BIGINT) AS yrow, b.col, trim({d.agg('t.text', 't.pos')}) AS text FROM ({row_tokens(d, tokens)}) t JOIN (
      SELECT doc_id, yrow, col, coalesce((lag(cx) OVER w + cx) / 2, -1e9) AS lo, coalesce((lead(cx) OVER w + cx) / 2, 1e9) AS hi FROM ({header(d, tokens)}) h WINDOW w AS (PARTITION BY doc_id ORDER BY cx, ord)) b
    ON b.doc_id = t.doc_id AND t.yrow > b.yrow AND t.x0 >= b.lo AND t.x0 < b.hi GROUP BY t.doc_id, t.yrow, b.col"""


def items(d, tokens=None):
    """Transactions: rows with a date, without a footer word in the description, and with an amount (else credit less debit) or a balance.

    For Spark the statements' own are those that operators/statements.py finds in one pass; this text is its check.
    """
    if d.name == "spark" and tokens is None:
        return "SELECT * FROM statement_items"
    cell = lambda c: f"coalesce(max(CASE WHEN col = '{c}' THEN text END), '')"
    side = lambda c: f"coalesce({signed(d, c)}, 0)"
    pair = f"CASE WHEN {side('deb')} <> 0 OR {side('cre')} <> 0 THEN abs({side('cre')}) - abs({side('deb')}) END"
    return f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY yrow) AS BIGINT) AS row_idx, date, description, amount, balance FROM (
      SELECT doc_id, yrow, {date(d, 'dt')} AS date, nullif(lower(ds), '') AS description, CASE WHEN am <> '' THEN {signed(d, 'am')} ELSE {pair} END AS amount, {signed(d, 'ba')} AS balance
      FROM (SELECT doc_id, yrow, {cell('date')} AS dt, {cell('description')} AS ds, {cell('amount')} AS am, {cell('debit')} AS deb, {cell('credit')} AS cre, {cell('balance')} AS ba FROM ({cells(d, tokens)}) c GROUP BY doc_id, yrow) g
      WHERE {d.has('dt', '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}')} AND NOT {d.has('lower(ds)', FOOTER)}) i
    WHERE amount IS NOT NULL OR balance IS NOT NULL"""


def all_tokens(d):
    return f"SELECT * FROM ({render.receipts(d)}) a UNION ALL SELECT * FROM ({render.statements(d)}) b UNION ALL SELECT * FROM ({render.payment_orders(d)}) c"


def document_features(d):
    count = lambda kws: " + ".join(f"CAST((length(t) - length(replace(t, '{k}', ''))) / {len(k)} AS BIGINT)" for k in kws)
    money_token = d.has("text", "[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+[.][0-9]{2}")
    return f"""
    SELECT doc_id, {count(STATEMENT)} AS stmt, {count(RECEIPT)} AS rcpt, {count(ORDER)} AS po, n_money / n AS money_share, (1 + gaps) / 20.0 AS row_share, n_money, n / 50.0 AS size, least_conf FROM (
      SELECT doc_id, {d.agg('lower(text)', 'tok_idx')} AS t, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN {money_token} THEN 1 ELSE 0 END) AS DOUBLE) AS n_money, CAST(sum(CASE WHEN cy - pcy > 12 THEN 1 ELSE 0 END) AS DOUBLE) AS gaps, min(CAST(conf AS DOUBLE)) AS least_conf
      FROM (SELECT *, lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, tok_idx) AS pcy FROM (SELECT *, (y0 + y1) / 2 AS cy FROM ({all_tokens(d)}) t0) t1) t2 GROUP BY doc_id) f"""


#: A page with a token below this confidence fails the quality gate.
UNREADABLE = 0.605


def document_type(d):
    return f"SELECT doc_id, stmt, rcpt, po, CASE WHEN stmt >= rcpt AND stmt >= po THEN 'bank_statement' WHEN rcpt >= po THEN 'receipt' ELSE 'payment_order' END AS doc_type, CAST(0.6 AS DOUBLE) AS confidence, CASE WHEN least_conf < {UNREADABLE} THEN 0 ELSE 1 END AS quality_pass FROM ({document_features(d)}) f"


def reasons(d, f="f", required=REQUIRED):
    """SQL of a required field's reason for review, null if there is none, and of its turn. Confidences show two decimals."""
    least = f"CASE {f}.field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items()) + f" ELSE {LEAST_OTHER} END"
    turn = f"CASE {f}.field " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(required)) + " END"
    return f"CASE WHEN {f}.value IS NULL THEN 'missing:' || {f}.field WHEN {f}.confidence < {least} THEN 'low_conf:' || {f}.field || '=' || {d.fixed2(f + '.confidence')} END", turn


def routing(d, fields_sql=None, required=REQUIRED):
    """Required fields against their thresholds; reasons in the required order."""
    reason, turn = reasons(d, required=required)
    names = ", ".join(f"'{r}'" for r in required)
    return f"SELECT doc_id, coalesce({d.agg('reason', 'turn', ',')}, '') AS reasons, max(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) AS needs_review FROM (SELECT f.doc_id, {reason} AS reason, {turn} AS turn FROM ({fields_sql or fields(d)}) f WHERE f.field IN ({names})) r GROUP BY doc_id"


#: Keywords of the fields of statements and payment orders, and the fields that each needs.
STATEMENT_ANCHORS = {
    "account_number": ("account no", "account number", "a/c no", "so tai khoan", "số tài khoản", "stk", "acc no"), "account_holder": ("account holder", "name", "chu tai khoan", "chủ tài khoản", "ten", "tên"),
    "statement_period": ("period", "statement period", "from", "ky sao ke", "kỳ", "tu ngay"), "opening_balance": ("opening balance", "beginning balance", "so du dau", "số dư đầu"),
    "closing_balance": ("closing balance", "ending balance", "so du cuoi", "số dư cuối"),
}
ORDER_ANCHORS = {
    "sender_name": ("remitter", "sender", "nguoi chuyen", "người chuyển", "ben chuyen", "bên chuyển"), "sender_account": ("from account", "debit account", "tk chuyen", "tk nguoi chuyen", "so tk chuyen"),
    "beneficiary_name": ("beneficiary", "payee", "nguoi huong", "người hưởng", "ben huong", "đơn vị hưởng"), "beneficiary_account": ("beneficiary account", "credit account", "tk huong", "tk nguoi huong", "so tk huong", "to account"),
    "amount": ("amount", "so tien", "số tiền"), "content": ("content", "remark", "noi dung", "nội dung", "description"), "date": ("date", "ngay", "ngày"),
}
NEEDED = {"receipt": REQUIRED, "bank_statement": ("account_number", "closing_balance"), "payment_order": ("beneficiary_account", "amount")}
PLAIN_DATE = "[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"


def says(words, low="low"):
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def digits(d, line, least):
    return d.rx(f"replace({line}, ' ', '')", f"[0-9]{{{least},}}")


def statement_value(d, field, line="line"):
    """SQL of what a statement's line says of a field, as text."""
    if field == "account_number":
        return digits(d, line, 8)
    if field == "statement_period":
        dates = d.found(line, PLAIN_DATE)
        return f"CASE WHEN {d.has(line, PLAIN_DATE)} THEN {d.first_two(dates, ' - ')} ELSE trim({d.after_last(line, ':')}) END"
    if field in ("opening_balance", "closing_balance"):
        return d.fixed2(signed(d, line))
    return f"nullif(lower(trim({d.after_last(line, ':')})), '')"


def order_value(d, field, line="line"):
    """SQL of what a payment order's line says of a field, by the kind that its name tells, as text."""
    if "account" in field:
        return digits(d, line, 6)
    if "amount" in field or "balance" in field:
        return d.fixed2(signed(d, line))
    if field == "date":
        return date(d, line)
    return f"nullif(lower(trim(substr({line}, instr({line}, ':') + 1))), '')"


def line_fields(d, tokens, anchors, value, fallback=""):
    """Long form (doc_id, field, value, confidence): the bank's name is the top line, another field what its first line that holds a keyword says. fallback: SQL of an account number of a line, for documents that state none."""
    named = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, min_by(text, CASE WHEN {says(words, 'lower(text)')} THEN line_idx END) AS line, {'min_by(' + fallback + ', CASE WHEN ' + fallback + ' IS NOT NULL THEN line_idx END)' if fallback and f == 'account_number' else 'CAST(null AS STRING)'} AS other FROM ({lines(d, tokens)}) l GROUP BY doc_id" for f, words in anchors.items())
    said = "CASE field " + " ".join(f"WHEN '{f}' THEN {value(d, f)}" for f in anchors) + " END"
    top = f"SELECT doc_id, 'bank_name' AS field, lower(min_by(text, line_idx)) AS value, CAST(0.85 AS DOUBLE) AS confidence FROM ({lines(d, tokens)}) b GROUP BY doc_id"
    return f"{top} UNION ALL SELECT doc_id, field, coalesce(value, other) AS value, CAST(CASE WHEN value IS NOT NULL THEN 0.82 WHEN other IS NOT NULL THEN 0.78 ELSE 0 END AS DOUBLE) AS confidence FROM (SELECT doc_id, field, {said} AS value, other FROM ({named}) n) v"


def statement_fields(d, tokens=None):
    return line_fields(d, tokens or render.statements(d), STATEMENT_ANCHORS, statement_value, digits(d, "text", 8))


def order_fields(d, tokens=None):
    return line_fields(d, tokens or render.payment_orders(d), ORDER_ANCHORS, order_value)


def stated(d):
    """The opening and closing balances that each statement states."""
    of = lambda f: f"max(CASE WHEN field = '{f}' THEN CAST(value AS DOUBLE) END)"
    return f"SELECT doc_id, {of('opening_balance')} AS opening, {of('closing_balance')} AS closing FROM ({statement_fields(d)}) f GROUP BY doc_id"


def reconcile(d, items_sql=None, heads=None):
    """Share of rows whose balance follows from the last known one, and whether the closing balance follows from all."""
    over = "PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    SELECT doc_id, round(avg(CASE WHEN abs(prev + amount - balance) < 1 THEN 1.0 ELSE 0.0 END), 3) AS row_reconcile, CASE WHEN abs(max(opening) + sum(amount) - max(closing)) < 1 THEN 1 ELSE 0 END AS closing_reconcile, count(*) AS n_rows FROM (
      SELECT i.doc_id, i.row_idx, i.amount, i.balance, o.opening, o.closing, coalesce(i.prev, o.opening) AS prev
      FROM (SELECT *, {d.lastnn('balance', over)} AS prev FROM ({items_sql or items(d)}) i0) i JOIN ({heads or stated(d)}) o ON o.doc_id = i.doc_id) x
    GROUP BY doc_id"""


def plausible(d, tokens):
    """Tokens that are amounts of money by themselves: not years, not too small, not beyond a receipt's."""
    return f"SELECT doc_id, tok_idx, CAST(v AS DOUBLE) AS amount FROM (SELECT doc_id, tok_idx, trim(replace(replace(text, ',', ''), ' ', '')) AS v FROM ({tokens}) t) x WHERE {d.has('v', '^[0-9]{1,6}([.][0-9]{1,2})?$')} AND try_cast(v AS DOUBLE) BETWEEN 0.1 AND 50000 AND NOT try_cast(v AS DOUBLE) BETWEEN 1900 AND 2100"


def subtotal(d, fields_sql=None, tokens=None):
    """Receipts whose extracted total is less than half of an amount that is seen: doc_id, total, seen."""
    total = f"SELECT doc_id, try_cast(value AS DOUBLE) AS total FROM ({fields_sql or fields(d)}) f WHERE field = 'total_amount'"
    return f"SELECT s.doc_id, s.total, m.seen FROM ({total}) s JOIN (SELECT doc_id, max(amount) AS seen FROM ({plausible(d, tokens or render.receipts(d))}) a GROUP BY doc_id) m ON m.doc_id = s.doc_id WHERE s.total > 0 AND m.seen >= 2.1 * s.total"


def date_flags(d, value="dt"):
    part = lambda at, n: f"try_cast(substr({value}, {at}, {n}) AS INT)"
    say = lambda name, x, lo, hi: f"CASE WHEN {x} NOT BETWEEN {lo} AND {hi} THEN 'implausible_{name}:' || CAST({x} AS STRING) END"
    return f"{say('year', part(1, 4), 2000, 2035)}, {say('month', part(6, 2), 1, 12)}, {say('day', part(9, 2), 1, 31)}"


def total_flag(d, total="total"):
    said = lambda name: f"'{name}:' || CAST({total} AS STRING)"
    return f"CASE WHEN {total} <= 0 THEN {said('nonpositive_total')} WHEN {total} < 0.5 THEN {said('implausibly_small_total')} WHEN {total} > 50000 THEN {said('implausible_total')} END"


def sanity(d):
    """Why a receipt's values are implausible, with the values, in the order of year, month, day, total and what may be a subtotal."""
    v = lambda f: f"max(CASE WHEN field = '{f}' THEN value END)"
    sub = f"CASE WHEN s.seen IS NOT NULL THEN 'total_may_be_subtotal:got=' || CAST(s.total AS STRING) || ',max_seen=' || {d.fixed2('s.seen')} END"
    return f"SELECT q.doc_id, concat_ws(',', {date_flags(d, 'q.dt')}, {total_flag(d, 'q.total')}, {sub}) AS flags, q.total FROM (SELECT doc_id, {v('date')} AS dt, try_cast({v('total_amount')} AS DOUBLE) AS total FROM ({fields(d)}) f GROUP BY doc_id) q LEFT JOIN ({subtotal(d)}) s ON s.doc_id = q.doc_id"
