"""Token tables of three kinds of documents, rendered by arithmetic from the star schema.

Each builder returns SQL for (doc_id, tok_idx, text, x0, y0, x1, y1, conf); d is the dialect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scan import Count, Sum, scan

#: Heading lines of the statements and their footer, by language: English, Vietnamese without and with accents.
HEADING = (
    ("", "", ""), ("ACCOUNT STATEMENT", "SAO KE TAI KHOAN", "SAO KÊ TÀI KHOẢN"), ("Account No", "So tai khoan", "Số tài khoản"), ("Account Holder", "Chu tai khoan", "Chủ tài khoản"),
    ("Statement Period", "Ky sao ke", "Kỳ sao kê"), ("Opening Balance", "So du dau", "Số dư đầu"), ("Closing Balance", "So du cuoi", "Số dư cuối"),
)
FOOT = ("Total", "Tong", "Tổng")
#: Columns of the three table layouts: kind, left edge.
LAYOUTS = (
    (("date", 40), ("description", 220), ("amount", 560), ("balance", 760)),
    (("date", 40), ("description", 220), ("debit", 480), ("credit", 640), ("balance", 800)),
    (("ref", 40), ("date", 160), ("description", 320), ("amount", 600), ("balance", 780)),
)
#: Header words of a kind of column, by language.
TITLES = {
    "date": ("Date", "Ngay", "Ngày"), "description": ("Description", "Dien giai", "Diễn giải"), "amount": ("Amount", "So tien", "Số tiền"), "debit": ("Debit", "No", "Nợ"), "credit": ("Credit", "Co", "Có"),
    "balance": ("Balance", "So du", "Số dư"), "ref": ("Ref", "SoCT", "Số CT"),
}


def _slots() -> str:
    """What a transaction prints: its cells; the first of a page also the heading and the table's header, the last the footer."""
    rows = []
    for k, columns in enumerate(LAYOUTS):
        rows += [(k, "line", n, 40, f"line{n}", *words) for n, words in enumerate(HEADING)]
        rows += [(k, "head", n, x, kind, *TITLES[kind]) for n, (kind, x) in enumerate(columns)]
        rows += [(k, "cell", n, x, kind, "", "", "") for n, (kind, x) in enumerate(columns)]
        rows += [(k, "foot", 0, 40, "total", *FOOT), (k, "foot", 1, 790, "closing", "", "", "")]
    return "(VALUES " + ", ".join(f"({k}, '{part}', {n}, {x}, '{kind}', '{en}', '{vi}', '{accented}')" for k, part, n, x, kind, en, vi, accented in rows) + ") AS k(layout, part, place, x, kind, en, vi, accented)"


#: Transactions on a page of a statement; every page is a document of its own.
PAGE = 12


def _receipt_token(d, k="k", c="c", t="t", ln="ln") -> dict[str, str]:
    """SQL of a receipt's token by the order's k, c, t and the token's number ln. Every second receipt writes its total's label with accents, every fourth its date's, every eighth its payment."""
    total = f"CASE WHEN {k} % 11 = 0 THEN {d.commas(f'{k} % 90 + 10')} || '.50' ELSE {d.commas(f'({k} % 300 + 20) * 1000')} END"
    text = f"""CASE {ln} WHEN 0 THEN 'CUA HANG SO ' || CAST({c} % 97 AS STRING)
        WHEN 1 THEN 'Invoice No: HD' || lpad(CAST({k} % 10000 AS STRING), 4, '0')
        WHEN 2 THEN CASE WHEN {k} % 9 = 0 THEN 'Counter 4' ELSE CASE WHEN {k} % 4 = 1 THEN 'Ngày: ' ELSE 'Date: ' END || {d.dmy(t)} END
        WHEN 3 THEN CASE WHEN {k} % 11 = 0 THEN '' ELSE 'Item A ' END || {d.commas(f'({k} % 50 + 1) * 100')}
        WHEN 4 THEN CASE WHEN {k} % 2 = 1 THEN 'TỔNG CỘNG:' ELSE 'TONG CONG:' END WHEN 5 THEN {total}
        ELSE 'Payment: ' || CASE {k} % 4 WHEN 0 THEN 'QR Pay' WHEN 1 THEN 'VISA' WHEN 2 THEN CASE WHEN {k} % 8 = 2 THEN 'tiền mặt' ELSE 'tien mat' END ELSE 'Momo' END END"""
    at = f"34 * CASE WHEN {ln} >= 5 THEN {ln} - 1 ELSE {ln} END + CASE WHEN {ln} = 5 THEN {k} % 5 ELSE 0 END"
    return {
        "text": text, "x0": f"CAST(CASE WHEN {ln} = 5 THEN 300 ELSE 40 END AS DOUBLE)", "y0": f"CAST(20 + {at} AS DOUBLE)", "x1": f"CAST(CASE WHEN {ln} = 5 THEN 420 ELSE 260 END AS DOUBLE)",
        "y1": f"CAST(40 + {at} AS DOUBLE)", "conf": f"CAST(60 + ({k} * 7 + {ln} * 13) % 40 AS DOUBLE) / 100",
    }


_ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t FROM orders"


def receipts(d) -> str:
    """A row for each token of the receipts."""
    columns = ", ".join(f"{v} AS {c}" for c, v in _receipt_token(d).items())
    return f"SELECT 'r' || CAST(k AS STRING) AS doc_id, ln AS tok_idx, {columns} FROM ({_ORDERS}) o CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS l(ln)"


def receipt_pages(d) -> str:
    """Spark only: one row a receipt with its orders (k, c, t), which alone are dealt, and the same tokens as an array (own) with their centre and height. An order that comes twice gives its tokens twice.

    A token's number is written out, so what the others print falls away while planning.
    """
    token = lambda n, v: f"named_struct('cy', ({v['y0']} + {v['y1']}) / 2, 'tok', {n}, 'hh', {v['y1']} - {v['y0']}, " + ", ".join(f"'{c}', {sql}" for c, sql in v.items()) + ")"
    printed = lambda o: f"array({', '.join(token(n, _receipt_token(d, f'{o}.k', f'{o}.c', f'{o}.t', str(n))) for n in range(7))})"
    # what an order prints is compiled, but not within a lambda, which only receipts of several orders need
    own = f"CASE WHEN size(orders) = 1 THEN {printed('get(orders, 0)')} ELSE flatten(transform(orders, o -> {printed('o')})) END"
    return f"SELECT doc_id, orders, {own} AS own FROM (SELECT doc_id, collect_list(struct(k, c, t)) AS orders FROM (SELECT 'r' || CAST(k AS STRING) AS doc_id, k, c, t FROM ({_ORDERS}) o) n GROUP BY doc_id) g"


def running(d) -> str:
    """Orders as transactions c, k, t, a with their number r within the customer and the sum of amounts up to them; Spark reads them from the view that running_orders() makes."""
    over = "PARTITION BY c ORDER BY t, k"
    if d.name == "spark":
        return "SELECT * FROM running_orders"
    return f"SELECT *, row_number() OVER ({over}) AS r, sum(a) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM ({AMOUNTS}) x"


AMOUNTS = "SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS t, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 900 + 100) * 1000 AS a FROM orders"


def running_orders(amounts):
    """By a prefix scan over AMOUNTS, so that a customer with many orders is split over tasks."""
    return scan(amounts, ["c"], ["t", "k"], [Count("r"), Sum("a", "total")], spread=F.unix_date(F.to_date("t")))


def ledger(d) -> str:
    """Transactions behind the statements, one document a page: doc_id, row_idx (of n), date, description, amount, balance, opening and closing (of the page)."""
    page = "(PARTITION BY c, page ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
    SELECT 's' || CAST(c AS STRING) || '.' || CAST(page AS STRING) AS doc_id, c, k, page, CAST(r - page * {PAGE} AS INT) AS row_idx, {d.ymd('t')} AS date, t, 'Transfer ' || CAST(k AS STRING) AS description, CAST(a AS DOUBLE) AS amount,
      CAST(balance AS DOUBLE) AS balance, CAST(first_value(balance - a) OVER {page} AS DOUBLE) AS opening, CAST(last_value(balance) OVER {page} AS DOUBLE) AS closing, min(t) OVER {page} AS since, max(t) OVER {page} AS until, count(*) OVER {page} AS n
    FROM (SELECT *, CAST(floor((r - 1) / {PAGE}) AS INT) AS page, (c % 50 + 10) * 100000 + total AS balance FROM ({running(d)}) x) y"""


def _statement_texts(d, row="", page="") -> tuple[str, dict[str, str]]:
    """SQL of what a slot k prints, by its part: headings and the table's header, cells, the footer. row, page: what stands before the columns of a transaction and of a page."""
    plain = lambda v: f"CASE WHEN {v} < 0 THEN '-' || {d.commas('-' + v)} ELSE {d.commas(v)} END"
    amount, c = f"{row}amount", f"{page}c"
    signed = f"CASE WHEN {amount} < 0 THEN CASE {c} % 5 WHEN 0 THEN '(' || {d.commas(f'-{amount}')} || ')' WHEN 1 THEN {d.commas(f'-{amount}')} || ' DR' ELSE '-' || {d.commas(f'-{amount}')} END ELSE {d.commas(amount)} || CASE WHEN {c} % 5 = 1 THEN ' CR' ELSE '' END END"
    word = f"CASE {c} % 4 WHEN 0 THEN k.en WHEN 1 THEN k.vi ELSE k.accented END"
    foot = f"CASE k.place WHEN 0 THEN {word} ELSE {plain(f'{page}closing')} END"
    line = f"""CASE k.place WHEN 0 THEN 'ACME BANK' WHEN 1 THEN {word} WHEN 2 THEN {word} || ': ' || lpad(CAST({c} AS STRING), 10, '7') WHEN 3 THEN {word} || ': Customer ' || CAST({c} AS STRING)
          WHEN 4 THEN {word} || ': ' || CASE WHEN {c} % 6 = 5 THEN 'all of it' ELSE {d.dmy(f'{page}since')} || ' - ' || {d.dmy(f'{page}until')} END WHEN 5 THEN {word} || ': ' || {plain(f'{page}opening')} ELSE {word} || ': ' || {plain(f'{page}closing')} END"""
    cell = f"""WHEN k.kind = 'date' THEN {d.dmy(f'{row}t')} WHEN k.kind = 'description' THEN {row}description WHEN k.kind = 'ref' THEN 'CT' || CAST(l.k % 900 + 100 AS STRING) WHEN k.kind = 'amount' THEN {signed}
        WHEN k.kind = 'debit' THEN CASE WHEN {amount} < 0 THEN {d.commas(f'-{amount}')} END WHEN k.kind = 'credit' THEN CASE WHEN {amount} > 0 THEN {d.commas(amount)} END ELSE {plain(f'{row}balance')} END"""
    return word, {"line": line, "foot": foot, "cell": cell}


def statements(d) -> str:
    """Three table layouts, two languages (one with and without accents), three ways to write a debit, jittered cells, and a footer row below each table. One pass over the ledger."""
    if d.name == "spark":
        return f"SELECT doc_id, inline_outer(toks) FROM ({statement_pages(d)}) p"
    word, part = _statement_texts(d)
    text = f"""CASE WHEN k.part = 'head' THEN {word} WHEN k.part = 'foot' THEN {part['foot']}
        WHEN k.part = 'line' THEN {part['line']}
        {part['cell']}"""
    y = "CASE k.part WHEN 'line' THEN 20 + 36 * k.place WHEN 'head' THEN 300 + (c + k.place) % 4 WHEN 'cell' THEN 300 + 36 * row_idx + (c * row_idx) % 3 + (l.k + k.place) % 4 ELSE 308 + 36 * (n + 1) END"
    return f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0) - 1 AS INT) AS tok_idx, text, x0, y0, x0 + 100 AS x1, y0 + 20 AS y1, 0.9 + CAST(c % 10 AS DOUBLE) / 100 AS conf FROM (
      SELECT l.doc_id, l.c, CAST(k.x + CASE k.part WHEN 'cell' THEN (l.k * 7 + k.place * 5) % 13 - 4 ELSE 0 END AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0, {text} AS text
      FROM (SELECT *, c % 3 AS layout FROM ({ledger(d)}) l0) l JOIN {_slots()} ON k.layout = l.layout WHERE k.part = 'cell' OR (k.part = 'foot' AND row_idx = n) OR (k.part <> 'foot' AND row_idx = 1)) t WHERE text IS NOT NULL"""


def let(name, value, body):
    """SQL of body with a value found once under a name; a column of an inner SELECT would be found anew by each element of a lambda that names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def statement_pages(d) -> str:
    """Spark only: the same tokens as an array (toks, in their order) a page, and its transactions (gold: row_idx, date, description, amount). What is dealt by page are its transactions, not its tokens."""
    word, text = _statement_texts(d, "l.", "p.")
    layout = lambda rows: "CASE p.layout " + " ".join(f"WHEN {k} THEN array({', '.join(rows(columns))})" for k, columns in enumerate(LAYOUTS)) + " END"
    heads = layout(lambda columns: [f"struct({n} AS place, {x} AS x, '{TITLES[kind][0]}' AS en, '{TITLES[kind][1]}' AS vi, '{TITLES[kind][2]}' AS accented)" for n, (kind, x) in enumerate(columns)])
    cells = layout(lambda columns: [f"struct({n} AS place, {x} AS x, '{kind}' AS kind)" for n, (kind, x) in enumerate(columns)])
    lines = ", ".join(f"struct({n} AS place, 40 AS x, '{en}' AS en, '{vi}' AS vi, '{accented}' AS accented)" for n, (en, vi, accented) in enumerate(HEADING))
    foot = ", ".join(f"struct({n} AS place, {x} AS x, '{FOOT[0]}' AS en, '{FOOT[1]}' AS vi, '{FOOT[2]}' AS accented)" for n, x in enumerate((40, 790)))
    token = lambda y, text, x="k.x": f"struct(CAST({y} AS DOUBLE) AS y0, CAST({x} AS DOUBLE) AS x0, {text} AS text)"
    printed = f"""concat(transform(array({lines}), k -> {token('20 + 36 * k.place', text['line'])}), transform({heads}, k -> {token('300 + (p.c + k.place) % 4', word)}),
      flatten(transform(g, l -> transform({cells}, k -> {token('300 + 36 * l.row_idx + (p.c * l.row_idx) % 3 + (l.k + k.place) % 4', 'CASE ' + text['cell'], 'k.x + (l.k * 7 + k.place * 5) % 13 - 4')}))),
      transform(array({foot}), k -> {token('308 + 36 * (p.n + 1)', text['foot'])}))"""
    toks = f"transform(sort_array(filter({printed}, x -> x.text IS NOT NULL)), (x, i) -> struct(i AS tok_idx, x.text AS text, x.x0 AS x0, x.y0 AS y0, x.x0 + 100 AS x1, x.y0 + 20 AS y1, 0.9 + CAST(p.c % 10 AS DOUBLE) / 100 AS conf))"
    gold = f"transform(g, l -> struct(l.row_idx AS row_idx, {d.ymd('l.t')} AS date, l.description AS description, l.amount AS amount))"
    rows = f"transform(sort_array(own), x -> struct(CAST(x.r - page * {PAGE} AS INT) AS row_idx, x.k AS k, x.t AS t, 'Transfer ' || CAST(x.k AS STRING) AS description, CAST(x.a AS DOUBLE) AS amount, CAST(x.balance AS DOUBLE) AS balance, CAST(x.balance - x.a AS DOUBLE) AS before))"
    about = "struct(c AS c, c % 3 AS layout, size(g) AS n, get(g, 0).before AS opening, element_at(g, -1).balance AS closing, array_min(g.t) AS since, array_max(g.t) AS until)"
    return f"""
    SELECT doc_id, p.toks AS toks, p.gold AS gold FROM (SELECT 's' || CAST(c AS STRING) || '.' || CAST(page AS STRING) AS doc_id, {let('g', rows, let('p', about, f'struct({toks} AS toks, {gold} AS gold)'))} AS p FROM (
      SELECT c, page, collect_list(struct(r, k, t, a, balance)) AS own FROM (SELECT *, CAST(floor((r - 1) / {PAGE}) AS INT) AS page, (c % 50 + 10) * 100000 + total AS balance FROM ({running(d)}) x WHERE c % 3 >= 0) y GROUP BY c, page) o) q"""


def _order_text(d) -> str:
    say = lambda en, vi, accented: f"CASE k % 4 WHEN 1 THEN '{vi}' WHEN 3 THEN '{accented}' ELSE '{en}' END"
    return f"""CASE ln WHEN 0 THEN {say('PAYMENT ORDER', 'UY NHIEM CHI', 'ỦY NHIỆM CHI')} WHEN 1 THEN {say('Remitter', 'Nguoi chuyen', 'Người chuyển')} || ': ' || s WHEN 2 THEN {say('From account', 'TK chuyen', 'TK chuyen')} || ': ' || lpad(CAST(k AS STRING), 9, '4')
        WHEN 3 THEN {say('Payee', 'Nguoi huong', 'Người hưởng')} || ': ' || n WHEN 4 THEN {say('To account', 'TK huong', 'TK huong')} || ': ' || lpad(CAST(k AS STRING), 10, '8') WHEN 5 THEN {say('Amount', 'So tien', 'Số tiền')} || ': ' || {d.commas('(k % 500 + 1) * 10000')}
        WHEN 6 THEN {say('Remark', 'Noi dung', 'Nội dung')} || ': invoice ' || CAST(k AS STRING) ELSE {say('Date', 'Ngay', 'Ngày')} || ': ' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(k % 12 + 1 AS STRING), 2, '0') || '/2025' END"""


def payment_orders(d) -> str:
    """Two languages, the labels of the second without and with accents; dates by number."""
    return f"""
    SELECT 'p' || CAST(k AS STRING) AS doc_id, ln AS tok_idx, {_order_text(d)} AS text,
      CAST(40 AS DOUBLE) AS x0, CAST(20 + 34 * ln AS DOUBLE) AS y0, CAST(400 AS DOUBLE) AS x1, CAST(40 + 34 * ln AS DOUBLE) AS y1, CAST(0.9 AS DOUBLE) AS conf
    FROM (SELECT s_suppkey AS k, s_name AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) x CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS l(ln)"""


def all_pages(d) -> str:
    """Spark only: doc_id and tokens (toks) of all three kinds of documents, one row a document. Orders and suppliers are dealt, not tokens; an order that comes twice gives its tokens twice."""
    columns = {"tok_idx": "ln", **_receipt_token(d)}
    receipt = f"transform(sequence(0, 6), ln -> struct({', '.join(f'{v} AS {c}' for c, v in columns.items())}))"
    order = f"transform(sequence(0, 7), ln -> struct(ln AS tok_idx, {_order_text(d)} AS text, 40D AS x0, CAST(20 + 34 * ln AS DOUBLE) AS y0, 400D AS x1, CAST(40 + 34 * ln AS DOUBLE) AS y1, 0.9D AS conf))"
    toks = f"CASE kind WHEN 'r' THEN flatten(transform(own, o -> {let('c', 'o.c', let('t', 'o.t', receipt))})) ELSE flatten(transform(own, o -> {let('s', 'o.s', let('n', 'o.n', order))})) END"
    rows = f"SELECT 'r' AS kind, k, struct(c, t, CAST(null AS STRING) AS s, CAST(null AS STRING) AS n) AS o FROM ({_ORDERS}) r UNION ALL SELECT 'p' AS kind, s_suppkey AS k, struct(CAST(null AS BIGINT) AS c, CAST(null AS TIMESTAMP_NTZ) AS t, s_name AS s, n_name AS n) AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    return f"SELECT doc_id, toks FROM ({statement_pages(d)}) a UNION ALL SELECT kind || CAST(k AS STRING) AS doc_id, {toks} AS toks FROM (SELECT kind, k, collect_list(o) AS own FROM ({rows}) x GROUP BY kind, k) y"


def short_pages(d) -> str:
    """Spark only: one row a receipt or payment order with its tokens as receipt_pages() gives them (own). Orders and suppliers are dealt together."""
    number = lambda n, v: f"named_struct('cy', CAST(({v['y0']} + {v['y1']}) / 2 AS DOUBLE), 'tok', {n}, 'hh', CAST({v['y1']} - {v['y0']} AS DOUBLE), " + ", ".join(f"'{c}', {sql}" for c, sql in v.items()) + ")"
    receipt = lambda o: f"array({', '.join(number(n, _receipt_token(d, 'k', f'{o}.c', f'{o}.t', str(n))) for n in range(7))})"
    order = {"text": _order_text(d), "x0": "40D", "y0": "CAST(20 + 34 * ln AS DOUBLE)", "x1": "400D", "y1": "CAST(40 + 34 * ln AS DOUBLE)", "conf": "0.9D"}
    slips = f"flatten(transform(own, o -> {let('s', 'o.s', let('n', 'o.n', f'transform(sequence(0, 7), ln -> {number("ln", order)})'))}))"
    toks = f"CASE WHEN kind = 'p' THEN {slips} WHEN size(own) = 1 THEN {receipt('get(own, 0)')} ELSE flatten(transform(own, o -> {receipt('o')})) END"
    rows = f"SELECT 'r' AS kind, k, struct(c, t, CAST(null AS STRING) AS s, CAST(null AS STRING) AS n) AS o FROM ({_ORDERS}) r UNION ALL SELECT 'p' AS kind, s_suppkey AS k, struct(CAST(null AS BIGINT) AS c, CAST(null AS TIMESTAMP_NTZ) AS t, s_name AS s, n_name AS n) AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    return f"SELECT kind || CAST(k AS STRING) AS doc_id, {toks} AS own FROM (SELECT kind, k, collect_list(o) AS own FROM ({rows}) x WHERE k IS NOT NULL GROUP BY kind, k) y"
