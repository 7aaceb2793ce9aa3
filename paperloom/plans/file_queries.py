"""Queries of the file sources, sinks and column functions: each writes a fixture from the tables into the shared folder and reads it back as a user would."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import recognition as C
from ..operators import evaluation as E
from ..operators import images as I
from ..sources import archives, files, reports, tables
from ..sources import render as R
from .dialect import Duck, Spark, run, shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, oracle: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__], COVERS[fn.__name__] = fn, oracle, covers
        return fn

    return keep


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


DUCK = Duck()


@query("S5 D3", f"SELECT text, x0, y0, x1, y1, CAST(1 AS DOUBLE) AS conf FROM ({R.receipts(DUCK)}) t")
def box_files(spark, sf_dir):
    """Tokens as lines of four corners and a text that may hold commas."""
    at, t = folder(spark), run(spark, sf_dir, R.receipts(Spark()))
    t.select(F.concat_ws(",", "x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "text")).write.text(at)
    return files.box_tokens(spark, at).select("text", "x0", "y0", "x1", "y1", "conf")


@query("S8 X2", "SELECT CAST(item_id AS VARCHAR) || '.jpg' AS name, CASE WHEN item_id % 5 <> 0 THEN regexp_replace(text, '[^ -~]+', ' ', 'g') END AS text FROM benchmark")
def label_files(spark, sf_dir):
    """name<TAB>text lines, some of them without a text, with blank lines between."""
    at, t = folder(spark), run(spark, sf_dir, "SELECT item_id, regexp_replace(text, '[^ -~]+', ' ') AS text FROM benchmark")
    name = F.concat(F.col("item_id").cast("string"), F.lit(".jpg"))
    lines = t.select(F.explode(F.array(F.when(F.col("item_id") % 5 == 0, name).otherwise(F.concat_ws("\t", name, "text")), F.lit("  "))))
    lines.write.text(at)
    return files.label_lines(spark, at).select(F.when(F.col("text").isNull(), F.trim("name")).otherwise(F.col("name")).alias("name"), "text")


GOLD = "SELECT doc_id, field, gold FROM ({}) g WHERE gold IS NOT NULL"


def _records(spark, sf_dir):
    """Labelled records as JSON arrays, five hundred a file, read back."""
    at = folder(spark)
    tokens = run(spark, sf_dir, R.receipts(Spark())).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.col("conf").cast("double").alias("conf")))).alias("t"))
    gold = run(spark, sf_dir, GOLD.format(E.true_fields(Spark()))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "gold"))).alias("gold"))
    record = F.to_json(F.struct(F.col("doc_id").alias("image"), F.transform("t", lambda x: F.struct(x.text.alias("text"), x.bbox.alias("bbox"), x.conf.alias("conf"))).alias("tokens"), "gold", F.lit("receipt").alias("doc_type")))
    chunk = F.floor(F.substring("doc_id", 2, 20).cast("long") / 500)
    arrays = tokens.join(gold, "doc_id", "left").groupBy(chunk.alias("chunk")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("chunk").text(at)
    return files.labels_json(spark, at)


@query("S4 D15", f"SELECT doc_id AS image, count(*) AS n_tokens, max(x1) AS right_edge, round(sum(CAST(conf AS DOUBLE)), 4) AS conf FROM ({R.receipts(DUCK)}) t GROUP BY doc_id")
def label_records(spark, sf_dir):
    t = _records(spark, sf_dir).select("image", F.explode("tokens").alias("t"))
    return t.groupBy("image").agg(F.count("*").alias("n_tokens"), F.max(F.col("t.bbox")[2]).alias("right_edge"), F.round(F.sum("t.conf"), 4).alias("conf"))


@query("S11 S16", "SELECT doc_id AS image, field, gold AS value FROM (" + GOLD.format(E.true_fields(DUCK)) + ") x")
def manifest_fields(spark, sf_dir):
    """The true fields, exploded and written as JSON lines."""
    at = folder(spark)
    files.write_dataset(files.field_manifest(_records(spark, sf_dir)), at)
    return spark.read.schema("image string, field string, value string").json(at)


@query("S9 D16", f"SELECT img AS img_id, CAST(idx AS INTEGER) AS idx, CASE idx WHEN 0 THEN 'SELLER' ELSE 'TOTAL_COST' END AS label, text, x0, y0, x1, y1 FROM ({E.boxes(DUCK)[0]}) b WHERE idx <> 1")
def region_files(spark, sf_dir):
    """Regions as rows of a CSV with a list of boxes and two lists parted by pipes; one of three labels is of no interest."""
    at, b = folder(spark), run(spark, sf_dir, E.boxes(Spark())[0])
    box = F.format_string("{'bbox': [%s, %s, %s, %s]}", F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    label = F.when(F.col("idx") == 0, "SELLER").when(F.col("idx") == 1, "OTHER").otherwise("TOTAL_COST")
    rows = b.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("idx", box.alias("box"), "text", label.alias("label")))).alias("r"))
    part = lambda c, sep: F.array_join(F.transform("r", lambda x: x[c]), sep)
    rows.select(F.col("img").alias("img_id"), F.concat(F.lit("["), part("box", ", "), F.lit("]")).alias("anno_polygons"), part("text", "|||").alias("anno_texts"), part("label", "|||").alias("anno_labels")).write.option("header", True).option("escape", '"').csv(at)
    return files.region_gold(spark, at).select(F.col("img_id").cast("long").alias("img_id"), "idx", "label", "text", "x0", "y0", "x1", "y1")


@query("S17 D19", "SELECT event_id, user_id AS document_id, 404 AS status FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def feedback_unknown(spark, sf_dir):
    """Feedback on documents that aren't known; the rest is appended."""
    feedback = run(spark, sf_dir, "SELECT event_id, user_id AS document_id FROM events")
    return files.append_feedback(feedback, run(spark, sf_dir, "SELECT doc_id AS document_id FROM labels"), folder(spark)).select("event_id", "document_id", "status")


@query("S17 D19", "SELECT event_id, user_id AS document_id FROM events WHERE user_id IN (SELECT doc_id FROM labels)")
def feedback_kept(spark, sf_dir):
    at, feedback = folder(spark), run(spark, sf_dir, "SELECT event_id, user_id AS document_id FROM events")
    files.append_feedback(feedback, run(spark, sf_dir, "SELECT doc_id AS document_id FROM labels"), at)
    return spark.read.schema("event_id long, document_id long").json(at)


@query("S22 D20 M16", """SELECT 'requests_total{endpoint="' || event_type || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type""")
def counter_lines(spark, sf_dir):
    return files.exposition(run(spark, sf_dir, "SELECT event_type AS endpoint, count(*) AS n FROM events GROUP BY event_type"))


@query("S10", "SELECT doc_id, lang || '/' || source || '.' || CAST(doc_id AS VARCHAR) || '.txt' AS member, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest FROM documents WHERE lang = 'en'")
def archive_members(spark, sf_dir):
    """Documents as members of zip archives, one archive a task, and those of one language read back by ranges of members."""
    at = folder(spark)
    archives.register(spark)
    docs = run(spark, sf_dir, "SELECT lang || '/' || source || '.' || CAST(doc_id AS STRING) || '.txt' AS member, CAST(text AS BINARY) AS content FROM documents")
    docs.write.format("archive").mode("append").save(at)
    t = spark.read.format("archive").option("partitionBytes", 1 << 20).load(at).filter(F.col("member").startswith("en/"))
    return t.select(F.regexp_extract("member", r"([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), "member", "size", F.md5("content").alias("digest"))


_FIELD_LINES = f"SELECT '| ' || field || ' | ' || CAST(tp AS VARCHAR) || ' | ' || CAST(fn AS VARCHAR) || ' |' AS line, 10 + row_number() OVER (ORDER BY field) AS k FROM ({E.counts(DUCK)}) c"


@query("S20", f"SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS place, line FROM (SELECT * FROM (VALUES ('# Fields', 0), ('', 1)) a(line, k) UNION ALL SELECT '- receipts=' || CAST(count(*) AS VARCHAR), 2 FROM orders UNION ALL SELECT * FROM (VALUES ('', 3), ('| field | tp | fn |', 4), ('|---|---|---|', 5), ('', 99)) b(line, k) UNION ALL {_FIELD_LINES}) x")
def run_report(spark, sf_dir):
    """The report of a run as its lines: title, facts and a table, written to a file and read back."""
    at, counts = folder(spark), run(spark, sf_dir, f"SELECT field, tp, fn FROM ({E.counts(Spark())}) c")
    n = run(spark, sf_dir, "SELECT count(*) AS n FROM orders").first().n
    reports.write_report("Fields", {"receipts": n}, counts, counts, at)
    text = spark.read.text(f"{at}/report", wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("place", "line"))


@query("S18 S17", "SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def upserted_state(spark, sf_dir):
    """The event log upserted by user in micro-batches, each of them delivered twice: one row a user, the last."""
    at, events = folder(spark), run(spark, sf_dir, "SELECT user_id, event_type, event_id FROM events")
    table = tables.Table(spark, at, ("user_id",), "event_id")
    once = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    log = events.select("user_id", F.col("event_type").alias("state"), "event_id", F.count("*").over(once).alias("n")).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    log.write.partitionBy("part").parquet(f"{at}-log")
    for batch, part in ((0, 2), (1, 0), (1, 0), (2, 1), (0, 2)):
        table.upsert(spark.read.parquet(f"{at}-log/part={part}"), "events", batch)
    return table.read()


@query("N16 D6", f"SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, date, lower(description) AS description, amount, balance FROM ({R.ledger(DUCK)}) l")
def reply_transactions(spark, sf_dir):
    """Transactions as a model's JSON reply states them, typed again."""
    amount = lambda c: F.format_number(F.col(c), 2)
    one = F.struct("row_idx", F.to_json(F.struct(F.date_format("t", "dd/MM/yyyy").alias("date"), "description", amount("amount").alias("amount"), amount("balance").alias("balance"))).alias("j"))
    reply = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.j), ", "), F.lit(", null, 7]"))
    rows = run(spark, sf_dir, R.ledger(Spark())).groupBy("doc_id").agg(reply.alias("reply"))
    return rows.select("doc_id", F.posexplode(C.transactions(F.col("reply"))).alias("k", "x")).select("doc_id", (F.col("k") + 1).cast("int").alias("row_idx"), "x.date", "x.description", "x.amount", "x.balance")


@query("N21", "SELECT vec_id, round(exp(x[1] - m) / s, 6) AS first, round(exp(x[len(x)] - m) / s, 6) AS last FROM (SELECT vec_id, x, m, list_sum(list_transform(x, lambda v: exp(v - m))) AS s FROM (SELECT vec_id, x, list_max(x) AS m FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) e) f) g")
def softmax_ends(spark, sf_dir):
    p = C.softmax(F.col("embedding").cast("array<double>"))
    return run(spark, sf_dir, "SELECT vec_id, embedding FROM embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(F.get("p", 0), 6).alias("first"), F.round(F.element_at("p", -1), 6).alias("last"))


SIZES = "SELECT o_orderkey AS img, CAST(100 + o_orderkey % 4700 AS INT) AS h, CAST(90 + o_custkey * 7 % 5100 AS INT) AS w FROM orders"


@query("I3", f"SELECT img, CAST(floor(h2 * greatest(1.0::DOUBLE, 720::DOUBLE / least(h2, w2))) AS INTEGER) AS height, CAST(floor(w2 * greatest(1.0::DOUBLE, 720::DOUBLE / least(h2, w2))) AS INTEGER) AS width FROM (SELECT img, floor(h * least(1.0::DOUBLE, 3000::DOUBLE / greatest(h, w))) AS h2, floor(w * least(1.0::DOUBLE, 3000::DOUBLE / greatest(h, w))) AS w2 FROM ({SIZES}) s) t")
def page_sizes(spark, sf_dir):
    return run(spark, sf_dir, SIZES).select("img", I.size_plan(F.col("h"), F.col("w")).alias("p")).select("img", "p.height", "p.width")
