"""File sources and sinks of annotation, label and feedback data. Bad lines become rows with a reason or drop out, as stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from . import archives

LABELS = "image string, tokens array<struct<text:string,bbox:array<double>,conf:double>>, gold map<string,string>, doc_type string"


def labels_json(spark: SparkSession, paths) -> DataFrame:
    """Labelled records from JSON arrays; paths: one path or several."""
    return spark.read.schema(LABELS).json(paths, multiLine=True)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: origin, height, width, n_channels, data, error. What cannot be decoded keeps a row with an error.

    Spark's file readers pass over files of no bytes, so those have no row.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"))
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    out = raw.withColumn("k", name(F.col("origin"))).join(decoded.withColumn("k", name(F.col("origin"))).drop("origin"), "k", "left")
    error = F.when(F.col("height").isNull(), "unsupported or corrupted")
    return out.select("origin", "height", "width", F.col("nChannels").alias("n_channels"), "data", error.alias("error"))


def error_results(images_: DataFrame) -> DataFrame:
    """The result row of each image that failed to decode: no type, no fields, in review."""
    null = F.lit(None).cast("string")
    return images_.filter("error is not null").select(F.col("origin").alias("doc_id"), F.lit("unknown").alias("doc_type"), F.lit("error").alias("route"), null.alias("merchant_name"), null.alias("date"), null.alias("total_amount"), null.alias("invoice_id"), null.alias("payment_method"), F.lit(True).alias("needs_review"), "error")


def _lines(spark, path) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def box_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens from lines of eight coordinates and a text that may hold commas; short lines and bad numbers drop out."""
    p = F.split("value", ",", 9)
    xy = F.transform(F.slice("p", 1, 8), lambda x: F.trim(x).try_cast("double"))
    t = _lines(spark, path).select("file", p.alias("p")).filter(F.size("p") == 9).select("file", xy.alias("c"), F.element_at("p", 9).alias("text")).filter(~F.exists("c", lambda x: x.isNull()))
    own = lambda k: F.transform(F.array(*[F.lit(i) for i in range(k, 9, 2)]), lambda i: F.element_at("c", i))
    return t.select("file", "text", F.array_min(own(1)).alias("x0"), F.array_min(own(2)).alias("y0"), F.array_max(own(1)).alias("x1"), F.array_max(own(2)).alias("y1"), F.lit(1.0).alias("conf"))


def key_gold(spark: SparkSession, path: str) -> DataFrame:
    """Normalised truth from one JSON object a file: company, date, total."""
    t = spark.read.schema("company string, date string, total string").json(path, multiLine=True)
    return t.select(F.col("_metadata.file_name").alias("file"), F.nullif(N.norm_text(F.col("company")), F.lit("")).alias("merchant_name"), N.norm_date(F.col("date")).alias("date"), N.norm_money(F.col("total")).alias("total_amount"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """name<TAB>text lines: blank ones drop out, lines without a tab keep a null text, further tabs stay in the text."""
    p = F.split("value", "\t", 2)
    return _lines(spark, path).filter("trim(value) <> ''").select("file", F.when(F.size(p) > 1, F.trim(p[0])).otherwise(F.col("value")).alias("name"), F.when(F.size(p) > 1, p[1]).alias("text"))


def region_gold(spark: SparkSession, path: str, fields=("SELLER", "ADDRESS", "TIMESTAMP", "TOTAL_COST")) -> DataFrame:
    """Regions from a table with a list of boxes as a literal and two lists parted by three pipes, cut to the shortest list."""
    t = spark.read.csv(path, header=True, escape='"', multiLine=True)
    box = F.from_json(F.translate("anno_polygons", "'", '"'), "array<struct<bbox:array<double>>>")
    parts = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"\|\|\|")
    z = t.select("img_id", box.alias("b"), parts("anno_texts").alias("t"), parts("anno_labels").alias("l")).filter("b is not null")
    z = z.withColumn("n", F.least(F.size("b"), F.size("t"), F.size("l")))
    z = z.select("img_id", F.posexplode(F.arrays_zip(F.slice("b", 1, F.col("n")), F.slice("t", 1, F.col("n")), F.slice("l", 1, F.col("n")))).alias("idx", "r"))
    z = z.select("img_id", "idx", F.col("r")["0"]["bbox"].alias("q"), F.trim(F.col("r")["1"]).alias("text"), F.trim(F.col("r")["2"]).alias("label"))
    z = z.filter(F.col("label").isin(*fields) & (F.size("q") == 4))
    return z.select("img_id", "idx", "label", "text", F.col("q")[0].alias("x0"), F.col("q")[1].alias("y0"), (F.col("q")[0] + F.col("q")[2]).alias("x1"), (F.col("q")[1] + F.col("q")[3]).alias("y1"))


def zip_members(spark: SparkSession, path: str, suffixes=(".jpg", ".txt", ".csv")) -> DataFrame:
    """Members of zip files with the wanted endings: archive, member, content."""
    archives.register(spark)
    wanted = reduce(lambda a, b: a | b, [F.lower("member").endswith(s) for s in suffixes])
    return spark.read.format("archive").load(path).filter(wanted).select("archive", "member", "content")


def write_dataset(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def append_feedback(feedback: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Appends the feedback on known documents as JSON lines; returns the rest, each with status 404."""
    own = known.select("document_id").distinct()
    feedback.join(own, "document_id", "left_semi").write.mode("append").json(path)
    return feedback.join(own, "document_id", "left_anti").withColumn("status", F.lit(404))


def exposition(counters: DataFrame, name: str = "requests_total", label: str = "endpoint", value: str = "n") -> DataFrame:
    """Text lines of a counter, one a label value."""
    return counters.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(label).cast("string"), F.col(value).cast("string")).alias("line"))


def mix(parts) -> DataFrame:
    """Union of (table, weight), each row as often as its weight says."""
    out = None
    for df, weight in parts:
        one = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(weight)))))
        out = one if out is None else out.unionByName(one)
    return out.drop("copy")


def field_manifest(records: DataFrame) -> DataFrame:
    """One row for each true field of each labelled record: image, field, value."""
    return records.select("image", F.explode("gold").alias("field", "value"))
