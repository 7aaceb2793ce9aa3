"""Reports of a run as files, and the registry of models and learned models kept in a folder. All are written by Spark, so any store will do."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "seq long, model string, version string, op string, path string, metrics string, lineage string"


#: Rows of a report's table at most: it goes through the driver and into one file.
MOST_ROWS = 10_000


def markdown_lines(table: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A small table, of MOST_ROWS rows at most, as lines of a markdown table: place, line."""
    columns = list(columns or table.columns)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    spark = table.sparkSession
    body = table.orderBy(*(order or columns[:1])).select(row.alias("line")).limit(MOST_ROWS + 1).collect()
    if len(body) > MOST_ROWS:
        raise ValueError(f"a report's table has {MOST_ROWS} rows at most; write larger ones as data")
    return spark.createDataFrame([(k, line) for k, line in enumerate([*head, *(r.line for r in body)])], "place int, line string")


def write_report(title: str, facts: Mapping[str, object], table: DataFrame, raw: DataFrame, folder: str) -> None:
    """folder/report: title, facts and table as markdown, in one file; folder/raw: the rows behind them as JSON lines."""
    spark = table.sparkSession
    lines = [f"# {title}", "", *(f"- {k}={v}" for k, v in facts.items()), ""]
    text = [*lines, *(r.line for r in markdown_lines(table).orderBy("place").collect())]
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    raw.write.mode("overwrite").json(f"{folder}/raw")


def summary_lines(fields: DataFrame, results: DataFrame) -> DataFrame:
    """One text a document: its type, whether it needs review, and its fields as a table."""
    rows = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", F.concat(F.lit("| "), F.col("field"), F.lit(" | "), F.coalesce("value", F.lit("-")), F.lit(" | "), F.format_string("%.2f", "confidence"), F.lit(" |")).alias("line")))).alias("r"))
    head = F.concat(F.lit("document type: "), F.col("doc_type"), F.lit(", needs review: "), F.when(F.col("needs_review") == 1, "yes").otherwise("no"))
    return results.join(rows, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, F.array_join(F.transform("r", lambda x: x.line), "\n")).alias("summary"))


def plain(value):
    """What JSON can hold: numbers of other kinds as floats, anything else as text."""

    def other(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return str(x)

    return json.loads(json.dumps(value, default=other))


def log_registry(spark: SparkSession, folder: str, seq: int, model: str, version: str, op: str, path: str = "", metrics=None, lineage=None) -> None:
    """Append an operation (register, staging, production, archived) to the registry's log."""
    row = (seq, model, version, op, path, json.dumps(plain(metrics or {})), json.dumps(plain(lineage or {})))
    spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(folder)


def save_model(model: PipelineModel, folder: str, name: str, version: str) -> str:
    """Where the version was saved; an earlier save of it gives way."""
    path = f"{folder.rstrip('/')}/{name}/{version}"
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, name: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{name}/{version}")
