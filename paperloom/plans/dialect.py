"""The few places where Spark SQL and the checking SQL engine spell an operation differently."""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"

    def ra(self, s, p, r):
        return f"regexp_replace({s}, '{p}', '{r}')"

    def rx(self, s, p):
        return f"nullif(regexp_extract({s}, '{p}', 0), '')"

    def has(self, s, p):
        return f"({s} RLIKE '{p}')"

    def agg(self, x, order, sep=" "):
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def lastnn(self, x, over):
        return f"last_value({x}, true) OVER ({over})"

    def commas(self, x):
        return f"format_number({x}, 0)"

    def fixed2(self, x):
        return f"format_number({x}, '0.00')"

    def dmy(self, t):
        return f"date_format({t}, 'dd/MM/yyyy')"

    def ymd(self, t):
        return f"date_format({t}, 'yyyy-MM-dd')"

    def epoch(self, t):
        return f"unix_timestamp({t})"

    def point(self):
        return "named_struct('cx', cx, 'cy', cy)"

    def pair(self, a, b):
        return f"struct({a}, {b})"

    def gather(self, x, over):
        return f"collect_list({x}) {over}"

    def best(self, array, name, value):
        return f"array_max(transform({array}, {name} -> {value}))"

    def exact(self, x, q):
        return f"percentile({x}, {q})"

    def part(self, s, sep, k):
        return f"split_part({s}, '{sep}', {k})"

    def found(self, s, p):
        return f"regexp_extract_all({s}, '{p}', 0)"

    def first_two(self, array, sep):
        return f"array_join(slice({array}, 1, 2), '{sep}')"

    def after_last(self, s, sep):
        return f"substring_index({s}, '{sep}', -1)"

    def json_int(self, s, key):
        return f"CAST(get_json_object({s}, '$.{key}') AS BIGINT)"


class Duck(Spark):
    name = "duck"

    def ra(self, s, p, r):
        return f"regexp_replace({s}, '{p}', '{r}', 'g')"

    def has(self, s, p):
        return f"regexp_matches({s}, '{p}')"

    def agg(self, x, order, sep=" "):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def lastnn(self, x, over):
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def commas(self, x):
        return f"format('{{:,}}', CAST({x} AS BIGINT))"

    def fixed2(self, x):
        return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"

    def dmy(self, t):
        return f"strftime({t}, '%d/%m/%Y')"

    def ymd(self, t):
        return f"strftime({t}, '%Y-%m-%d')"

    def epoch(self, t):
        return f"CAST(floor(epoch({t})) AS BIGINT)"

    def point(self):
        return "{'cx': cx, 'cy': cy}"

    def pair(self, a, b):
        return f"row({a}, {b})"

    def gather(self, x, over):
        return f"list({x}) FILTER (WHERE {x} IS NOT NULL) {over}"

    def best(self, array, name, value):
        return f"list_max(list_transform({array}, lambda {name}: {value}))"

    def exact(self, x, q):
        return f"quantile_cont({x}, {q})"

    def found(self, s, p):
        return f"regexp_extract_all({s}, '{p}')"

    def first_two(self, array, sep):
        return f"array_to_string(({array})[1:2], '{sep}')"

    def after_last(self, s, sep):
        return f"string_split({s}, '{sep}')[-1]"

    def json_int(self, s, key):
        return f"CAST(json_extract_string({s}, '$.{key}') AS BIGINT)"


_BUILT: dict = {}


def _views() -> dict:
    """Views that operators beyond SQL build from the tables: builder(spark, sf_dir) by name."""
    from ..operators import statements
    from ..sources import render
    from . import registry

    tokens = lambda spark, sf_dir: run(spark, sf_dir, render.statement_pages(Spark())).select("doc_id", "toks")
    return {
        "running_orders": lambda spark, sf_dir: render.running_orders(run(spark, sf_dir, render.AMOUNTS)),
        "statement_columns": lambda spark, sf_dir: statements.header(tokens(spark, sf_dir)),
        "statement_cells": lambda spark, sf_dir: statements.cells(tokens(spark, sf_dir)),
        "document_reviews": lambda spark, sf_dir: registry.reviews(spark, sf_dir),
        "statement_items": lambda spark, sf_dir: statements.items(tokens(spark, sf_dir)),
    }


def run(spark, sf_dir, text):
    """Spark SQL over the tables, and the views built from them, that the text names."""
    import re

    names = lambda t: re.search(rf"\b{t}\b", text)
    for t in TABLES:
        if names(t):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v, build in _views().items():
        if names(v):
            key = v, sf_dir, spark.sparkContext.applicationId
            if key not in _BUILT:  # plans, which are made once; hot keys are looked for once
                _BUILT[key] = build(spark, sf_dir)
            _BUILT[key].createOrReplaceTempView(v)
    return spark.sql(text)


_OWN: dict[str, str] = {}


def shared_folder(spark) -> str:
    """A folder of this application's own in the cluster's shared one (spark.checkpoint.dir), gone when the application ends; without that setting a temporary one, which a local master alone can share."""
    import tempfile

    app = spark.sparkContext.applicationId
    if app not in _OWN:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{shared.rstrip('/')}/paperloom-{app}" if shared else tempfile.mkdtemp(prefix="paperloom-")
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = own.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(own)
        store.deleteOnExit(own)
        _OWN[app] = path
    return _OWN[app]
