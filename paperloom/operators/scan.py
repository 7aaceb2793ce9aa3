"""Running sums, last known values, row numbers and gap sessions over keys of any size: prefix scans in two passes.

A key with more than a quarter of a partition's fair share of the rows is hot. Its rows are cut into blocks at approximate quantiles of their
order (any cuts give the right result; these give even blocks), and a block is what a task orders. One pass scans each
block by itself; block totals, a few rows, are scanned in turn and come back as what each block carries in. Keys that aren't hot
are one block, as in a plain window. Rows of one place in the order stay together, so `spread` should tell most rows of a key apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Hot keys get so many blocks for each partition's fair share that they hold; so there are at most four hot keys a partition.
SPLIT = 4
#: Accuracy of the quantiles: blocks differ by a few hundredths of their share.
ACCURACY = 1000


@dataclass(frozen=True)
class Sum:
    """Sum of a column up to the row, the row included."""

    column: str
    out: str


@dataclass(frozen=True)
class Count:
    """Number of the row, from 1."""

    out: str


@dataclass(frozen=True)
class Last:
    """The last value that isn't null before the row."""

    column: str
    out: str


@dataclass(frozen=True)
class Session:
    """Number of the session, from 0: a row more than `gap` after the one before it starts a new one. column: a number that ascends with the order."""

    column: str
    gap: float
    out: str


def width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def cuts(df: DataFrame, keys: list[str], spread: Column, parts: int | None = None) -> list:
    """Of every hot key its values and the places at which it is cut: at most 4 keys and 8 places a partition. Read twice, aggregated before any shuffle."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = df.count()
    share = max(1, -(-total // (SPLIT * (parts or width(df)))))
    hot = counts.filter(F.col("__n") > share).collect()
    if not hot:
        return []
    most = max(-(-r["__n"] // share) for r in hot)
    keyed = df.withColumn("__place", spread).join(F.broadcast(_table(df, keys, [tuple(r[k] for k in keys) for r in hot])), _same(df, keys), "left_semi")
    quantiles = F.percentile_approx("__place", F.array(*[F.lit((j + 1) / most) for j in range(most - 1)]), ACCURACY) if most > 1 else F.array()
    rows = keyed.groupBy(*keys).agg(quantiles.alias("__q"), F.count("*").alias("__n")).collect()
    out = []
    for r in rows:
        own = -(-r["__n"] // share)  # of the finest cuts so many, evenly
        places = [r["__q"][min(len(r["__q"]) - 1, round((j + 1) * most / own) - 1)] for j in range(own - 1)]
        out.append((*(r[k] for k in keys), sorted({p for p in places if p is not None})))
    return out


def _table(df: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame:
    fields = [df.schema[k] for k in keys]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`h_{f.name}` {f.dataType.simpleString()}" for f in fields))


def _same(df: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"h_{k}"))
    return out


def scan(df: DataFrame, keys: list[str], order: list[str], ops: list, spread: Column | None = None, parts: int | None = None) -> DataFrame:
    """df with a column for each op, within each key in the given order, which must tell its rows apart.

    spread: a number that never descends in the order; by default the first column of the order. Nulls among the keys are a key, nulls of
    the spread come first. An empty table stays empty.
    """
    spread = (F.col(order[0]) if spread is None else spread).cast("double")
    hot = cuts(df, keys, spread, parts)
    blocked = df.withColumn("__block", F.lit(0))
    if hot:
        schema = _table(df, keys, []).schema.add("__cuts", ArrayType(DoubleType()))
        table = df.sparkSession.createDataFrame(hot, schema)
        place = F.when(F.col("__cuts").isNull() | F.col("__place").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__place"))))
        blocked = df.withColumn("__place", spread).join(F.broadcast(table), _same(df, keys), "left")
        blocked = blocked.withColumn("__block", place).withColumn("__hot", F.col("__cuts").isNotNull()).drop("__cuts", "__place", *[f"h_{k}" for k in keys])
    by = [*keys, "__block"]
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local, totals = blocked, []
    for k, op in enumerate(ops):
        if isinstance(op, Sum):
            local, totals = local.withColumn(f"__l{k}", F.sum(op.column).over(upto)), [*totals, F.sum(op.column).alias(f"__t{k}")]
        elif isinstance(op, Count):
            local, totals = local.withColumn(f"__l{k}", F.row_number().over(w).cast("long")), [*totals, F.count("*").alias(f"__t{k}")]
        elif isinstance(op, Last):
            at = F.when(F.col(op.column).isNotNull(), F.struct(*order, op.column))
            local, totals = local.withColumn(f"__l{k}", F.last(op.column, True).over(before)), [*totals, F.max(at).getField(op.column).alias(f"__t{k}")]
        else:
            step = F.col(op.column) - F.lag(op.column).over(w)
            local = local.withColumn(f"__s{k}", (step > op.gap).cast("long"))  # null at a block's start
            local = local.withColumn(f"__l{k}", F.sum(F.coalesce(f"__s{k}", F.lit(0))).over(upto))
    if not hot:
        return _named(local, ops, lambda k: F.col(f"__l{k}"), df.columns)
    # what each block of a hot key carries in
    heated = local.filter("__hot")
    for k, op in enumerate(ops):
        if isinstance(op, Session):
            totals += [F.max(f"__l{k}").alias(f"__t{k}"), F.min(op.column).alias(f"__f{k}"), F.max(op.column).alias(f"__e{k}")]
    blocks = heated.groupBy(*by).agg(*totals)
    over = Window.partitionBy(*keys).orderBy("__block")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for k, op in enumerate(ops):
        if isinstance(op, Last):
            carried.append(F.last(f"__t{k}", True).over(past).alias(f"__c{k}"))
        elif isinstance(op, Session):
            blocks = blocks.withColumn(f"__g{k}", F.coalesce((F.col(f"__f{k}") - F.lag(f"__e{k}").over(over) > op.gap).cast("long"), F.lit(0)))
            carried.append((F.coalesce(F.sum(F.col(f"__t{k}") + F.col(f"__g{k}")).over(past), F.lit(0)) + F.col(f"__g{k}")).alias(f"__c{k}"))
        else:
            carried.append(F.sum(f"__t{k}").over(past).alias(f"__c{k}"))
    carried = blocks.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("__block").alias("h_block"), *carried)
    out = local.join(F.broadcast(carried), _same(df, keys) & (F.col("__block") == F.col("h_block")), "left")  # a row for each block of a hot key: some 8 a partition

    def joined(k: int) -> Column:
        op, own, more = ops[k], F.col(f"__l{k}"), F.col(f"__c{k}")
        if isinstance(op, Last):
            return F.coalesce(own, more)
        return F.when(own.isNull(), more).otherwise(own + F.coalesce(more, F.lit(0)))

    return _named(out, ops, joined, df.columns)


def _named(df: DataFrame, ops: list, value, columns: list[str]) -> DataFrame:
    return df.select(*columns, *[value(k).alias(op.out) for k, op in enumerate(ops)])


def inversions(df: DataFrame, key: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """key, n, inverted, inversions: of each key's rows in the given order, the pairs whose earlier row has the greater value. No pair is formed.

    Values are ranked from 0 and told apart bit by bit, from the highest: rows that agree in all higher bits are a group, and each row with a
    0 comes after as many greater ones as there are 1s before it in its group. Ties are no inversions, null values take no part.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.struct(*order).alias("place"), F.col(value).alias("value"))
    ranks = scan(rows.groupBy("key", "value").agg(F.count("*").alias("n")), ["key"], ["value"], [Count("rank")], parts=parts).select("key", "value", (F.col("rank") - 1).alias("rank"))
    placed = scan(rows.select("key", *[F.col(f"place.{c}").alias(c) for c in order], "value"), ["key"], order, [Count("at")], parts=parts)
    ranked = placed.select("key", "value", "at").join(ranks, ["key", "value"])
    top = ranks.groupBy("key").agg(F.max("rank").alias("top"))
    bits = ranked.join(top, "key").select("key", "at", "rank", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("top") + 1)).cast("int") - 1))).alias("bit"))
    bits = bits.select("key", "at", "bit", F.expr("shiftright(rank, bit + 1)").alias("above"), F.expr("shiftright(rank, bit) & 1").alias("one"))
    seen = scan(bits, ["key", "bit", "above"], ["at"], [Sum("one", "ones")], parts=parts)
    out = seen.groupBy("key").agg(F.sum(F.when(F.col("one") == 0, F.col("ones")).otherwise(0)).alias("inversions"))
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = n.join(out, "key").select(F.col("key").alias(key), "n", (F.col("inversions") > 0).cast("int").alias("inverted"), "inversions")
    return out
