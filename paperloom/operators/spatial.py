"""Joins of boxes on pages of any size, by a grid of cells, and the nearest span by order.

A box has the level of its larger side: the cells of level l have sides of 2**l, so at its own level a box lies on at most four cells. It is
filed under these, and at each coarser level that the other side has under those that it lies on there, again four at most. Two boxes
meet in the cells of the coarser of their levels only, and a pair counts in its home cell alone, the one with the top left corner of their
intersection; so no pair is found twice and none needs to be told apart afterwards. Work grows with the boxes and the pairs that touch,
not with the square of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
#: Levels of the smallest and the largest cells; smaller and larger boxes count as of these.
LEAST_LEVEL, MOST_LEVEL = -10, 40


def level(w: Column, h: Column) -> Column:
    side = F.greatest(w, h, F.lit(0.0))
    return F.when(side <= 2.0**LEAST_LEVEL, LEAST_LEVEL).otherwise(F.least(F.ceil(F.log2(side)), F.lit(MOST_LEVEL))).cast("int")


def _cell(value: Column, lev: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), lev)).cast("long")


def _filed(boxes: DataFrame, prefix: str, levels: DataFrame) -> DataFrame:
    """A row for each cell of each level, from a box's own up, at which it may meet one of the other side."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{s}") for s in SIDES)
    at = F.explode(F.filter(F.array_distinct(F.concat(F.array("own"), F.col("levels"))), lambda q: q >= F.col("own")))
    rows = boxes.withColumn("own", level(x1 - x0, y1 - y0)).crossJoin(F.broadcast(levels)).withColumn("level", at).drop("levels")  # levels: one row
    span = lambda a, b: F.explode(F.sequence(_cell(a, F.col("level")), _cell(b, F.col("level"))))
    rows = rows.withColumn("cx", span(x0, x1)).withColumn("cy", span(y0, y1))
    return rows.withColumn(f"__{prefix}own", F.col("level") == F.col("own")).drop("own")


def _levels(boxes: DataFrame, prefix: str) -> DataFrame:
    x0, y0, x1, y1 = (F.col(f"{prefix}{s}") for s in SIDES)
    return boxes.select(F.collect_set(level(x1 - x0, y1 - y0)).alias("levels"))  # MOST_LEVEL - LEAST_LEVEL + 1 numbers at most


def touching(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """All pairs of a page whose boxes touch or overlap: the columns of left as l_..., those of right as r_....

    Boxes are x0, y0, x1, y1 (a point has equal sides); those with a null or a side that ends before it starts meet nothing. Boxes over
    2**MOST_LEVEL wide are filed under as many cells as they cover. Tables without rows give no pairs.
    """

    def named(df: DataFrame, prefix: str) -> DataFrame:
        x0, y0, x1, y1 = (F.col(s) for s in SIDES)
        return df.filter((x1 >= x0) & (y1 >= y0) & F.col(page).isNotNull()).select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    left, right = named(left, "l_"), named(right, "r_")
    a = _filed(left, "l_", _levels(right, "r_"))
    b = _filed(right, "r_", _levels(left, "l_"))
    pairs = a.withColumn("page", F.col(f"l_{page}")).join(b.withColumn("page", F.col(f"r_{page}")), ["page", "level", "cx", "cy"])
    x, y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    meet = (x <= F.least("l_x1", "r_x1")) & (y <= F.least("l_y1", "r_y1"))
    home = (_cell(x, F.col("level")) == F.col("cx")) & (_cell(y, F.col("level")) == F.col("cy"))
    return pairs.filter(meet & home & (F.col("__l_own") | F.col("__r_own"))).select(*left.columns, *right.columns)


def overlap_share() -> Column:
    """Of a pair of touching(): the share of the left box that the right one covers."""
    inter = F.greatest(F.lit(0.0), F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")) * F.greatest(F.lit(0.0), F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0"))
    return inter / ((F.col("l_x1") - F.col("l_x0")) * (F.col("l_y1") - F.col("l_y0")))


def nearest_span(points: DataFrame, spans: DataFrame, page: str, at: str, idx: str = "idx") -> DataFrame:
    """points with the idx of the span (lo, hi, idx) of their page that holds the point, else of the one whose middle is nearest; of those that tie the lowest idx.

    Points without a place or of pages without spans drop out. One sort a page finds the middles beside a point; spans that hold it are found by
    cells, once for each place.
    """
    mids = spans.filter("hi >= lo").groupBy(page, ((F.col("lo") + F.col("hi")) / 2).alias("mid")).agg(F.min(idx).alias("own"))
    # a line of middles and points; of both at one place the middle comes first
    line = mids.select(page, F.col("mid").alias("__place"), F.struct("mid", "own").alias("__m"))
    rows = points.filter(F.col(at).isNotNull()).withColumn("__place", F.col(at).cast("double")).withColumn("__point", F.lit(1))
    line = rows.unionByName(line, allowMissingColumns=True)
    w = Window.partitionBy(page).orderBy("__place", F.coalesce("__point", F.lit(0)))
    beside = line.withColumn("__before", F.last("__m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__after", F.first("__m", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    far = lambda m: F.struct(F.abs(F.col("__place") - m.getField("mid")).alias("far"), m.getField("own").alias("own"))
    closest = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), far(F.col(c))) for c in ("__before", "__after")]), lambda x: x.isNotNull()))
    near = beside.filter("__point = 1").withColumn("__near", closest.getField("own")).select(*points.columns, "__place", "__near")
    flat = lambda lo, hi: [F.lit(0.0).alias("x0"), F.col(lo).cast("double").alias("y0"), F.lit(0.0).alias("x1"), F.col(hi).cast("double").alias("y1")]
    places = rows.select(F.col(page).alias("p"), *flat("__place", "__place")).distinct()
    inside = touching(places, spans.select(F.col(page).alias("p"), F.col(idx).alias("own"), *flat("lo", "hi")), "p")
    holds = inside.groupBy(F.col("l_p").alias(page), F.col("l_y0").alias("__place")).agg(F.min("r_own").alias("__holds"))
    out = near.join(holds, [page, "__place"], "left").withColumn(idx, F.coalesce("__holds", "__near"))
    return out.filter(F.col(idx).isNotNull()).select(*points.columns, idx)
