"""Exact percentiles that no single buffer has to hold.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a quantile sketch of fixed size brackets each wanted rank, values
outside the brackets are only counted, and just the values inside, some four in
``ACCURACY`` of the group, are put in order; a group of under twice ``ACCURACY``
values is all inside, as the sketch's ranks are too coarse for it. All steps are
partial aggregations, and the result equals the built-in one. Where the planner
knows the input to be small, the built-in one is used, which takes one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank error of the sketch is one in so many.
ACCURACY = 10_000
#: Bytes, as the planner estimates them, up to which one buffer holds any group.
SMALL = 32 << 20


def percentiles(df: DataFrame, col: str, wanted: dict[str, float], keys: tuple[str, ...] = (), accuracy: int = ACCURACY, small: int = SMALL) -> DataFrame:
    """keys and one column a name of ``wanted``: percentiles by linear interpolation; nulls are left out, an empty group gives null.

    Groups must be few (they are broadcast): segments, clones, or all rows.
    """
    rows = df.select(*keys, F.col(col).cast("double").alias("__v")).where("__v is not null")
    if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= small:
        return rows.groupBy(*keys).agg(*[F.percentile("__v", F.lit(float(p))).alias(name) for name, p in wanted.items()])
    names, slack = list(wanted), 2.0 / accuracy
    ends = [e for p in wanted.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("__b"))
    placed = rows.join(F.broadcast(sketch), list(keys)) if keys else rows.crossJoin(F.broadcast(sketch))  # one row a group
    low = lambda i: F.col("__b")[2 * i]
    inside = lambda i: (F.col("__v") >= low(i)) & (F.col("__v") <= F.col("__b")[2 * i + 1])
    any_inside = (F.col("__n") < 2 * accuracy) | inside(0)
    for i in range(1, len(names)):
        any_inside = any_inside | inside(i)
    # values outside every bracket fall into one row a gap; inside, one row a distinct value
    gap = F.array_sort(F.transform(F.array(*[F.struct(low(i).alias("e")) for i in range(len(names))]), lambda x: x["e"]))
    below = F.size(F.filter(gap, lambda e: F.col("__v") >= e))
    marked = placed.select(*keys, "__v", F.when(any_inside, F.col("__v")).alias("__own"), F.when(~any_inside, below).alias("__gap"))
    counted = marked.groupBy(*keys, "__own", "__gap").agg(F.count("*").alias("__c"), F.min("__v").alias("__at"))
    # in order of values: a gap's row stands at its least value, and no bracket reaches into it
    line = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("v"), F.col("__c").alias("c")))).alias("__line"), F.sum("__c").alias("__n"))

    def at(rank):
        step = lambda s, x: F.struct((s["c"] + x["c"]).alias("c"), F.when(s["v"].isNull() & (s["c"] + x["c"] > rank), x["v"]).otherwise(s["v"]).alias("v"))
        return F.aggregate("__line", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("double").alias("v")), step)["v"]

    out = []
    for name, p in wanted.items():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        out.append(F.when(F.floor(pos) == F.ceil(pos), lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(name))
    found = line.select(*keys, *out)
    if keys:
        return found
    # a global aggregate has its row even without input
    return df.sparkSession.range(1).join(found, F.lit(True), "left").select(*names)
