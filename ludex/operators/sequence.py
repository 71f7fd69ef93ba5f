"""Skew-safe ordered-sequence operators: LAG, LEAD, ROWS-frame averages, last known value.

A SQL window ``PARTITION BY key ORDER BY ts`` puts every row of a key into one
task; if one key holds a third of the data, so does that task.  These
operators give the same results while a hot key is cut into contiguous runs of
its order, each of which is a window partition of its own:

* a hash sample of (key, order), one row in ``ONE_IN``, shows which keys are hot
  (one small job, as a range partitioner runs one) and gives their cut points, at
  every ``PER_RUN``-th sampled row or further apart: at most two cuts a shuffle
  partition in all, whatever the data, so they can be broadcast;
* rows of hot keys look up their run by the cut points, and the ordinary window
  runs over (key, run): one shuffle, the same as without runs;
* across the edges of a run, one row (or the last n-1 values) a run passes
  through a window over the runs of a key and is joined back.

Without a hot key the plan is the plain window and nothing is carried.  Results
equal the single-window form for any cut points; they only control how work is
split.  The cut points follow the whole order, ties of the first column
included: a key that is hot within one hour, or one instant, is cut too.  Order
columns are given by name and ascend, nulls first; rows of a key that are equal
in all of them have no order of their own.  Keys may be null.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One row in so many is sampled; a run holds at least so many sampled rows.
ONE_IN, PER_RUN = 4096, 64


def _names(x):
    return [x] if isinstance(x, str) else list(x)


def _same(a: DataFrame, b: DataFrame, names) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b["_of_" + n]) for n in names])


class Runs:
    """A frame's rows with the run of their key that they belong to (``_run``; hot keys only)."""

    def __init__(self, df: DataFrame, keys, order, split: bool):
        self.df, self.keys, self.order, self.split = df, keys, order, split
        self.by = [*keys, "_run"] if split else keys

    def on(self, df: DataFrame) -> "Runs":
        """The same runs over a frame made from this one's (rows left out, columns added)."""
        return Runs(df, self.keys, self.order, self.split)

    def columns(self) -> list[str]:
        """The columns that a selection has to keep."""
        return ["_run", "_hot"] if self.split else []

    def plain(self) -> DataFrame:
        return self.df.drop("_run", "_hot")

    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def _carried(self, edges: DataFrame, col: Column) -> DataFrame:
        """A value a run of a hot key, joined to the run's rows as ``_carry``.

        Runs of hot keys number at most two a shuffle partition: they are broadcast."""
        carry = edges.select(*[F.col(c).alias("_of_" + c) for c in self.by], col.alias("_carry"))
        return self.df.join(F.broadcast(carry), _same(self.df, carry, self.by), "left").drop(*["_of_" + c for c in self.by])

    def _edges(self, value: Column) -> DataFrame:
        return self.df.where("_hot").groupBy(*self.by).agg(value.alias("_edge"))

    def neighbour(self, cols, step: int, prefix: str, marker: str | None = None) -> "Runs":
        """``cols`` of the row ``step`` places on (-1: before, 1: after), prefixed.

        ``marker``: boolean column, TRUE where there is such a row."""
        row, order = F.struct(*cols), F.struct(*self.order)
        near = F.lead(row, step).over(self.window())
        if self.split:
            edges = self._edges(F.max_by(row, order) if step < 0 else F.min_by(row, order))
            by_run = Window.partitionBy(*self.keys).orderBy("_run")
            b = self._carried(edges, F.lead("_edge", step).over(by_run)).withColumn("_near", near)
            b = b.withColumn("_near", F.coalesce("_near", "_carry")).drop("_carry")
        else:
            b = self.df.withColumn("_near", near)
        b = b.withColumns({prefix + c: F.col(f"_near.{c}") for c in cols} | ({marker: F.col("_near").isNotNull()} if marker else {}))
        return self.on(b.drop("_near"))

    def last_known(self, value: str, out: str) -> "Runs":
        """The last non-null ``value`` up to and with the row, as ``out``."""
        known = F.last(value, ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            return self.on(self.df.withColumn(out, known))
        edges = self._edges(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*self.order))))
        before = Window.partitionBy(*self.keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        b = self._carried(edges, F.last("_edge", ignorenulls=True).over(before))
        return self.on(b.withColumn(out, F.coalesce(known, "_carry")).drop("_carry"))

    def rolling_avg(self, value: str, n: int, out: str) -> "Runs":
        """``AVG(value) OVER (... ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW)`` as ``out``."""
        k, w = n - 1, self.window()
        frame = w.rowsBetween(-k, 0)
        if not self.split:
            return self.on(self.df.withColumn(out, F.avg(value).over(frame)))
        # a run hands over its last n-1 values; a run's first rows take what their frame lacks
        back = Window.partitionBy(*self.by).orderBy(*[F.desc(c) for c in self.order])
        tails = (self.df.where("_hot").withColumn("_at", F.row_number().over(back)).where(F.col("_at") <= k).groupBy(*self.by)
                 .agg(F.sort_array(F.collect_list(F.struct((-F.col("_at")).alias("p"), F.col(value).cast("double").alias("v")))).alias("_edge")))
        before = Window.partitionBy(*self.keys).orderBy("_run").rowsBetween(-max(k, 1), -1)
        b = self._carried(tails, F.flatten(F.collect_list(F.transform("_edge", lambda x: x["v"])).over(before)))
        b = b.withColumns({"_p": F.row_number().over(w) - 1, "_s": F.sum(value).over(frame), "_c": F.count(value).over(frame)})
        held = F.coalesce("_carry", F.array().cast("array<double>"))
        lacks = F.least(F.greatest(F.lit(k) - F.col("_p"), F.lit(0)), F.size(held))
        held = F.filter(F.slice(held, F.size(held) - lacks + 1, lacks), lambda x: x.isNotNull())
        total = F.coalesce(F.col("_s").cast("double"), F.lit(0.0)) + F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x)
        count = F.col("_c") + F.size(held)
        return self.on(b.withColumn(out, F.when(count > 0, total / count)).drop("_p", "_s", "_c", "_carry"))


def runs(df: DataFrame, keys, order, sample: DataFrame | None = None, one_in: int | None = None, per_run: int | None = None) -> Runs:
    """Cut the hot keys of ``df`` into runs.

    ``sample``: a cheaper frame with these key and order columns and about the
    same rows, to take the cut points from."""
    keys, order = _names(keys), _names(order)
    one_in, per_run = one_in or ONE_IN, per_run or PER_RUN
    spark = df.sparkSession
    some = (df if sample is None else sample).select(*keys, *order)
    some = some.where(F.pmod(F.xxhash64(*keys, *order), F.lit(one_in)) == 0)
    total, most = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    at_most = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(per_run, -(-(total or 0) // at_most))
    if (most or 0) < step:
        return Runs(df, keys, order, False)
    place = F.struct(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    cuts = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % step == 0)
    # a run is found in two steps: the group of cut points, then the point within it
    width = max(1, isqrt(most // step))
    points = cuts.groupBy(*[F.col(c).alias("_of_" + c) for c in keys]).agg(F.sort_array(F.collect_list(place)).alias("p"))
    groups = F.transform(F.sequence(F.lit(0), F.size("p") - 1, F.lit(width)), lambda i: F.slice("p", i + 1, width))
    points = points.select(*["_of_" + c for c in keys], groups.alias("_cuts"))
    group = F.size(F.filter("_cuts", lambda g: g[0] <= place))
    within = F.size(F.filter(F.get("_cuts", group - 1), lambda c: c <= place))
    run = F.when(group > 0, (group - 1) * width + within).otherwise(0)
    b = df.join(F.broadcast(points), _same(df, points, keys), "left")
    b = b.withColumns({"_hot": F.col("_cuts").isNotNull(), "_run": F.coalesce(F.when(F.col("_cuts").isNotNull(), run), F.lit(0))})
    # dealt out by run: rows that come shuffled by key alone would keep a hot key in one task
    return Runs(b.drop("_cuts", *["_of_" + c for c in keys]).repartition(*keys, "_run"), keys, order, True)


def lag_within(df: DataFrame, keys, order, cols, prefix: str = "prev_", marker: str | None = None, **cut) -> DataFrame:
    """``LAG(c) OVER (PARTITION BY keys ORDER BY order)`` for each c in ``cols``."""
    return runs(df, keys, order, **cut).neighbour(_names(cols), -1, prefix, marker).plain()


def lead_within(df: DataFrame, keys, order, cols, prefix: str = "next_", **cut) -> DataFrame:
    """``LEAD(c) OVER (PARTITION BY keys ORDER BY order)`` for each c in ``cols``."""
    return runs(df, keys, order, **cut).neighbour(_names(cols), 1, prefix).plain()


def rolling_avg(df: DataFrame, keys, order, value: str, n: int, out: str, **cut) -> DataFrame:
    """``AVG(value) OVER (... ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW)``."""
    return runs(df, keys, order, **cut).rolling_avg(value, n, out).plain()
