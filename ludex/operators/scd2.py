"""Slowly changing dimension, type 2 (price history per app and currency).

Semantics (one key = e.g. (app_id, currency_code)):
* a feed row opens a new version iff its tracked values differ null-safely
  from the previous feed row of the key (the first row always opens one);
* ``valid_to`` of a version is ``valid_from`` of the next one; the last
  version is current (``valid_to`` NULL);
* rows with the same timestamp in one feed leave zero-length versions
  (``valid_from == valid_to``), which ``as_of`` never returns;
* A -> B -> A gives three versions; an unchanged state is a no-op.

Change flags and ``valid_to`` are computed over the runs of ``sequence``: a key
with a third of all rows is cut at sampled points of its order and split over
many tasks instead of one window partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.operators.sequence import runs


def _changed(tracked) -> Column:
    diffs = [~F.col(c).eqNullSafe(F.col("prev_" + c)) for c in tracked]
    return reduce(lambda a, b: a | b, diffs)


def collapse(feed: DataFrame, keys, tracked, ts: str, tiebreak=(), keep=(), **cut) -> DataFrame:
    """Versions from an ordered feed.

    Returns ``keys + tracked + keep + [valid_from, valid_to, is_current]``.
    ``tiebreak`` completes the order after ``ts`` so the result is deterministic.

    LAG over the feed finds the rows that change something, LEAD over those
    rows alone closes them; both use one partitioning.  ``cut`` goes to
    ``sequence.runs`` (``sample``: a frame with the keys, ``ts`` and ``tiebreak``).
    """
    keys, tracked, keep = list(keys), list(tracked), list(keep)
    # a tracked column that breaks ties is carried once
    names = [c if c in tracked else f"_tb{i}" for i, c in enumerate(tiebreak)]
    order = ["valid_from", *names]
    named = [F.col(ts).alias("valid_from"), *[F.col(c).alias(n) for c, n in zip(tiebreak, names)]]
    if cut.get("sample") is not None:
        cut = cut | {"sample": cut["sample"].select(*keys, *named)}
    extra = [named[0], *[c for c, n in zip(named[1:], names) if n not in tracked]]
    f = runs(feed.select(*keys, *tracked, *keep, *extra), keys, order, **cut)
    f = f.neighbour(tracked, -1, "prev_", marker="_has")
    opens = f.on(f.df.filter(~F.col("_has") | _changed(tracked))
                 .select(*keys, *tracked, *keep, *[c for c in order if c not in tracked], *f.columns()))
    out = opens.neighbour(["valid_from"], 1, "_next_").df
    valid_to = F.col("_next_valid_from")
    return out.select(*keys, *tracked, *keep, "valid_from", valid_to.alias("valid_to"),
                      valid_to.isNull().alias("is_current"))


def advance(cur: DataFrame, batch: DataFrame, keys, tracked, ts: str, tiebreak=()) -> tuple[DataFrame, DataFrame]:
    """Versions from the stored current rows ``cur`` and a new batch, and the late rows.

    Only current rows are compared, so closed history needn't be read.  The first
    frame has every key of ``cur`` or the batch: its current row, and the versions that the
    batch closes.  Batch rows older than the stored current ``valid_from`` are late.
    ``cur`` is read twice: pass a stored table or a checkpointed frame.
    """
    keys, tracked, tiebreak = list(keys), list(tracked), list(tiebreak)
    types = {f.name: f.dataType for f in batch.schema.fields}
    extra = [c for c in tiebreak if c not in (*keys, *tracked, ts)]
    seed = cur.select(*keys, *tracked, F.col("valid_from").alias(ts),
                      *[F.lit(None).cast(types[c]).alias(c) for c in extra],
                      F.lit(0).alias("_src"))
    starts = cur.select(*keys, F.col("valid_from").alias("_cur_from"))
    b = batch.select(*keys, *tracked, ts, *extra)
    b = b.join(starts, keys, "left")
    late = b.filter(F.col(ts) < F.col("_cur_from")).drop("_cur_from")
    fresh = (b.filter(F.col("_cur_from").isNull() | (F.col(ts) >= F.col("_cur_from")))
              .drop("_cur_from").withColumn("_src", F.lit(1)))
    feed = seed.unionByName(fresh)
    # nearly all rows of the feed are the batch's: cut points come from it, before the join
    sample = batch.select(*keys, ts, *tiebreak).withColumn("_src", F.lit(1))
    versions = collapse(feed, keys, tracked, ts, tiebreak=["_src", *tiebreak], sample=sample)
    return versions.select(*keys, *tracked, "valid_from", "valid_to", "is_current"), late


def apply(history: DataFrame, batch: DataFrame, keys, tracked, ts: str,
          tiebreak=()) -> tuple[DataFrame, DataFrame]:
    """Merge a new batch into stored history (the set form of an upsert).

    The stored current row of each key seeds the comparison, so an unchanged
    state is a no-op and a change closes the current row at the new row's
    time.  Batch rows older than the stored current ``valid_from`` are late:
    they are returned in the second frame and not applied.
    Returns ``(new_history, late_rows)``.

    ``history`` is read several times (current rows, their starts, closed
    rows): pass a stored table or a checkpointed frame, not a long lazy plan.
    """
    versions, late = advance(current(history), batch, keys, tracked, ts, tiebreak)
    closed = history.filter(~F.col("is_current"))
    return closed.select(*versions.columns).unionByName(versions), late


def as_of(history: DataFrame, at) -> DataFrame:
    """versions valid at ``at`` (half-open ``[valid_from, valid_to)``)."""
    t = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    return history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def current(history: DataFrame, currency: str | None = None, currency_col: str = "currency_code") -> DataFrame:
    """current rows (optionally of one currency)."""
    df = history.filter(F.col("is_current"))
    return df if currency is None else df.filter(F.col(currency_col) == currency)


def as_of_join(facts: DataFrame, history: DataFrame, keys, fact_ts: str, cols, **cut) -> DataFrame:
    """Attach to every fact the version valid at the fact's time.

    Facts and version starts are merged into one time-ordered stream per key;
    the last version start at or before each fact is carried forward, within
    and across the runs of a hot key.  This is linear in rows (a sort), unlike
    a range join that compares every fact with every version of its key.
    Versions are gap-free, so the carried version is the valid one;
    zero-length versions are never valid and are left out.  A fact before the
    first version gets NULLs.
    """
    keys, cols = list(keys), list(cols)
    vtype = history.select(F.struct(*[F.col(c) for c in cols]).alias("s")).schema["s"].dataType
    f = (facts.withColumn("_kind", F.lit(1)).withColumn("_t", F.col(fact_ts))
              .withColumn("_v", F.lit(None).cast(vtype)))
    live = history.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    v = live.select(*keys, F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"),
                    F.struct(*[F.col(c) for c in cols]).alias("_v"))
    merged = runs(f.unionByName(v, allowMissingColumns=True), keys, ["_t", "_kind"], **cut)
    out = merged.last_known("_v", "_cv").df.filter(F.col("_kind") == 1)
    return out.select(*facts.columns, *[F.col(f"_cv.{c}").alias(c) for c in cols])
