"""Ranks, positions and quantiles without a single-task window.

A window ordered over a whole column pulls that column into one task.  Here a
key is first cut into buckets at approximate quantiles.  The cut points are a
bounded list of literals, so a lost task recomputes the same buckets; they only
steer balance and never the result.  Values are counted before they are ranked,
so a value that holds a third of all rows is one row by then, and row order is
taken from a unique key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.scalars import col

# Rows that one task may hold comfortably while it sorts or hashes them.
ROWS_PER_TASK = 1_000_000
# Bounds on the cut points kept as literals, and so on every broadcast below.
MAX_BUCKETS = 20_000
MAX_CUTS = 100_000
SKETCH_ACCURACY = 10_000
# Bins per scan of an exact quantile, and the octaves they span.
BINS = 2_048
BIN_OCTAVES = 40


def bucket_count(rows: int, columns: int = 1) -> int:
    wanted = max(8, -(-rows // ROWS_PER_TASK))
    return int(min(wanted, MAX_BUCKETS, max(8, MAX_CUTS // max(1, columns))))


def cut_points(df: DataFrame, names: Sequence[str], buckets: int) -> dict[str, list[float]]:
    """Approximate, strictly increasing cut points per column.

    The sketch is merged task by task; the driver receives at most
    ``buckets`` numbers per column.
    """
    if not names:
        return {}
    shares = [i / buckets for i in range(1, buckets)]
    accuracy = max(SKETCH_ACCURACY, buckets * 8)
    row = df.agg(
        *[
            F.percentile_approx(col(n).cast("double"), shares, accuracy).alias(f"p{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    return {n: sorted({float(v) for v in (row[i] or [])}) for i, n in enumerate(names)}


def with_buckets(df: DataFrame, points: dict[str, list[float]]) -> tuple[DataFrame, dict[str, str]]:
    """Add one order-preserving bucket number per column: odd on a cut point, even between.

    A column without cut points is one bucket.
    """
    cut = [n for n in points if points[n]]
    inputs = {n: f"__k{i}" for i, n in enumerate(cut)}
    slots = {n: f"__s{i}" for i, n in enumerate(cut)}
    placed = df.select("*", *[col(n).cast("double").alias(k) for n, k in inputs.items()])
    if cut:
        placed = Bucketizer(
            splitsArray=[[float("-inf"), *points[n], float("inf")] for n in cut],
            inputCols=list(inputs.values()), outputCols=list(slots.values()), handleInvalid="keep",
        ).transform(placed)
    outs = {n: f"__b{i}" for i, n in enumerate(points)}
    numbers = []
    for n, out in outs.items():
        if not points[n]:
            numbers.append(F.lit(0).alias(out))
            continue
        # Slot s holds [cut s-1, cut s): its left end is told apart as "on the cut".
        lefts = F.array(*[F.lit(p) for p in points[n]])
        slot = F.col(slots[n]).cast("int")
        on_cut = (slot > 0) & (F.col(inputs[n]) == F.get(lefts, slot - 1))
        numbers.append(F.when(on_cut, slot * 2 - 1).otherwise(slot * 2).alias(out))
    return placed.select(*[col(c) for c in df.columns], *numbers), outs


def _before(cells: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Rows before each bucket: one row per group and bucket, a bounded table."""
    sizes = cells.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__size"))
    groups = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return sizes.select(
        *keys, bucket, "__size",
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy(*groups)).alias("__total"),
    )


def unpivot_numbers(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (),
                    buckets: dict[str, str] | None = None) -> DataFrame:
    """Rows ``(*keep, column, value[, bucket])``; NULL values are left out."""
    structs = []
    for n in names:
        fields = [F.lit(n).alias("column"), col(n).cast("double").alias("value")]
        if buckets:
            fields.append(F.col(buckets[n]).alias("bucket"))
        structs.append(F.struct(*fields))
    return (
        df.select(*[col(k) for k in keep], F.explode(F.array(*structs)).alias("__cell"))
        .select(*[col(k) for k in keep], "__cell.*")
        .where(F.col("value").isNotNull())
    )


def named(column: Column, names: Sequence[str]) -> Column:
    """The name behind a column's number."""
    return F.get(F.array(*[F.lit(n) for n in names]), column)


def known_positions(df: DataFrame, names: Sequence[str], row_id: str,
                    buckets: int | None = None) -> DataFrame:
    """Long rows ``(row_id, column, value, bucket, position, known)`` of all known values.

    ``column`` is the column's place in ``names``: numbers group faster than names do.
    ``position`` is the 0-based place of the row among the column's known
    values, ``known`` their number and ``bucket`` an order-preserving bucket of
    the value.  Positions are running counts on the wide rows: one window for
    all columns.
    """
    names = list(dict.fromkeys(names))
    rows = df.count()
    buckets = buckets or bucket_count(rows, len(names) + 1)
    wanted = list(dict.fromkeys([*names, row_id]))
    placed, outs = with_buckets(
        df.select(*[col(c) for c in wanted]), cut_points(df, wanted, buckets))
    row_bucket = outs[row_id]
    sizes = placed.groupBy(row_bucket).agg(
        *[F.count(col(n)).alias(f"__n{i}") for i, n in enumerate(names)])
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy(row_bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select(row_bucket, *[e for i in range(len(names)) for e in (
        F.coalesce(F.sum(f"__n{i}").over(earlier), F.lit(0)).alias(f"__start{i}"),
        F.sum(f"__n{i}").over(everything).alias(f"__known{i}"))]))
    running = Window.partitionBy(row_bucket).orderBy(col(row_id)).rowsBetween(
        Window.unboundedPreceding, 0)
    counted = placed.select("*", *[F.count(col(n)).over(running).alias(f"__run{i}")
                                   for i, n in enumerate(names)]).join(starts, row_bucket)
    cells = F.array(*[
        F.struct(F.lit(i).alias("column"), col(n).cast("double").alias("value"),
                 F.col(outs[n]).alias("bucket"),
                 (F.col(f"__start{i}") + F.col(f"__run{i}") - 1).alias("position"),
                 F.col(f"__known{i}").alias("known"))
        for i, n in enumerate(names)])
    return counted.select(col(row_id), F.inline(cells)).where(F.col("value").isNotNull())


def row_positions(df: DataFrame, key: str, out: str = "position",
                  buckets: int | None = None) -> DataFrame:
    """Add the 0-based position of every row by one unique numeric or time key."""
    rows = df.count()
    keyed = df.withColumn("__key", _as_number(df, key))
    points = cut_points(keyed, ["__key"], buckets or bucket_count(rows))
    placed, outs = with_buckets(keyed, points)
    bucket = outs["__key"]
    before = F.broadcast(_before(placed, [], bucket))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(col(key)))
    return placed.join(before, bucket).select(
        *[col(c) for c in df.columns], (F.col("__before") + place - 1).alias(out)
    )


def _as_number(df: DataFrame, key: str):
    kind = df.schema[key].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(col(key).cast("timestamp")).cast("double")
    return col(key).cast("double")


def forward_fill(df: DataFrame, names: Sequence[str], order: str,
                 buckets: int | None = None) -> DataFrame:
    """Last known value in the order of a unique key.

    Each bucket is filled on its own; the last known value of the buckets
    before it arrives through a table of one row per bucket.
    """
    rows = df.count()
    keyed = df.withColumn("__key", _as_number(df, order))
    points = cut_points(keyed, ["__key"], buckets or bucket_count(rows))
    placed, outs = with_buckets(keyed, points)
    bucket = outs["__key"]
    lasts = placed.groupBy(bucket).agg(
        *[F.max_by(col(n), F.when(col(n).isNotNull(), col(order))).alias(f"__last{i}")
          for i, n in enumerate(names)]
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = lasts.select(
        bucket,
        *[F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__carry{i}")
          for i in range(len(names))],
    )
    inside = Window.partitionBy(bucket).orderBy(col(order)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    filled = {
        n: F.coalesce(F.last(col(n), ignorenulls=True).over(inside), F.col(f"__carry{i}")).alias(n)
        for i, n in enumerate(names)
    }
    joined = placed.join(F.broadcast(carried), bucket, "left")
    return joined.select(*[filled.get(c, col(c)) for c in df.columns])


@dataclass
class _Interval:
    """Values of a column from ``low`` to ``high``, with ``below`` known values under ``low``."""

    name: str
    low: float
    high: float
    below: int

    def slot(self) -> Column:
        """Bin of a value, rising with it: the low end falls into the first bin, the high end into the last.

        Bins are even on a logarithmic scale above ``low``, so that heavy tails narrow as fast as
        even values do.  Very wide intervals are measured in halves to stay finite.
        """
        part = 0.5 if max(abs(self.low), abs(self.high)) > 1e300 else 1.0
        width = self.high * part - self.low * part
        share = (col(self.name).cast("double") * part - F.lit(self.low * part)) / F.lit(width)
        height = F.log2(F.greatest(share, F.lit(0.0)) * float(1 << BIN_OCTAVES) + 1)
        whole = math.log2((1 << BIN_OCTAVES) + 1)
        return F.least(F.floor(height / whole * BINS), F.lit(BINS - 1)).cast("int")

    def holds(self) -> Column:
        return col(self.name).cast("double").between(F.lit(self.low), F.lit(self.high))


def _narrowed(df: DataFrame, targets: dict[tuple[str, int], _Interval]) -> dict[tuple[str, int], _Interval]:
    """One scan: every rank's interval shrinks to the least and largest value of the bin that holds the rank."""
    open_ = {(t.name, t.low, t.high): t for t in targets.values() if t.low < t.high}
    number = {key: k for k, key in enumerate(open_)}
    cells = []
    for n in dict.fromkeys(t.name for t in open_.values()):
        spot = F.lit(None).cast("struct<k:int,bin:int,v:double>")
        # Intervals of one column do not overlap: they are bins of one interval before.
        for key, t in open_.items():
            if t.name == n:
                spot = F.when(t.holds(), F.struct(
                    F.lit(number[key]).alias("k"), t.slot().alias("bin"), col(n).cast("double").alias("v"))
                ).otherwise(spot)
        cells.append(spot)
    bins = (
        df.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.k", "c.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high"))
    )
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = {
        (number[t.name, t.low, t.high], rank - t.below): (name, rank)
        for (name, rank), t in targets.items() if t.low < t.high}
    # At most ``BINS`` rows per interval; the rows that hold a rank come to the driver.
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("long").alias("r")) for k, r in wanted])
    here = F.filter(ranks, lambda x: (x["k"] == F.col("k")) & (x["r"] >= F.col("before"))
                    & (x["r"] < F.col("before") + F.col("n")))
    out = dict(targets)
    for row in placed.withColumn("hit", F.explode(here)).select("hit", "low", "high", "before").collect():
        spot = wanted[row["hit"]["k"], row["hit"]["r"]]
        out[spot] = _Interval(spot[0], row["low"], row["high"], targets[spot].below + row["before"])
    return out


def quantiles(df: DataFrame, names: Sequence[str], shares: Sequence[float], *,
              approx: bool = False, rows: int | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, as driver-side numbers.

    Exact ones are found the same way at every size: the interval that holds a rank is cut into
    ``BINS`` bins and replaced by the bin that holds it, until its ends are one value.  Each round
    is one scan whose counts combine inside the tasks, so no task gathers a column's values.
    """
    names = list(dict.fromkeys(names))
    if not names:
        return {}
    if approx:
        row = df.agg(*[
            F.percentile_approx(col(n).cast("double"), list(shares), SKETCH_ACCURACY).alias(f"q{i}")
            for i, n in enumerate(names)
        ]).first()
        return {n: list(row[i]) if row[i] is not None else [None] * len(shares) for i, n in enumerate(names)}
    ends = df.agg(*[e for i, n in enumerate(names) for e in (
        F.count(col(n)).alias(f"n{i}"), F.min(col(n).cast("double")).alias(f"low{i}"),
        F.max(col(n).cast("double")).alias(f"high{i}"))]).first()
    known = {n: ends[f"n{i}"] for i, n in enumerate(names)}
    targets = {}
    for i, n in enumerate(names):
        for share in shares if known[n] else ():
            spot = (known[n] - 1) * share
            for rank in (math.floor(spot), math.ceil(spot)):
                targets[n, rank] = _Interval(n, ends[f"low{i}"], ends[f"high{i}"], 0)
    while any(t.low < t.high for t in targets.values()):
        targets = _narrowed(df, targets)

    def at(n: str, share: float) -> float | None:
        if not known[n]:
            return None
        spot = (known[n] - 1) * share
        low, high = targets[n, math.floor(spot)].low, targets[n, math.ceil(spot)].low
        return low + (high - low) * (spot - math.floor(spot))

    return {n: [at(n, share) for share in shares] for n in names}
