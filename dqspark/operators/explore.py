"""Looking at a table: filters, search, sorting and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import col, to_number

PAGE_ROWS = 25
PREVIEW_ROWS = 5
# Rows that a page's range may have when it is sorted, and how ranges are cut.
RANGE_ROWS = 100_000
CUTS, SAMPLED = 64, 32


def equal_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Rows that match every given value; unknown columns are ignored."""
    for n, v in filters.items():
        if n in df.columns:
            df = df.where(col(n) == F.lit(v))
    return df


def search(df: DataFrame, term: str, names: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any (visible) column contains the term, in any letter case."""
    if not term.strip():
        return df
    lowered = term.lower()
    test: Column = F.lit(False)
    for n in names or df.columns:
        test = test | F.coalesce(F.lower(col(n).cast("string")).contains(lowered), F.lit(False))
    return df.where(test)


def visible(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[col(n) for n in df.columns if n in names])


def number_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns as numbers, rows with both only."""
    types = dict(df.dtypes)

    def number(n: str) -> Column:
        return to_number(col(n)) if types[n] == "string" else col(n).cast("double")

    return df.select(number(x).alias(x), number(y).alias(y)).dropna()


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits, however long, compare as numbers.

    A run goes without its leading zeros and after the number of its digits.
    """
    def part(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+(?=.)", "")
        return F.when(piece.rlike(r"^\d"), F.concat(
            F.lpad(F.char_length(digits).cast("string"), 10, "0"), digits)).otherwise(piece)

    pieces = F.regexp_extract_all(F.lower(c.cast("string")), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(pieces, part), "")


def natural_sort(df: DataFrame, name: str, row_id: str, descending: bool = False) -> DataFrame:
    """Number-aware order; missing values come last both ways."""
    key = natural_key(col(name))
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(order, col(row_id))


def plain_sort(df: DataFrame, name: str, row_id: str, descending: bool = False) -> DataFrame:
    order = col(name).desc_nulls_last() if descending else col(name).asc_nulls_last()
    return df.orderBy(order, col(row_id))


def page(ordered: DataFrame, number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """A page (from 1) near the start of an ordered table; ``Pages`` reaches far ones."""
    return ordered.offset((number - 1) * rows).limit(rows)


@dataclass(frozen=True)
class Spot:
    """A place in the order of a key, then of a row id; a null key comes last."""

    key: Any
    row_id: Any


class Pages:
    """Pages of a table in the order of a key and a unique row id, each read from the key range that holds it.

    Rows are counted per key range: ``CUTS`` places taken from a bounded sample cut the
    table, and the range that holds a page is cut again until it has at most ``range_rows``
    rows.  Only that range is sorted.  The sample steers how even ranges are and never the
    result; the counts stay with the object, so turning pages reads the table once more
    only where a new range has to be cut.  Rounds grow with the logarithm of the rows.
    """

    def __init__(self, df: DataFrame, key: Column, row_id: str, descending: bool = False,
                 range_rows: int = RANGE_ROWS):
        self.df, self.descending, self.range_rows, self.row_id = df, descending, range_rows, row_id
        self.keyed = df.select("*", key.alias("__key"))
        self.rows = df.count()
        self._counts: dict[tuple[Spot | None, Spot | None], list[tuple[Spot | None, Spot | None, int]]] = {}

    def _before(self, spot: Spot) -> Column:
        """Does a row come before the spot?"""
        key, row_id = F.col("__key"), col(self.row_id)
        if spot.key is None:
            return key.isNotNull() | (row_id < F.lit(spot.row_id))
        at = F.lit(spot.key)
        ahead = key > at if self.descending else key < at
        return key.isNotNull() & (ahead | ((key == at) & (row_id < F.lit(spot.row_id))))

    def _within(self, low: Spot | None, high: Spot | None) -> DataFrame:
        out = self.keyed
        if low is not None:
            out = out.where(~self._before(low))
        return out if high is None else out.where(self._before(high))

    def _order(self) -> list[Column]:
        key = F.col("__key")
        return [key.desc_nulls_last() if self.descending else key.asc_nulls_last(), col(self.row_id)]

    def _ranges(self, low: Spot | None, high: Spot | None) -> list[tuple[Spot | None, Spot | None, int]]:
        """The ranges between two places with their rows, in order."""
        if (low, high) not in self._counts:
            inside = self._within(low, high)
            sample = inside.select("__key", col(self.row_id).alias("__id")).orderBy(
                F.xxhash64("__id"), "__id").limit(CUTS * SAMPLED).select("__key", F.col("__id").alias(self.row_id))
            taken = [Spot(*r) for r in sample.orderBy(*self._order()).collect()]
            cuts = sorted({(i * len(taken)) // CUTS for i in range(1, CUTS)} - {0})
            spots = list(dict.fromkeys(taken[i] for i in cuts))
            ends = [low, *spots, high]
            sizes = {r[0]: r[1] for r in inside.groupBy(self._place(spots, 0).alias("at")).count().collect()}
            self._counts[low, high] = [(ends[i], ends[i + 1], sizes.get(i, 0)) for i in range(len(ends) - 1)]
        return self._counts[low, high]

    def _place(self, spots: Sequence[Spot], first: int) -> Column:
        """The number of the range that a row falls into, found by halving."""
        if not spots:
            return F.lit(first)
        half = len(spots) // 2
        return F.when(self._before(spots[half]), self._place(spots[:half], first)).otherwise(
            self._place(spots[half + 1:], first + half + 1))

    def find(self, start: int, rows: int) -> tuple[Spot | None, Spot | None, int, int]:
        """The range that holds rows ``start`` to ``start + rows``: its ends, the rows before it, and its rows."""
        low = high = None
        before, size = 0, self.rows
        while size > max(self.range_rows, rows):
            at, chosen = before, []
            for one, two, n in self._ranges(low, high):
                if at + n > start and at < start + rows:
                    chosen.append((one, two, at, n))
                at += n
            if not chosen:
                break
            held = sum(n for _, _, _, n in chosen)
            if held == size:
                # Nothing left to cut by: as many rows as this share one key and id.
                break
            low, high, before, size = chosen[0][0], chosen[-1][1], chosen[0][2], held
        return low, high, before, size

    def page(self, number: int, rows: int = PAGE_ROWS) -> DataFrame:
        """A page, from 1; empty beyond the last row."""
        start = (number - 1) * rows
        if start >= self.rows:
            return self.df.limit(0)
        low, high, before, _ = self.find(start, rows)
        held = self._within(low, high).orderBy(*self._order())
        return held.offset(start - before).limit(rows).drop("__key")


def bounded(df: DataFrame, row_id: str, rows: int = 1000) -> DataFrame:
    """The first rows by id."""
    return df.orderBy(col(row_id)).limit(rows)


def preview(df: DataFrame, row_id: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as text."""
    return bounded(df, row_id, rows).select(*[col(c).cast("string").alias(c) for c in df.columns])


def top_by(df: DataFrame, measure: str, tie: str, rows: int) -> DataFrame:
    return df.orderBy(col(measure).desc_nulls_last(), col(tie)).limit(rows)


def by_completeness(bands: DataFrame, descending: bool = False) -> DataFrame:
    order = F.col("percentage").desc() if descending else F.col("percentage").asc()
    return bands.orderBy(order, "column")
