"""Labelled damage for training and tests.

Rows are picked by integer arithmetic on an explicit row id, so the same call
damages the same cells in every run, on every cluster and in plain SQL.  All
operators take ``(df, pct, row_id, seed)``; ``pct`` is a percentage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.ordering import bucket_count, row_positions
from dqspark.functions.scalars import col
from dqspark.operators.schema import numeric_columns

# Multipliers, tokens and severities of the damage.
OUTLIER_FACTORS = (10, -10, 100)
STRONG_FACTORS = (-100, 50, 100)
CLUSTER_FACTORS = (-50, 50, 100)
EXTREME = 999999
SEVERITIES = {"light": 5.0, "medium": 12.0, "severe": 25.0}
CLUSTER_SHARE = 0.3

PRIME = 1000003
MODULUS = 2147483647
STEP, MULTIPLIER, SALT_STEP = 48271, 16807, 7919
TURN_SALT = 4001


def draw(row_id: Column, salt: int) -> Column:
    """A repeatable number in 0..MODULUS-1 for a row."""
    start = F.pmod(row_id.cast("bigint"), F.lit(PRIME)) * STEP + salt * SALT_STEP
    return F.pmod(F.pmod(start, F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))


def picked(row_id: Column, pct: float, salt: int) -> Column:
    return F.pmod(draw(row_id, salt), F.lit(1000)) < int(round(pct * 10))


def one_of(row_id: Column, salt: int, values: Sequence) -> Column:
    """One of the values, independent of whether the row was picked."""
    place = F.pmod(F.floor(draw(row_id, salt) / 1000).cast("bigint"), F.lit(len(values)))
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def normal(row_id: Column, salt: int) -> Column:
    """A repeatable standard normal number for a row, from two draws."""
    size, turn = (F.lit(0.5) + draw(row_id, salt + k) for k in (0, TURN_SALT))
    return F.sqrt(-2.0 * F.log(size / MODULUS)) * F.cos(turn / MODULUS * (2 * math.pi))


def drawn_place(place: Column, salt: int, rows: int) -> Column:
    """A repeatable place in 0..rows-1 for a place."""
    return F.pmod(draw(place, salt) * MODULUS + draw(place, salt + TURN_SALT), F.lit(rows))


def _drawn_order(names: Sequence[str], seed: int) -> list[str]:
    def number(i: int) -> int:
        return ((i % PRIME) * STEP + seed * SALT_STEP) % MODULUS * MULTIPLIER % MODULUS
    return sorted(names, key=lambda n: number(names.index(n) + 1))


def _data(df: DataFrame, row_id: str, names: Sequence[str] | None = None) -> list[str]:
    return [c for c in (names or df.columns) if c != row_id]


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else col(c) for c in df.columns])


def _null(c: Column, test: Column) -> Column:
    return F.when(~test, c)


def _nulls(df, pct, row_id, seed=0, names=None) -> dict[str, Column]:
    return {n: _null(col(n), picked(col(row_id), pct, seed + i))
            for i, n in enumerate(_data(df, row_id, names), 1)}


def nulls(df, pct, row_id, seed=0, names=None):
    """Independent NULLs in every column."""
    return _replace(df, _nulls(df, pct, row_id, seed, names))


def numeric_nulls(df, pct, row_id, seed=0):
    """NULLs in numeric columns only."""
    return nulls(df, pct, row_id, seed, _data(df, row_id, numeric_columns(df)))


def clustered_nulls(df, pct, row_id, seed=0):
    """The same rows lose the same third of the columns."""
    data = _data(df, row_id)
    count = max(1, int(len(data) * CLUSTER_SHARE))
    test = picked(col(row_id), pct, seed + 1)
    return _replace(df, {n: _null(col(n), test) for n in _drawn_order(data, seed)[:count]})


def _column_nulls(df, pct, row_id, seed=0, row_pct=None) -> dict[str, Column]:
    data = _data(df, row_id)
    count = max(1, int(len(data) * pct / 100.0))
    share = pct if row_pct is None else row_pct
    return {n: _null(col(n), F.lit(True) if share >= 100 else picked(col(row_id), share, seed + i))
            for i, n in enumerate(_drawn_order(data, seed)[:count], 1)}


def column_nulls(df, pct, row_id, seed=0, row_pct=None):
    """A few columns lose many or (``row_pct=100``) all values."""
    return _replace(df, _column_nulls(df, pct, row_id, seed, row_pct))


def _copies(df: DataFrame, pct: float, row_id: str, salt: int) -> DataFrame:
    """Picked rows under fresh negative ids, so ids stay unique."""
    return _replace(df.where(picked(col(row_id), pct, salt)),
                    {row_id: F.lit(-1).cast(dict(df.dtypes)[row_id]) - col(row_id)})


def _ids(df: DataFrame, row_id: str, hit: Column) -> Column:
    """The id of a row, and below it a fresh negative one if the row is hit."""
    fresh = F.lit(-1).cast(dict(df.dtypes)[row_id]) - col(row_id)
    return F.explode(F.when(hit, F.array(col(row_id), fresh)).otherwise(F.array(col(row_id))))


def duplicates(df, pct, row_id, seed=0):
    """Picked rows appear twice, the second time under a fresh negative id; one scan."""
    return _replace(df, {row_id: _ids(df, row_id, picked(col(row_id), pct, seed + 1))})


def near_duplicates(df, pct, row_id, seed=0):
    """Picked rows appear again, some of their texts cut in half."""
    copies = _copies(df, pct, row_id, seed + 1)
    texts = [n for n, t in df.dtypes if t == "string" and n != row_id]
    original = F.lit(-1) - col(row_id)
    return df.unionByName(_replace(copies, {
        n: F.when(picked(original, 30, seed + 1 + i), _half(col(n))).otherwise(col(n))
        for i, n in enumerate(texts, 1)
    }))


def _half(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))


def _scaled(c: Column, kind: str, factor: Column) -> Column:
    return (c.cast("double") * factor).cast(kind) if kind == "double" else c.cast("double") * factor


def _outliers(df, pct, row_id, seed=0, factors=OUTLIER_FACTORS, names=None) -> dict[str, Column]:
    changes = {}
    for i, n in enumerate(_data(df, row_id, names or numeric_columns(df)), 1):
        factor = one_of(col(row_id), seed + i, [float(f) for f in factors])
        value = col(n).cast("double")
        changes[n] = F.when(picked(col(row_id), pct, seed + i), value * factor).otherwise(value)
    return changes


def outliers(df, pct, row_id, seed=0, factors=OUTLIER_FACTORS, names=None):
    """Numbers multiplied far out of their range; numeric columns become doubles."""
    return _replace(df, _outliers(df, pct, row_id, seed, factors, names))


def outlier_clusters(df, pct, row_id, seed=0):
    """Several numbers of the same row go out of range together."""
    names = _data(df, row_id, numeric_columns(df))
    if len(names) < 2:
        return df
    hit = picked(col(row_id), pct, seed + 1)
    first = F.pmod(draw(col(row_id), seed + 2), F.lit(len(names)))
    changes = {}
    for i, n in enumerate(names):
        always = (first == i) | (F.pmod(first + 1, F.lit(len(names))) == i)
        joins = always | picked(col(row_id), 50, seed + 3 + i)
        factor = one_of(col(row_id), seed + 3 + i, [float(f) for f in CLUSTER_FACTORS])
        value = col(n).cast("double")
        changes[n] = F.when(hit & joins, value * factor).otherwise(value)
    return _replace(df, changes)


def text_damage(df, pct, row_id, seed=0):
    """Texts cut in half or followed by ``###``."""
    texts = [n for n, t in df.dtypes if t == "string" and n != row_id]
    changes = {}
    for i, n in enumerate(texts, 1):
        c = col(n)
        broken = F.when(picked(col(row_id), 50, seed + 100 + i), _half(c)).otherwise(
            F.concat(c, F.lit("###")))
        changes[n] = F.when(picked(col(row_id), pct, seed + i) & (F.length(c) > 0), broken).otherwise(c)
    return _replace(df, changes)


def type_mismatch(df, pct, row_id, seed=0, word="INVALID", names=None):
    """Numeric columns become text and hold a word here and there."""
    return _replace(df, {
        n: F.when(picked(col(row_id), pct, seed + i), F.lit(word)).otherwise(col(n).cast("string"))
        for i, n in enumerate(_data(df, row_id, names or numeric_columns(df)), 1)
    })


def sign_flips(df, pct, row_id, seed=0):
    """Numbers with the wrong sign."""
    return _replace(df, {
        n: F.when(picked(col(row_id), pct, seed + i) & (col(n) != 0), -col(n)).otherwise(col(n))
        for i, n in enumerate(_data(df, row_id, numeric_columns(df)), 1)
    })


def extremes(df, pct, row_id, seed=0, columns=3):
    """The first numeric columns jump to plus or minus a huge constant."""
    names = _data(df, row_id, numeric_columns(df))[:columns]
    hit = picked(col(row_id), pct, seed + 1)
    return _replace(df, {
        n: F.when(hit, one_of(col(row_id), seed + 1 + i, [float(EXTREME), float(-EXTREME)]))
        .otherwise(col(n).cast("double"))
        for i, n in enumerate(names, 1)
    })


def beyond_max(df, pct, row_id, seed=0):
    """Numbers spread evenly over two to five times the column's maximum."""
    names = _data(df, row_id, numeric_columns(df))
    tops = df.agg(*[F.max(col(n)).cast("double").alias(f"m{i}") for i, n in enumerate(names)]).first()
    changes = {}
    for i, n in enumerate(names):
        place = draw(col(row_id), seed + 50 + i) / float(MODULUS)
        far = F.lit(tops[i]) * (2.0 + 3.0 * place)
        changes[n] = F.when(picked(col(row_id), pct, seed + 1 + i), far).otherwise(col(n).cast("double"))
    return _replace(df, changes)


def _noise(df, pct, row_id, spread: Sequence[float | None], seed=0, scale=1.0) -> dict[str, Column]:
    return {
        n: col(n).cast("double") + F.when(
            picked(col(row_id), pct, seed + i), normal(col(row_id), seed + 100 + i) * F.lit((spread[i - 1] or 0.0) * scale)
        ).otherwise(F.lit(0.0))
        for i, n in enumerate(_data(df, row_id, numeric_columns(df)), 1)}


def _deviations(names: Sequence[str]) -> list[Column]:
    return [F.stddev_samp(col(n)).alias(f"__s{i}") for i, n in enumerate(names)]


def noise(df, pct, row_id, seed=0, scale=1.0):
    """Normal noise with the column's own deviation on picked rows."""
    spread = df.agg(*_deviations(_data(df, row_id, numeric_columns(df)))).first()
    return _replace(df, _noise(df, pct, row_id, spread, seed, scale))


def drop_rows(df, pct, row_id, seed=0):
    return df.where(~picked(col(row_id), pct, seed + 1))


def damaged_names(df, seed=0):
    """Column names in lower case, upper case or with spaces."""
    out = []
    for i, n in enumerate(df.columns, 1):
        kind = ((i % PRIME) * STEP + seed * SALT_STEP) % MODULUS * MULTIPLIER % MODULUS % 3
        out.append((n.lower(), n.upper(), n.replace("_", " "))[kind])
    return df.toDF(*out)


def scrambled_codes(df, pct, row_id, code, year=None, seed=0):
    """A code becomes ``XXX``; a year gets a junk letter."""
    changes = {code: F.when(picked(col(row_id), pct, seed + 1), F.lit("XXX")).otherwise(col(code))}
    if year is not None:
        text = col(year).cast("string")
        changes[year] = F.when(picked(col(row_id), pct, seed + 2), F.concat(text, F.lit("X"))).otherwise(text)
    return _replace(df, changes)


def blanks(df, pct, row_id, seed=0, date=None):
    """Empty text, white space, half-empty rows and another date format, one kind per row."""
    texts = [n for n, t in df.dtypes if t == "string" and n != row_id]
    hit = picked(col(row_id), pct, seed + 1)
    kind = one_of(col(row_id), seed + 2, [0, 1, 2, 3])
    changes = {}
    for i, n in enumerate(_data(df, row_id), 1):
        c = col(n)
        mine = picked(col(row_id), 40, seed + 2 + i)
        out = F.when(hit & (kind == 2) & picked(col(row_id), 60, seed + 2 + i), F.lit(None))
        if n in texts:
            out = out.when(hit & (kind == 0) & mine, F.lit("")).when(hit & (kind == 1) & mine, F.lit("   "))
        if n == date:
            out = out.when(hit & (kind == 3), F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})$", "$2/$3/$1"))
        changes[n] = out.otherwise(c)
    return _replace(df, changes)


def mixed(df, pct, row_id, seed=0):
    """Nulls, outliers and duplicates together."""
    step = nulls(df, pct, row_id, seed)
    step = outliers(step, pct, row_id, seed + 20)
    return duplicates(step, pct, row_id, seed + 40)


def mixed_realistic(df, pct, row_id, seed=0):
    """Clustered gaps, near copies, row-wise outliers and sign flips, each milder."""
    step = clustered_nulls(df, pct * 0.6, row_id, seed)
    step = outlier_clusters(step, pct * 0.4, row_id, seed + 20)
    step = sign_flips(step, pct * 0.3, row_id, seed + 40)
    return near_duplicates(step, pct * 0.3, row_id, seed + 60)


@dataclass(frozen=True)
class Variant:
    """A damaged version of a table: steps ``(kind, pct, seed)`` in turn, then copies ``(pct, seed)``."""

    name: str
    label: int
    severity: str
    steps: tuple[tuple[str, float, int], ...] = ()
    copies: tuple[float, int] | None = None


_STEPS: dict[str, Callable[..., dict[str, Column]]] = {
    "nulls": _nulls, "outliers": _outliers, "column_nulls": _column_nulls}

# What each kind of the grid does, with the place of its seed behind the kind's own.
GRID: dict[str, tuple[tuple[tuple[str, int], ...], int | None]] = {
    "missing": ((("nulls", 0),), None),
    "duplicates": ((), 0),
    "outliers": ((("outliers", 0),), None),
    "inconsistency": ((("column_nulls", 0),), None),
    "mixed": ((("nulls", 0), ("outliers", 20)), 40),
}


def _as_doubles(df: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    numbers = set(_data(df, row_id, numeric_columns(df, keep)))
    return df.select(*[col(c).cast("double").alias(c) if c in numbers else col(c) for c in df.columns])


def _chosen(no: Column, cases: Sequence[tuple[int, Column]], other: Column) -> Column:
    out = other
    for k, value in reversed(cases):
        out = F.when(no == k, value).otherwise(out)
    return out


def _dealt(df: DataFrame, copies: int) -> DataFrame:
    """The rows dealt to as many tasks as their copies need: a small file's one task would make all of them."""
    return df.repartition(bucket_count(df.count() * copies * len(df.columns)))


def variants(df: DataFrame, row_id: str, plans: Sequence[Variant], keep: Sequence[str] = ()) -> DataFrame:
    """All variants of a table in one frame: ``dataset_id, label, severity`` first.

    Columns in ``keep`` stay as they are.

    The table is scanned once: a row is taken as many times as there are variants, and
    every copy goes the way of its own.  Noise needs the deviations of every variant as
    it is by then, which is one more scan for all of them.
    """
    names = [c for c in df.columns if c not in keep]
    base = _as_doubles(df.select(*[col(c) for c in names]), row_id)
    whole = _as_doubles(df, row_id, keep)
    data = _data(base, row_id)
    numbers = _data(base, row_id, numeric_columns(base))
    no = F.col("__variant")
    many = whole.select(F.explode(F.array(*[F.lit(k) for k in range(len(plans))])).alias("__variant"),
                        *[col(c) for c in df.columns])
    for turn in range(max((len(p.steps) for p in plans), default=0)):
        at = {k: p.steps[turn] for k, p in enumerate(plans) if turn < len(p.steps)}
        spread = {}
        noisy = [k for k, (kind, _, _) in at.items() if kind == "noise"]
        if noisy:
            spread = {r[0]: r[1:] for r in many.where(no.isin(noisy)).groupBy("__variant").agg(
                *_deviations(numbers)).collect()}
        cases: dict[str, list[tuple[int, Column]]] = {}
        for k, (kind, pct, seed) in at.items():
            made = (_noise(base, pct, row_id, spread.get(k, [None] * len(numbers)), seed) if kind == "noise"
                    else _STEPS[kind](base, pct, row_id, seed))
            for n, c in made.items():
                cases.setdefault(n, []).append((k, c))
        many = many.select("__variant", *[
            _chosen(no, cases[c], col(c)).alias(c) if c in cases else col(c) for c in df.columns])
    hits = [(k, picked(col(row_id), p.copies[0], p.copies[1] + 1)) for k, p in enumerate(plans) if p.copies]
    if hits:
        many = many.select("__variant", _ids(base, row_id, _chosen(no, hits, F.lit(False))).alias(row_id),
                           *[col(c) for c in df.columns if c != row_id])

    def told(values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), no)

    return many.select(
        told([p.name for p in plans]).alias("dataset_id"), told([p.label for p in plans]).alias("label"),
        told([p.severity for p in plans]).alias("severity"), *[col(c) for c in df.columns])


def severity_grid(df: DataFrame, row_id: str, *, kinds: Sequence[str] | None = None,
                  severities: dict[str, float] | None = None, seed: int = 0,
                  with_original: bool = True) -> DataFrame:
    """The table itself and every kind of damage at every severity, as ``variants`` gives them."""
    plans = [Variant("original", 1, "none")] if with_original else []
    for k, kind in enumerate(kinds or GRID):
        steps, copied = GRID[kind]
        own = seed + 1000 * k
        plans += [
            Variant(f"{kind}_{level}", 0, level, tuple((s, pct, own + at) for s, at in steps),
                    None if copied is None else (pct, own + copied))
            for level, pct in (severities or SEVERITIES).items()]
    return variants(_dealt(df, len(plans)), row_id, plans)


def intensity_ladder(df: DataFrame, row_id: str, steps: int = 15, good: int = 8,
                     seed: int = 0) -> DataFrame:
    """Bad variants from 15 to 50 percent and good ones with at most 1 percent gaps."""
    plans = []
    for i in range(steps):
        pct, own = 100 * (0.15 + (i / steps) * 0.35), seed + 100 * i
        plans.append(Variant(f"bad_{i}", 0, "", (("nulls", pct * 0.3, own), ("noise", pct * 0.2, own + 20)),
                             (pct * 0.2, own + 40)))
    plans += [Variant(f"good_{i}", 1, "", (("nulls", 1.0, seed + 7000 + i),) if i % 2 == 0 else ()) for i in range(good)]
    return variants(_dealt(df, len(plans)), row_id, plans).drop("severity")


def _drawn(df: DataFrame, row_id: str, draws: Sequence[tuple[str, int]]) -> DataFrame:
    """As many new rows as ``df`` has, each beside the rows drawn for it."""
    placed = row_positions(df, row_id, "__at")
    rows = df.count()
    fresh = placed.select(F.col("__at").alias("__new"))
    for name, salt in draws:
        source = placed.select(F.col("__at").alias(f"__{name}_at"),
                               *[col(c).alias(f"__{name}{i}") for i, c in enumerate(df.columns)])
        fresh = fresh.withColumn(f"__{name}_at", drawn_place(F.col("__new"), salt, max(rows, 1))).join(
            source, f"__{name}_at")
    return fresh


def bootstrap_good(df: DataFrame, row_id: str, seed: int = 0, share: float = 0.05) -> DataFrame:
    """Rows drawn with replacement under new ids from 0, numbers moved by a small part of their deviation."""
    names = _data(df, row_id, numeric_columns(df))
    spread = df.agg(*[F.stddev_samp(col(n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    drawn = _drawn(df, row_id, [("a", seed + 9000)])
    out = []
    for i, c in enumerate(df.columns):
        value = F.col(f"__a{i}")
        if c == row_id:
            value = F.col("__new")
        elif c in names:
            k = names.index(c)
            value = value.cast("double") + normal(F.col("__new"), seed + 100 + k) * F.lit((spread[k] or 0.0) * share)
        out.append(value.alias(c))
    return drawn.select(*out)


def interpolated_good(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """Rows between two drawn ones, under new ids from 0.

    Every number has a mixing share of its own; other values come from either row.
    """
    numbers = set(numeric_columns(df))
    drawn = _drawn(df, row_id, [("a", seed + 9000), ("b", seed + 9100)])
    out = []
    for i, c in enumerate(df.columns):
        one, two = F.col(f"__a{i}"), F.col(f"__b{i}")
        share = draw(F.col("__new"), seed + 200 + i) / float(MODULUS)
        if c == row_id:
            value = F.col("__new")
        elif c in numbers:
            value = one * share + two * (1 - share)
        else:
            value = F.when(share < 0.5, one).otherwise(two)
        out.append(value.alias(c))
    return drawn.select(*out)
