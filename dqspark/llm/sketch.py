"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every shingle hash in the lowest ``1 / scale`` of the hash range is kept, so a
sketch grows with its document, sketches of parts merge by union, and the share of
a small document that lies within a very large one can be estimated from both
sketches alone.  A text whose hashes all lie above the threshold keeps its least
hash, so only texts without words have an empty sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqspark.llm.shared import BLANKS_CLASS, ascii_lower, keep, table, text_of

SHINGLE = 5
SCALE = 4


def threshold(scale: int) -> int:
    """Hashes, as signed 64-bit numbers, below this one are kept."""
    return -(1 << 63) + (1 << 64) // scale


def word_array(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), BLANKS_CLASS + "+"), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _lowest(hashes: Column, scale: int) -> Column:
    return bound(
        F.filter(hashes, lambda h: h < threshold(scale)),
        lambda low: F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(
            F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())))


def sketch(text: Column, width: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of all runs of ``width`` words (of the whole text if shorter) below the threshold."""
    def hashed(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return bound(bound(word_array(text), hashed), lambda hashes: _lowest(hashes, scale))


def merge(one: Column, two: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return bound(F.array_union(one, two), lambda both: _lowest(both, scale))


def _shared(one: Column, two: Column) -> Column:
    return F.size(F.array_intersect(one, two))


def containment(one: Column, two: Column) -> Column:
    """The estimated share of the smaller text's shingles found in the other: 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(one), F.size(two))
    return F.when(least > 0, _shared(one, two) / least).otherwise(
        F.when(F.size(one) == F.size(two), 1.0).otherwise(0.0))


def resemblance(one: Column, two: Column) -> Column:
    """The estimated share of common shingles among all of both: 1 for two empty sketches."""
    union = F.size(F.array_union(one, two))
    return F.when(union > 0, _shared(one, two) / union).otherwise(1.0)


def as_text(found: Column) -> Column:
    """The hashes in order, 16 hex digits each."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


ORDER = ("is_known", "known_id", "th")


def _ordered(docs: DataFrame) -> DataFrame:
    """Texts with their place in the order: null ids first, then by id, rows of one id by text hash."""
    return docs.select("doc_id", text_of().alias("text")).select(
        "*", F.col("doc_id").isNotNull().cast("int").alias("is_known"),
        F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.xxhash64("text").alias("th"))


def neighbours(docs: DataFrame) -> DataFrame:
    """``(*ORDER, n, prev, prev_n)``: each distinct document's key, its predecessor's key and length, in a ring.

    Keys are sorted into ranges; a window works within a range, and a table of one row
    per range links each range's first key to the last one of the range before it.
    """
    keys = _ordered(docs).select(*ORDER, F.char_length("text").alias("n")).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(keys.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "keys")
    me = F.struct(*ORDER, "n")
    in_range = Window.partitionBy("part").orderBy(*ORDER)
    linked = ranged.withColumn("before", F.lag(me).over(in_range))
    ends = ranged.groupBy("part").agg(F.max(me).alias("last"))
    all_ranges = Window.orderBy("part")  # one row per range
    round_trip = F.lag("last").over(all_ranges)
    last_of_all = F.last("last").over(all_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select(F.col("part"), F.coalesce(round_trip, last_of_all).alias("left"))
    joined = linked.join(ends, "part").withColumn("before", F.coalesce("before", "left"))
    return joined.select(*ORDER, "n", F.struct(*[F.col(f"before.{c}").alias(c) for c in ORDER]).alias("prev"),
                         F.col("before.n").alias("prev_n"))


def edited_pairs(docs: DataFrame, width: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Every document beside its edited text and both sketches, and the next document's sketch.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as
    many (or all) of the next document, by ascending doc_id; after the last comes the
    first, and a lone document is its own next.  A null text is empty.  Null doc_ids
    come first; rows that repeat a doc_id are ordered by a hash of their texts, and
    rows equal in both have one and the same next.  Other columns are not looked at.

    A text is shuffled once to meet its key, and what the predecessor needs of it (half
    of the predecessor's length at most, and the sketch) once more.
    """
    ring = keep(neighbours(docs), "ring").withColumnsRenamed({c: f"k_{c}" for c in ORDER})
    texts = _ordered(docs)
    same = [F.col(c) == F.col(f"k_{c}") for c in ORDER]
    met = texts.join(ring, same).select("doc_id", *ORDER, "text", "n", "prev", "prev_n")
    sent = met.dropDuplicates(list(ORDER)).select(
        F.col("doc_id").alias("next_id"), *[F.col(f"prev.{c}").alias(f"to_{c}") for c in ORDER],
        F.substr("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("start"),
        sketch(F.col("text"), width, scale).alias("next_own"))
    half = F.floor(F.col("n") / 2).cast("int")
    return met.join(sent, [F.col(c) == F.col(f"to_{c}") for c in ORDER]).select(
        "doc_id", "next_id", F.col("n").cast("long").alias("n_chars"), "next_own",
        F.concat(F.substr("text", F.lit(1), F.col("n") - half), "start").alias("edited"),
        sketch(F.col("text"), width, scale).alias("own"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts."""
    pairs = edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "*", sketch(F.col("edited")).alias("other"))
    return pairs.select(
        "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("other")).alias("near_edited"),
        containment(F.col("own"), F.col("next_own")).alias("near_next"),
        resemblance(F.col("own"), F.col("other")).alias("jaccard_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("jaccard_next"))
