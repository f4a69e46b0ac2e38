"""Exact dedup over a cuckoo-filter index of live digests.

The filter holds short prints in buckets of four slots and supports deletion; the
index behind it holds the keys themselves, so a hit is verified before it counts,
and a filter that overflows is built anew, twice as large, from those keys.

Documents are digested on the JVM.  Map tasks index their own digests and pass on
one row per text, so a text that a third of all rows share leaves each task once;
the tasks that own a bucket of digests then merge these rows in an index of the
same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.llm.shared import keep, partitions, table, text_of

# Keys that a task's index holds before it passes them on and starts again.
KEYS_PER_INDEX = 200_000
# Digests that one bucket of the merged index takes.
ROWS_PER_BUCKET = 400_000


class CuckooFilter:
    """Set membership by 16-bit prints: no false negatives, few false positives, deletion allowed."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 1024):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mixed = hash(key)
        mark = (mixed >> 40 & 0xFFFF) or 1
        first = mixed & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ (mark * 0x5BD1E995 >> 7 & self.mask)

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return mark in self.slots[one] or mark in self.slots[two]

    def add(self, key: bytes) -> bool:
        """False if no place was found; the filter must then be built anew from its keys."""
        mark, one, two = self._places(key)
        for at in (one, two):
            if len(self.slots[at]) < self.SLOTS:
                self.slots[at].append(mark)
                return True
        at = two
        for kick in range(self.KICKS):
            seat = kick % self.SLOTS
            self.slots[at][seat], mark = mark, self.slots[at][seat]
            at = self._other(at, mark)
            if len(self.slots[at]) < self.SLOTS:
                self.slots[at].append(mark)
                return True
        return False

    def remove(self, key: bytes) -> None:
        """Only for a key that is in."""
        mark, one, two = self._places(key)
        self.slots[one if mark in self.slots[one] else two].remove(mark)


class DigestIndex:
    """Live keys with a value each, in front of them a cuckoo filter that grows by rebuilding."""

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.content: dict[bytes, object] = {}
        self.resizes = 0

    def __len__(self) -> int:
        return len(self.content)

    def find(self, key: bytes):
        """The value of a live key, or None; a print that fits is verified against the keys."""
        return self.content.get(key) if key in self.filter else None

    def insert(self, key: bytes, value) -> None:
        """Add a key, or give a live key another value."""
        if self.find(key) is None and not self.filter.add(key):
            self._grow()
            while not self.filter.add(key):
                self._grow()
        self.content[key] = value

    def delete(self, key: bytes) -> bool:
        if self.find(key) is None:
            return False
        self.filter.remove(key)
        del self.content[key]
        return True

    def _grow(self) -> None:
        size = len(self.filter.slots)
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.add(k) for k in self.content):
                return


GROUP = "digest BINARY, keep_id LONG, keep_row LONG, group_size LONG"


def _later(one: tuple, two: tuple) -> tuple:
    """The larger (doc_id, row); a null doc_id is smaller than any."""
    return max(one, two, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _grouping(flush_at: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge rows of ``GROUP`` by digest; beyond ``flush_at`` keys pass on what is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex()

        def rows() -> pa.RecordBatch:
            made = [(k, *v) for k, v in index.content.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in made], t) for i, t in enumerate((pa.binary(), *[pa.int64()] * 3))],
                ["digest", "keep_id", "keep_row", "group_size"])

        for batch in batches:
            for digest, doc, row, n in zip(*(c.to_pylist() for c in batch.columns)):
                was = index.find(digest)
                index.insert(digest, (doc, row, n) if was is None else (*_later(was[:2], (doc, row)), was[2] + n))
            if flush_at and len(index) >= flush_at:
                yield rows()
                index = DigestIndex()
        if len(index):
            yield rows()
    return run


def entries(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, digest)`` of all documents, kept; ``row`` tells repeated rows apart."""
    return keep(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_of(), 256)).alias("digest")), "digests")


def groups(live: DataFrame) -> DataFrame:
    """One row of ``GROUP`` per digest of ``live(doc_id, row, digest)``."""
    rows = live.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"),
                       F.lit(1).cast("long").alias("group_size"))
    partial = rows.mapInArrow(_grouping(KEYS_PER_INDEX), GROUP)
    buckets = partitions(live.sparkSession, live.count(), ROWS_PER_BUCKET)
    return partial.repartition(buckets, "digest").mapInArrow(_grouping(None), GROUP)


def change(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Live entries after a batch of changes; all three have ``(doc_id, row, digest)``.

    A deletion names doc_id and digest; a key both inserted and deleted is deleted.
    Keys hold the doc_id too, so a text with very many copies spreads over tasks.
    Deleting what is not live does nothing; entries with the same key are one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = DigestIndex(), []
        for batch in batches:
            for doc, row, digest, gone in zip(*(c.to_pylist() for c in batch.columns)):
                key = digest + repr(doc).encode()
                if gone:
                    out.append(key)
                elif index.find(key) is None or row < index.find(key)[1]:
                    index.insert(key, (doc, row, digest))
        for key in out:
            index.delete(key)
        made = list(index.content.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
            ["doc_id", "row", "digest"])

    columns = ["doc_id", "row", "digest"]
    both = (
        live.select(*columns, F.lit(False).alias("gone"))
        .union(inserted.select(*columns, F.lit(False)))
        .union(deleted.select("doc_id", F.lit(None).cast("long"), "digest", F.lit(True)))
    )
    n = partitions(live.sparkSession, both.count(), ROWS_PER_BUCKET)
    return both.repartition(n, "digest", "doc_id").mapInArrow(run, "doc_id LONG, row LONG, digest BINARY")


def mark_copies(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text counts as empty.  Of equal texts the
    row with the largest doc_id stays (a null doc_id is smaller than any); of rows
    that repeat the same doc_id too, exactly one stays.  Equality is that of SHA-256
    over the whole UTF-8 text.  Columns other than doc_id and text are not looked at.
    """
    live = entries(docs)
    found = keep(groups(live), "groups").withColumnRenamed("digest", "found")
    return live.join(found, F.col("digest") == F.col("found")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents, by the cuckoo-filter index."""
    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
