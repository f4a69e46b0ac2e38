"""Spelling variants: words one error apart, found by search schemes in bidirectional FM-indexes.

Of two words one error apart, one half of the searched word stands unchanged at the
same end of the other.  So every word is dealt by its possible first halves and last
halves, and a task that gets all words of some halves builds a bidirectional index
over just these words: each scheme matches its half exactly and extends across the
other allowing one error.  A half that very many words share is cut into pieces, and
each pair of pieces is a group of its own; no task's index grows with the table.

A pair found from a word's first half is not counted again from its last, so what a
task says of a word (number of near words, the most frequent one) adds up over tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.llm.fm_index import BidirectionalIndex
from dqspark.llm.shared import drop_kept, keep, partitions, table, text_of

LEAST_CHARS = 7
LEAST_COUNT = 2
# A word is a variant of a near word that occurs so many times as often.
RATIO = 10
# One run in so many loses a letter.
DAMAGE = 31
# Words of one half that meet in one group, at the most on the average of its pieces.
HALF_WORDS = 10_000
# Rows and symbols that a task indexes together, whole groups at a time.
INDEX_ROWS = 60_000
INDEX_SYMBOLS = 1_500_000
# Words whose counts a task holds before it passes them on.
COUNTED = 400_000
# Latin-1 letters as the words have them: A-Z lower-cased, all else between runs a space.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(doc_id: int, run: bytes, start: int) -> bytes:
    """The run, less one letter where crc32 of ``<doc_id>:<run>`` says so; ``start`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of whole texts with their occurrences, counted inside tasks first.

    A null text has no words; a null doc_id writes itself as an empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            made = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(runs_of(text)).items():
                    word = damaged(doc, found, start)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= COUNTED:
                    yield passed()
        yield passed()

    plain = docs.select(F.col("doc_id").cast("long"), text_of())
    return plain.mapInArrow(run, "word STRING, n LONG").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def dealt(words: DataFrame) -> DataFrame:
    """``half, i, j, word, n, item, first, last``: each word in the groups where halves of it can meet.

    In a group, words of piece i are items and words of piece j ask, by their first
    half or their last.  A word of L letters can match a half of words of L - 1 to
    L + 1 letters, and asks with its own.
    """
    size = F.char_length("word")
    firsts = F.array_distinct(F.array(*[F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]))
    lasts = F.array_distinct(F.array(*[F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1)]))
    nothing = F.lit(False)
    halves = F.concat(
        F.transform(firsts, lambda k: F.struct(
            F.xxhash64(F.lit(0), F.substring(F.col("word"), F.lit(1), k)).alias("half"),
            (k == F.floor(size / 2)).alias("first"), nothing.alias("last"))),
        F.transform(lasts, lambda k: F.struct(
            F.xxhash64(F.lit(1), F.substring(F.col("word"), size - k + 1, k)).alias("half"),
            nothing.alias("first"), (k == F.ceil(size / 2)).alias("last"))))
    rows = words.select("word", "n", F.explode(halves).alias("h")).select(
        "word", "n", "h.half", "h.first", "h.last")
    hot = keep(rows.groupBy("half").agg(F.count("*").alias("met")).where(F.col("met") > HALF_WORDS).select(
        F.col("half").alias("hot_half"), F.ceil(F.col("met") / HALF_WORDS).cast("int").alias("pieces")), "hot-halves")
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    cut = rows.join(hot, F.col("half") == F.col("hot_half"), "left").withColumn(
        "pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", own)
    asks = F.col("first") | F.col("last")
    others = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    met = cut.withColumn("met", others)
    # As an item of its own piece beside every asking piece, and asking beside every other piece of items.
    part = F.explode(F.when(F.col("met") == F.col("own"), F.array(
        F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(True).alias("item"), asks.alias("asks")))
    ).otherwise(F.array(
        F.struct(F.col("own").alias("i"), F.col("met").alias("j"), F.lit(True).alias("item"), nothing.alias("asks")),
        F.struct(F.col("met").alias("i"), F.col("own").alias("j"), nothing.alias("item"), asks.alias("asks")))))
    return met.withColumn("part", part).where("part.item OR part.asks").select(
        "half", "part.i", "part.j", "word", "n", "part.item",
        (F.col("first") & F.col("part.asks")).alias("first"), (F.col("last") & F.col("part.asks")).alias("last"))


def search(group: np.ndarray, words: list[bytes], item: np.ndarray, first: np.ndarray,
           last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(asking row, item row)`` of all near pairs of rows that stand in the same group."""
    different = sorted({words[k] for k in np.flatnonzero(item)})
    place = {w: k for k, w in enumerate(different)}
    index = BidirectionalIndex(different)
    rows = np.flatnonzero(item)
    # A word stands once in a group.
    held = group[rows] * len(different) + np.array([place[words[k]] for k in rows], np.int64)
    order = np.argsort(held)
    held, rows = held[order], rows[order]
    asked, found = [], []
    for asking, backwards in ((first, False), (last, True)):
        asks = np.flatnonzero(asking)
        query, word = index.one_error([words[k] for k in asks], backwards)
        wanted = group[asks[query]] * len(different) + word
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        here = held[at] == wanted if len(wanted) else np.empty(0, bool)
        one, two = asks[query[here]], rows[at[here]]
        if backwards:
            # These were found from the first half.
            again = np.array([words[b].startswith(words[a][:len(words[a]) // 2]) for a, b in zip(one, two)], bool)
            one, two = one[~again], two[~again]
        asked.append(one)
        found.append(two)
    return np.concatenate(asked), np.concatenate(found)


def nearest(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of ``words(word, n)``: each word once, with its most frequent near word.

    Of equally frequent near words the smallest in code-point order counts.
    """
    rows = words.count()
    group = ["half", "i", "j"]
    spread = partitions(words.sparkSession, 5 * rows, 2 * INDEX_ROWS)
    ready = dealt(words).repartition(spread, *group).sortWithinPartitions(*group)

    def work(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        half, i, j = [whole.column(k).to_numpy() for k in range(3)]
        texts = whole.column(3).to_pylist()
        words = [w.encode("latin-1") for w in texts]
        n = whole.column(4).to_numpy()
        item, first, last = [whole.column(k).to_numpy() for k in (5, 6, 7)]
        fresh = np.zeros(len(half), np.int64)
        fresh[1:] = (half[1:] != half[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        asks = np.flatnonzero(first | last)
        count, best = np.zeros(len(half), np.int64), np.full(len(half), -1, np.int64)
        if item.any():
            one, two = search(np.cumsum(fresh), words, item, first, last)
            count = np.bincount(one, minlength=len(half))
            rank = np.empty(len(half), np.int64)
            rank[sorted(range(len(half)), key=words.__getitem__)] = np.arange(len(half))
            order = np.lexsort((rank[two], -n[two], one))
            lead = np.flatnonzero(np.diff(one[order], prepend=-1))
            best[one[order][lead]] = two[order][lead]
        form = [texts[b] if b >= 0 else None for b in best[asks].tolist()]
        form_n = [int(n[b]) if b >= 0 else None for b in best[asks].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([texts[k] for k in asks], pa.string()), pa.array(n[asks]), pa.array(count[asks]),
             pa.array(form, pa.string()), pa.array(form_n, pa.int64())],
            ["word", "n", "n_near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = symbols = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            symbols += batch.column(3).nbytes
            if size < INDEX_ROWS and symbols < INDEX_SYMBOLS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = [whole.column(c).to_numpy() for c in group]
            behind = np.logical_or.reduce([k != k[-1] for k in keys])
            cut = int(np.flatnonzero(behind)[-1]) + 1 if behind.any() else 0
            if cut:
                yield from work(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            size, symbols = whole.num_rows - cut, sum(b.column(3).nbytes for b in held)
        if size:
            yield from work(pa.Table.from_batches(held))

    told = ready.mapInArrow(run, "word STRING, n LONG, n_near LONG, form STRING, form_n LONG")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return told.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where following forms ends.

    Every round follows twice as many forms as the one before; a form occurs
    ``RATIO`` times as often as its word, so rounds grow with the logarithm of the
    logarithm of the largest count.
    """
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = now.select(F.col("word").alias("passed"), F.col("root").alias("beyond"))
        after = keep(now.join(beyond, F.col("root") == F.col("passed"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        drop_kept(now)
        now = after
        if not moved:
            return after.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs(doc_id, text)``.

    Words have at least ``LEAST_CHARS`` letters and ``LEAST_COUNT`` occurrences after
    the rule's damage.  ``form`` is the most frequent near word if it occurs ``RATIO``
    times as often, else null, like ``form_n``; ``root`` follows forms to the last and
    is the word itself without one.  Repeated rows count again; null and empty texts
    have no words; an empty table gives none.  Other columns are not looked at.
    """
    words = keep(vocabulary(docs), "vocabulary")
    near = nearest(words)
    formed = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    told = keep(near.select(
        "word", "n", "n_near", F.when(formed, F.col("form")).alias("form"),
        F.when(formed, F.col("form_n")).alias("form_n")), "near-words")
    ends = roots(told.where("form IS NOT NULL")).select(F.col("word").alias("rooted"), "root")
    return told.join(ends, F.col("word") == F.col("rooted"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
