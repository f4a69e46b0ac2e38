"""Packing by minimum bin slack.

Documents are cut into whole windows and one remainder each.  The remainders'
lengths, fewer than a window has tokens, are counted over the corpus; on these
counts windows are filled one after the other: the longest remaining piece goes in,
and a subset-sum over bitsets finds the multiset of remaining lengths that comes
closest to what is left, with its counts traced back.  A filling is repeated as
often as the counts allow, so the plan's size depends on the window alone.

Pieces find their place by the rank among pieces of their length.  Ranks are given
inside each partition and shifted by a table of counts per partition and length, so
a length that a third of all pieces share is never gathered anywhere.
"""

from __future__ import annotations

import array
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dqspark.llm.bpe import byte_symbols
from dqspark.llm.shared import keep, table, text_of

WINDOW = 2048
END_ID = 1
# Chunks of text whose ids a worker remembers before it starts again.
REMEMBERED = 300_000
PAIRED_SPACE = re.compile(r"\s\s")
# Up to this character all libraries agree on the classes of characters.
LATIN_END = "\u0250"
# Fixed value: how texts of this vocabulary are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Ids:
    """Token ids of whole texts as little-endian 32-bit numbers, chunk by remembered chunk.

    Where no two white-space characters meet, a space belongs to what follows it and a
    newline stands alone, so what lies between them is encoded once and remembered.
    All other texts, those with special tokens and those beyond Latin letters are left
    to the library that owns the file.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        to_byte = {chr(c): b for b, c in byte_symbols().items()}
        # In a file of this kind ids rise in the order of the merges.
        ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in self.library.get_vocab(False).items()}
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Ids of a space and what follows it, by what follows it.
        self.spaced: dict[str, bytes] = {}
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < LATIN_END:
            return array.array("I", self.fast.encode_ordinary(chunk)).tobytes()
        return self.whole(chunk)

    def _learn(self, chunk: str) -> bytes:
        if len(self.spaced) >= REMEMBERED:
            self.spaced.clear()
        self.spaced[chunk] = found = self._ids(" " + chunk)
        return found

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        get, learn = self.spaced.get, self._learn
        return self._ids(first) + b"".join([get(c) or learn(c) for c in rest])

    def __call__(self, text: str) -> bytes:
        if PAIRED_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return self.newline.join([self._line(line) for line in text.split("\n")])


_READY: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One encoder per worker process and file."""
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


PIECE = ("doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, part INT, rank LONG")


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Whole windows and the remainder of every document, with the rank of each among its length in its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = ids_of(path), TaskContext.get().partitionId()
        end, step, seen = array.array("I", [END_ID]).tobytes(), 4 * window, Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    size = len(piece) // 4
                    rows.append((doc, at // 4, size, zlib.crc32(piece), len(ids) // 4, part, seen[size]))
                    seen[size] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, PIECE)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> Counter:
    """The multiset of remaining lengths whose sum comes closest to ``room`` from below.

    Bit s of ``sums`` says that s can be made; a length with many pieces enters in
    doubling lots, and the bits before each lot are kept to trace the counts back.
    """
    sums, lots = 1, []
    goal, bits = 1 << room, (1 << (room + 1)) - 1
    for size in lengths:
        if size > room:
            continue
        left, lot = min(counts[size], room // size), 1
        while left and not sums & goal:
            lot = min(lot, left)
            lots.append((sums, size, lot))
            sums |= sums << (size * lot) & bits
            left, lot = left - lot, lot * 2
        if sums & goal:
            break
    at, taken = sums.bit_length() - 1, Counter()
    for before, size, lot in reversed(lots):
        if not before >> at & 1:
            taken[size] += lot
            at -= size * lot
    return taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings as ``(times, [(length, pieces), ...])`` that use up all counts."""
    counts = {size: n for size, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        filling = fullest(counts, lengths, window - longest)
        counts[longest] += 1
        filling[longest] += 1
        times = min(counts[size] // n for size, n in filling.items())
        for size, n in filling.items():
            counts[size] -= n * times
        lengths = [size for size in lengths if counts[size]]
        out.append((times, sorted(filling.items(), reverse=True)))
    return out


def placing(fillings: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, first sequence, pieces a sequence, offset)`` by rising rank."""
    used, rows, sequence = Counter(), defaultdict(list), 0
    for times, filling in fillings:
        offset = 0
        for size, n in filling:
            rows[size].append((used[size], sequence, n, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def packed(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``found`` (as ``pieces`` gives it, kept) with ``sequence_id`` and ``offset`` for part and rank."""
    tally = keep(found.groupBy("length", "part").agg(F.count("*").alias("n")), "tally")
    # One row per length goes to the driver, and one length has one row per partition.
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n")).collect()}
    places = placing(plan(counts, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tally.select(F.col("length").alias("l"), F.col("part").alias("p"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # As many rows as partitions times lengths, which grows with the table: merged, not broadcast.
    ranked = found.join(keep(shift, "shift").hint("merge"), (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine, rows = np.flatnonzero(sizes == size), places[int(size)]
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1]
                turn, seat = np.divmod(ranks[mine] - row[:, 0], row[:, 2])
                sequence[mine], offset[mine] = row[:, 1] + turn, row[:, 3] + seat * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kinds = ", ".join(f"{c} LONG" for c in [*columns, "sequence_id", "offset"])
    return ranked.select(*columns, (F.col("rank") + F.col("shift")).alias("rank")).mapInArrow(run, kinds)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids followed by the end id; a null text is empty and has the end
    id alone.  Every row is packed, repeated rows one by one; an empty table gives no
    piece.  Pieces of equal length take their places in the order of their partitions
    and of the rows there.  Other columns are not looked at.
    """
    return packed(keep(pieces(docs, path, window), "pieces"), window)


def sequences(docs: DataFrame, placed: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``sequence_id, token_ids`` without padding; ``docs`` has one row per doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in batches:
            made = [np.append(np.frombuffer(encode(t), "<u4"), END_ID).astype(np.int32)
                    for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    whole = docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id LONG, ids ARRAY<INT>")
    cut = whole.join(placed, "doc_id").select(
        "sequence_id", "offset", F.slice("ids", F.col("start") + 1, F.col("length")).alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("token_ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"),
                public_tokenizers.path("byte_bpe_50k.json"))
