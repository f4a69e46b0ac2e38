"""Alignment of two tokenizers by galloping intersection of token ends.

Each tokenizer gives a text a rising list of byte offsets where its tokens end.  The
shorter list drives: every end of it is looked up in the longer one by steps of
doubling width from a place known to lie before it, then by halving.  Offsets in both
lists cut the tokens into groups, and the difference of two ranks in a list is how
many of its tokens a group, or a token of the other list, spans.

Pairs of ids that end together are counted over the corpus.  The counts of frequent
pairs, as many as a fixed bound allows, go to every task; a rarer pair meets its count
in a join.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.llm.bpe import byte_symbols
from dqspark.llm.shared import keep, table, text_of

# Chunks of text whose tokens a worker remembers, in each of two generations.
REMEMBERED = 120_000
# Pairs whose counts every task gets, at the most; all others are joined.
FREQUENT = 1 << 20
# Token ends that are looked at together.
ENDS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 1_000
# Every so many elements of a short list one is looked up first, as a start for those behind it.
STRIDE = 16
PAIRED_SPACE = re.compile(r"\s\s")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Up to this character all libraries agree on the classes of characters.
LATIN_END = "ɐ"
# Fixed value: how texts of the byte-level vocabulary are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Ids of A and of B as little-endian 32-bit numbers.
Entry = tuple[bytes, bytes]


class TwoTokenizers:
    """Tokens of whole texts by a byte-level vocabulary (A) and a piece vocabulary (B).

    No token of either vocabulary crosses from what is no space to a space or over a
    newline, so where no two white-space characters meet, what lies between is encoded
    once and remembered.  All other texts are left to the libraries that own the files.
    """

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        to_byte = {chr(c): b for b, c in byte_symbols().items()}
        ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in self.a.get_vocab(False).items()}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        # In a file of this kind ids rise in the order of the merges.
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, i in [*ranks.items(), *((t, i) for i, t in special.items())]:
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in known], np.uint32)
                                    for known in (self.bytes_a, self.bytes_b))
        # What certainly cuts B's merges: pieces hold a space only in front and no newline.
        inside = [p for p in map(self.b.id_to_piece, range(self.b.vocab_size()))
                  if "▁" in p.lstrip("▁") or "\n" in p]
        self.cuts = not inside
        self.space = [self.b.piece_to_id("▁")]
        # By chunk, which starts with a newline or goes without its space; the chunks met before the last full lot stay a while.
        self.known: dict[str, Entry | None] = {}
        self.older: dict[str, Entry | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        one = BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def _entry(self, raw: bytes, a: list[int], b: list[int]) -> Entry | None:
        """None where the tokens of one of them do not spell the bytes."""
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return array.array("I", a).tobytes(), array.array("I", b).tobytes()

    def _ids_a(self, text: str) -> list[int]:
        if text.isascii() or max(text, default="") < LATIN_END:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> Entry | None:
        """A newline and what follows it up to the next space, or a space and what follows it."""
        if chunk[:1] == "\n":
            word = chunk[1:]
            # The first piece is the space that B puts in front.
            return self._entry(chunk.encode(), self._ids_a("\n") + (self._ids_a(word) if word else []),
                               self.b.encode(chunk)[1:])
        spaced = " " + chunk
        return self._entry(spaced.encode(), self._ids_a(spaced), self.b.encode(chunk) if chunk else self.space)

    def _learn(self, chunk: str) -> Entry | None:
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        found = self.older.get(chunk) or self._chunk(chunk)
        self.known[chunk] = found
        return found

    def encode(self, text: str) -> Entry | None:
        """The tokens of a space and the text; None where they do not spell it or there is no text."""
        if not text:
            return None
        if not self.cuts or PAIRED_SPACE.search(text) or text[0].isspace() or "▁" in text:
            spaced = " " + text
            return self._entry(spaced.encode(), self.a.encode(spaced, add_special_tokens=False).ids, self.b.encode(text))
        # A newline begins a chunk and so does a space, which the chunk goes without.
        learn = self._learn
        found = [self.known.get(w) or learn(w) for w in text.replace("\n", " \n").split(" ")]
        if None in found:
            return None
        return b"".join([e[0] for e in found]), b"".join([e[1] for e in found])


_READY: dict[tuple[str, str], TwoTokenizers] = {}


def tokenizers_of(path_a: str, path_b: str) -> TwoTokenizers:
    """One pair of tokenizers per worker process and files."""
    if (path_a, path_b) not in _READY:
        _READY[path_a, path_b] = TwoTokenizers(path_a, path_b)
    return _READY[path_a, path_b]


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per value of ``short`` the first place of ``long`` in ``[start, end)`` that is not below it.

    All values gallop at once: steps double until they pass the value, then the last
    step is searched by halving.
    """
    low, step = start.copy(), np.ones(len(short), np.int64)
    high = np.minimum(low, end)
    going = np.flatnonzero((high < end) & (long[np.minimum(high, len(long) - 1)] < short)) if len(long) else []
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(low[going] + step[going] - 1, end[going])
        step[going] *= 2
        open_ = high[going] < end[going]
        going = going[open_]
        going = going[long[high[going]] < short[going]]
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        below = long[middle] < short[wide]
        low[wide] = np.where(below, middle + 1, low[wide])
        high[wide] = np.where(below, high[wide], middle)
    return low


def intersect(short: np.ndarray, long: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank in ``long`` of each value of ``short``: how many values of ``[start, end)`` are below it.

    ``short`` rises within each stretch of equal ``start``.  Every ``STRIDE``-th value
    gallops from its stretch's start, the others from where the one before them was found.
    """
    rank = np.empty(len(short), np.int64)
    lead = np.arange(0, len(short), STRIDE)
    rank[lead] = gallop(short[lead], long, start[lead], end[lead])
    rest = np.flatnonzero(np.arange(len(short)) % STRIDE)
    rank[rest] = gallop(short[rest], long, np.maximum(start[rest], rank[rest // STRIDE * STRIDE]), end[rest])
    return rank


@dataclass
class Aligned:
    """Several texts' tokens after one another; row k of the ends' arrays is the k-th common end.

    ``a`` and ``b`` are ids, ``a_text`` and ``b_text`` their texts' numbers, ``at_a`` and
    ``at_b`` the tokens that end at the common ends, ``text`` the ends' texts.
    """

    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    text: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Per A token the first and the last B token whose bytes overlap its own, by differences of ranks."""
        begin = np.append(0, self.a_end[:-1])
        first = np.searchsorted(self.b_end, begin, "right")
        last = np.searchsorted(self.b_end, self.a_end, "left")
        return first, last


def align(found: list[Entry], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Groups of all texts' tokens, whose ids have these byte lengths.

    Ends are counted on from text to text, so each text's lie apart.
    """
    a, b = (np.frombuffer(b"".join([e[i] for e in found]), "<u4").astype(np.int64) for i in (0, 1))
    a_text, b_text = (np.repeat(np.arange(len(found)), [len(e[i]) // 4 for e in found]) for i in (0, 1))
    a_end, b_end = np.cumsum(size_a[a], dtype=np.int64), np.cumsum(size_b[b], dtype=np.int64)
    texts = np.arange(len(found) + 1)
    a_from, b_from = np.searchsorted(a_text, texts), np.searchsorted(b_text, texts)
    a_drives = np.diff(a_from) <= np.diff(b_from)
    mine_a, mine_b = np.flatnonzero(a_drives[a_text]), np.flatnonzero(~a_drives[b_text])
    there_b = intersect(a_end[mine_a], b_end, b_from[a_text[mine_a]], b_from[a_text[mine_a] + 1])
    there_a = intersect(b_end[mine_b], a_end, a_from[b_text[mine_b]], a_from[b_text[mine_b] + 1])
    # Every list ends with its text, so a rank always has a token.
    hit_a, hit_b = b_end[there_b] == a_end[mine_a], a_end[there_a] == b_end[mine_b]
    at_a = np.concatenate([mine_a[hit_a], there_a[hit_b]])
    at_b = np.concatenate([there_b[hit_a], mine_b[hit_b]])
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    return Aligned(a, b, a_text, b_text, a_end, b_end, at_a, at_b, a_text[at_a])


class Written:
    """Decimal ids with the mark behind them, as the groups' text has them."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        marks = [[f"{i}{mark}" for mark in pair for i in range(n)] for n, pair in ((n_a, ",|"), (n_b, ",;"))]
        self.parts = np.array(marks[0] + marks[1], object)
        self.n_b = n_b

    def __call__(self, all_: Aligned) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(all_.a), bool), np.zeros(len(all_.b), bool)
        last_a[all_.at_a] = last_b[all_.at_b] = True
        # A token of A stands behind all B tokens of earlier groups, one of B behind all A tokens up to its group's end.
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        before_b = np.append(0, all_.at_b + 1)[group_a]
        before_a = (all_.at_a + 1)[group_b]
        out = np.empty(len(all_.a) + len(all_.b), np.int64)
        out[np.arange(len(all_.a)) + before_b] = all_.a + last_a * self.n_a
        out[np.arange(len(all_.b)) + before_a] = 2 * self.n_a + all_.b + last_b * self.n_b
        ends = np.cumsum(np.bincount(all_.a_text, minlength=1) + np.bincount(all_.b_text, minlength=1))
        parts = self.parts[out].tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *ends], ends)]


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, links, groups_sha256`` of whole texts.

    ``links`` has a number ``a * ids of B + b`` for each pair of tokens that end
    together.  A null or empty text, and one that the joined tokens do not spell after
    a space, has no tokens, no links and an empty ``groups_sha256``.
    """
    ready = tokenizers_of(path_a, path_b)
    n_a, n_b = len(ready.bytes_a), len(ready.bytes_b)
    kind, sql_kind = (pa.int32(), "INT") if n_a * n_b < 1 << 31 else (pa.int64(), "LONG")

    def portion(codec: TwoTokenizers, written: Written, ids: list, found: list) -> pa.RecordBatch:
        alive = [k for k, f in enumerate(found) if f]
        counts = np.zeros((3, len(ids)), np.int64)
        pair, shas = np.empty(0, np.int64), [""] * len(ids)
        if alive:
            all_ = align([found[k] for k in alive], codec.size_a, codec.size_b)
            for row, text in enumerate((all_.a_text, all_.b_text, all_.text)):
                counts[row, alive] = np.bincount(text, minlength=len(alive))
            pair = all_.a[all_.at_a] * n_b + all_.b[all_.at_b]
            for k, text in zip(alive, written(all_)):
                shas[k] = hashlib.sha256(text.encode()).hexdigest()
        offsets = np.append(0, np.cumsum(counts[2])).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *map(pa.array, counts),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair, kind)),
             pa.array(shas, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, written = tokenizers_of(path_a, path_b), Written(n_a, n_b)
        ids, found, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                entry = codec.encode(text.as_py())
                ids.append(doc)
                found.append(entry)
                size += (len(entry[0]) + len(entry[1])) // 4 if entry else 1
                if size >= ENDS_AT_ONCE:
                    yield portion(codec, written, ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield portion(codec, written, ids, found)

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, (
        f"doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, links ARRAY<{sql_kind}>, groups_sha256 STRING"))


def pair_counts(found: DataFrame, ids_b: int) -> DataFrame:
    """``pair, n, best``: links of each pair over the corpus, and whether no pair of its B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

    counts = keep(found.select("links").mapInArrow(run, "pair LONG, n LONG").groupBy("pair").agg(
        F.sum("n").alias("n")), "pair-counts")
    id_b = F.col("pair") % ids_b
    # One row per id of B.
    most = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, id_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, bound: int) -> tuple[Column, bool]:
    """Whether a count is among the highest, of which there are no more than ``bound``; and whether all are.

    Counts are cut at an eighth of a binary magnitude.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    # Some hundred levels at the most.
    sizes = dict(counts.groupBy(level.alias("level")).agg(F.count("*")).collect())
    seen, least = 0, max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        seen += sizes[at]
        if seen > bound:
            return level >= least, False
        least = at
    return level >= least, True


def tallied(found: DataFrame, counts: DataFrame, bound: int = FREQUENT) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` in place of its ``links``.

    ``found`` is a kept table of ``tokens``, ``counts`` a kept one of ``pair_counts``.
    Rows count one by one, also those that repeat a doc_id.
    """
    chosen, complete = frequent(counts, bound)
    often = counts.where(chosen).select("pair", "n", "best").orderBy("pair").toArrow()
    # A last pair that no link has, so that there is always one to look at.
    pairs, n, best = (np.append(often.column(c).to_numpy(), end) for c, end in (
        ("pair", np.iinfo(np.int64).max), ("n", 0), ("best", False)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                links = batch.column("links")
                pair, sizes = links.flatten().to_numpy().astype(np.int64), links.value_lengths().to_numpy()
                ends = np.append(0, np.cumsum(sizes))
                at = np.searchsorted(pairs, pair)
                held = pairs[at] == pair

                def per_row(values: np.ndarray) -> np.ndarray:
                    return np.diff(np.append(0, np.cumsum(values))[ends])

                rest = [np.unique(x, return_counts=True) for x in np.split(
                    pair[~held], np.cumsum(per_row(~held))[:-1])]
                made = [pa.array(per_row(held & best[at]).astype(np.int64)),
                        pa.array(per_row(np.where(held, n[at], 0)).astype(np.int64)),
                        *[pa.array([r[i] for r in rest], pa.list_(pa.int64())) for i in (0, 1)]]
                names = [c for c in batch.schema.names if c != "links"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], *made], [*names, "n_best", "count_sum", "rest", "rest_n"])

    told = found.mapInArrow(sums, (
        "doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, groups_sha256 STRING, n_best LONG, count_sum LONG, "
        "rest ARRAY<LONG>, rest_n ARRAY<LONG>"))
    if complete:
        return told.drop("rest", "rest_n")
    told = keep(told.withColumn("row", F.monotonically_increasing_id()), "tallied")
    rare = told.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select(
        "row", F.col("x.rest").alias("met"), F.col("x.rest_n").alias("times"))
    joined = rare.join(counts.where(~chosen), F.col("met") == F.col("pair")).groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return told.join(joined, F.col("row") == F.col("of"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "groups_sha256",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def aligned(docs: DataFrame, path_a: str, path_b: str, bound: int = FREQUENT) -> DataFrame:
    """Alignment of A and B in every row of ``docs(doc_id, text)``, whole texts.

    ``n_links`` equals ``n_groups``, for at a common end one token of each ends.
    Repeated rows repeat their results and count in the corpus again; a row without
    tokens has zeros; an empty table gives none.  Other columns are not looked at.
    """
    found = keep(tokens(docs, path_a, path_b), "token-links")
    counts = keep(pair_counts(found, len(tokenizers_of(path_a, path_b).bytes_b)), "pairs")
    return tallied(found, counts, bound).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, groups``: per group the ids of A, those of B and the byte where it ends, counted from the space in front.

    A row without tokens has no groups.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizers_of(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                entry = codec.encode(text)
                if not entry:
                    made.append([])
                    continue
                one = align([entry], codec.size_a, codec.size_b)
                cut_a, cut_b = one.at_a + 1, one.at_b + 1
                made.append([
                    {"a": one.a[w:x].tolist(), "b": one.b[y:z].tolist(), "end": int(one.a_end[x - 1])}
                    for w, x, y, z in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(
        run, "doc_id LONG, groups ARRAY<STRUCT<a: ARRAY<INT>, b: ARRAY<INT>, end: BIGINT>>")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level and the piece vocabulary aligned over all documents."""
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"),
                   public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
