"""BPE encoding and decoding by forced boundaries.

Two symbols that stand side by side inside no vocabulary token can never be merged
across, so the place between them is a certain cut.  A pre-token is cut there, its
fragments are merged independently, and their tokens are concatenated.

The vocabulary file fixes normaliser, pre-tokeniser and merges; the first two are
applied with the library that defines them, once for each distinct run of
characters without white space, which no token crosses.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.llm.shared import table, text_of

# Runs whose tokens a worker remembers before it starts again.
REMEMBERED = 300_000
# Longer fragments are merged with a heap, in n log n steps.
SHORT = 24
# Ids and tokens, each joined by one space, and their number.
Entry = tuple[str, str, int]
# Characters that Python cuts at and the vocabulary's white space does not hold.
SEPARATORS = re.compile("[\x1c-\x1f]")
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Below this character normal form and letter classes are the same in every Unicode version.
LATIN_END = "\u0250"


def byte_symbols() -> dict[int, int]:
    """Bytes as characters of a byte-level vocabulary: visible Latin-1 ones stay, the rest follow U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 0x100 + i for i, b in enumerate(hidden)}


def runs(text: str) -> list[str]:
    """The runs of characters between Unicode white space."""
    return RUN.findall(text) if SEPARATORS.search(text) else text.split()


class ForcedBoundaryBPE:
    """Encoder and decoder for a vocabulary file with byte-level symbols and an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        splits = [p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined = {pair for t in self.ids for pair in self._pairs(self._symbols(t))}
        # Of pre-tokens and of whole runs.
        self.words: dict[str, Entry] = {}
        self.known: dict[str, Entry] = {}

    def _symbols(self, token: str) -> list[str]:
        """Characters, the last with the end mark if the token has it."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = list(token[: -len(self.end)])
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    @staticmethod
    def _pairs(symbols: list[str]) -> zip:
        return zip(symbols, symbols[1:])

    def fragments(self, pre_token: str) -> list[list[str]]:
        """A byte-level pre-token as symbols, cut at the forced boundaries."""
        symbols = list(pre_token)
        symbols[-1] += self.end
        out = [[symbols[0]]]
        for pair in self._pairs(symbols):
            if pair in self.joined:
                out[-1].append(pair[1])
            else:
                out.append([pair[1]])
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """The lowest-ranked pair merges first, of equal ones the leftmost, until no pair has a rank."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        rank, none = self.ranks.get, 1 << 60
        symbols = list(symbols)
        waiting = [rank(p, none) for p in self._pairs(symbols)]
        while waiting and (best := min(waiting)) < none:
            i = waiting.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del waiting[i]
            if i:
                waiting[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(waiting):
                waiting[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        parts: list[str | None] = list(symbols)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(self._pairs(symbols)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, one, two = heapq.heappop(heap)
            j = after[i]
            if parts[i] != one or j >= n or parts[j] != two:
                continue
            parts[i], parts[j] = one + two, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := (parts[a], parts[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], a, *pair))
        return [p for p in parts if p is not None]

    def _pre_tokens(self, run: str) -> list[str]:
        """Normalised pre-tokens in byte symbols; beyond Latin letters the library itself says which."""
        if (run.isascii() or max(run) < LATIN_END) and ((low := run.lower()).isascii() or max(low) < LATIN_END):
            return [t.encode().decode("latin-1").translate(self.symbols) for t in self.pattern.findall(low)]
        normal = self.library.normalizer.normalize_str(run)
        return [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, pre_token: str) -> Entry:
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        found = [i for f in self.fragments(pre_token) for t in self.merged(f) if (i := self.ids.get(t)) is not None]
        self.words[pre_token] = entry = (" ".join(map(str, found)), self.decode(found), len(found))
        return entry

    def _learn(self, run: str) -> Entry:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = [self.words.get(t) or self._word(t) for t in self._pre_tokens(run)]
        entry = found[0] if len(found) == 1 else (
            " ".join([e[0] for e in found if e[2]]), " ".join([e[1] for e in found if e[2]]),
            sum([e[2] for e in found]))
        self.known[run] = entry
        return entry

    def _entries(self, text: str) -> list[Entry]:
        parts = self.special_cut.split(text) if self.special_cut and "<|" in text else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append((str(self.special[part]), part, 1))
                continue
            for run in runs(part):
                entry = self.known.get(run) or self._learn(run)
                if entry[2]:
                    found.append(entry)
        return found

    def written(self, text: str) -> tuple[str, str, int]:
        """Ids and decoded text, each joined by one space, and the number of ids."""
        found = self._entries(text)
        return " ".join([e[0] for e in found]), " ".join([e[1] for e in found]), sum([e[2] for e in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.written(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, as the library does for a file without a decoder; special ones stay."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_READY: dict[str, ForcedBoundaryBPE] = {}


def codec(path: str) -> ForcedBoundaryBPE:
    """One codec per worker process and file."""
    if path not in _READY:
        _READY[path] = ForcedBoundaryBPE(path)
    return _READY[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of whole texts; null is empty: no ids and an empty decoded text.

    Special tokens in a text become their ids, as in the library.  Every row is
    encoded on its own, so repeated rows give equal results; other columns are not
    looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            made = [bpe.written(t) for t in batch.column(1).to_pylist()]
            ids = [np.array(m[0].split(), np.int32) for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.string())],
                ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(
        run, "doc_id LONG, ids ARRAY<INT>, decoded STRING")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encoded`` returns, made where it is made."""
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            made = [(n, sha(ids), sha(text)) for ids, text, n in map(bpe.written, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()),
                 *[pa.array([m[i] for m in made], pa.string()) for i in (1, 2)]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(
        run, "doc_id LONG, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"),
                   public_tokenizers.path("word_bpe_49k.json"))
