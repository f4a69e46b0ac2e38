"""Token counts of a unigram vocabulary by dynamic programming over a trie.

The best score of a prefix does not depend on what follows, so distinct pre-tokens
go into a trie and the forward score of each prefix is computed once, when its node
is made.  A pre-token's count is stored where it ends; a document's count is the sum
over its pre-tokens.  A worker's trie has a bounded size and starts again when full,
so no step shuffles or gathers anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.llm.bpe import runs
from dqspark.llm.shared import table, text_of

# The mark that stands for the space before a word.
SPACE = "▁"
# Prefixes that a worker's trie holds at the most, and pre-tokens with a stored count.
NODES = 600_000
WORDS = 400_000
BYTE_PIECES = 256


def piece_scores(path: str) -> dict[str, float]:
    """Unigram log-probabilities of a vocabulary file's pieces.

    The file lists pieces by falling frequency and has no unigram scores, so they
    follow Zipf's rule over that order.
    """
    from sentencepiece import SentencePieceProcessor

    loaded = SentencePieceProcessor(model_file=path)
    normal = [loaded.id_to_piece(i) for i in range(loaded.vocab_size())
              if not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i))]
    whole = sum(1 / (rank + 2) for rank in range(len(normal)))
    return {piece: -math.log((rank + 2) * whole) for rank, piece in enumerate(normal)}


class CountTrie:
    """Distinct pre-tokens as paths; every node has its prefix's best score and the tokens that takes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # A character without a piece falls back to one token for each of its bytes.
        self.byte_score = min(scores.values(), default=0.0) - math.log(BYTE_PIECES)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.tokens = [0]
        self.counts: dict[str, int] = {}

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        """The best (score, fewest tokens) of ``word[:end]``; ``path`` has the nodes of shorter prefixes."""
        size = len(word[end - 1].encode())
        at = path[end - 1]
        found = (self.best[at] + size * self.byte_score, -self.tokens[at] - size)
        get = self.scores.get
        for start in range(max(0, end - self.longest), end):
            score = get(word[start:end])
            if score is not None:
                at = path[start]
                found = max(found, (self.best[at] + score, -self.tokens[at] - 1))
        return found[0], -found[1]

    def insert(self, word: str) -> int:
        """The number of tokens of a pre-token, stored at its end."""
        if len(self.best) >= NODES or len(self.counts) >= WORDS:
            self.clear()
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            key = (node, char)
            child = self.children.get(key)
            if child is None:
                score, tokens = self._forward(word, end, path)
                child = self.children[key] = len(self.best)
                self.best.append(score)
                self.tokens.append(tokens)
            path.append(child)
            node = child
        self.counts[word] = self.tokens[node]
        return self.tokens[node]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text: words between white space, each after a space mark."""
        words = [SPACE + w for w in runs(text)]
        get, insert = self.counts.get, self.insert
        return len(words), sum([get(w) or insert(w) for w in words])


_READY: dict[str, CountTrie] = {}


def trie_of(path: str) -> CountTrie:
    """One trie per worker process and vocabulary file."""
    if path not in _READY:
        _READY[path] = CountTrie(piece_scores(path))
    return _READY[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row of ``docs(doc_id, text)``, whole texts.

    A null, empty or blank text has no token.  Ties between segmentations of equal
    score take the fewest tokens.  Rows are counted one by one, so repeated rows repeat
    their counts; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path)
        for batch in batches:
            made = [trie.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)]],
                ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(
        run, "doc_id LONG, n_pretokens LONG, n_tokens LONG")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path("piece_bpe_32k.model"))
