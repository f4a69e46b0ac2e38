"""Quality by a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on statistics of labelled texts.  Every path from
a root to a node below it is a conjunction of bounds on statistics, a rule; a logistic
regression under the lasso gives each rule a weight and most of them none.  What is
left is compiled into one Spark column expression over the statistics, so that
scoring a corpus is one pass that shuffles nothing.

Forest and weights are fitted on a bounded sample of labelled rows; scoring covers the
whole text of every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.llm.shared import keep, table, text_of

# Labelled rows that the rules are fitted on, at the most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 4
BINS = 64
# Weight of the lasso, per row.
PENALTY = 5e-4
LINE = 0.7
SEED = 11
# The sample is small and fitted many times; a fixed number of sorted partitions makes fits repeatable.
FIT_PARTITIONS = 6

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "line_words", "distinct_words", "top_word", "repeated_words",
    "upper_words", "capital_words", "bare_words", "long_words", "letters", "digits", "stops", "calls", "symbols",
    "repeated_lines", "ended_lines", "compressed",
)
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
_DIGITS, _STOPS, _CALLS, _SYMBOLS = b"0123456789", b".,;:", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"
_BLANKS = b"\t\n\x0b\x0c\r "


def statistics_of(text: bytes) -> list[float]:
    """The ``STATISTICS`` of a UTF-8 text: counts, means and shares; all 0 for a text without words.

    Shares of words are among all words, those of characters among all bytes that are
    no white space; other letters than ASCII count by their bytes.
    """
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    lines = [w for line in text.split(b"\n") if (w := line.strip())]
    solid = text.translate(None, _BLANKS)

    def share(kind: bytes) -> float:
        return (len(solid) - len(solid.translate(None, kind))) / len(solid)

    counts = Counter(words)
    upper = capital = bare = long = 0
    for word, times in counts.items():
        if word.isupper():
            upper += times
        elif word[:1].isupper():
            capital += times
        if not word.strip(_STOPS + _CALLS + _SYMBOLS):
            bare += times
        if len(word) > 16:
            long += times
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    return [
        len(text), n, len(lines), len(solid) / n, n / len(lines), len(counts) / n, max(counts.values()) / n,
        repeated / n, upper / n, capital / n, bare / n, long / n, share(_LETTERS), share(_DIGITS), share(_STOPS),
        share(_CALLS), share(_SYMBOLS), 1 - len(set(lines)) / len(lines),
        sum(line[-1:] in b".!?:" for line in lines) / len(lines), len(zlib.compress(text, 1)) / len(text),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` replaced by the columns of ``STATISTICS``; a null text counts as empty."""
    beside = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(t.as_py()) for t in batch.column(0).cast(pa.binary())]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*beside, *STATISTICS])

    plain = docs.select(text_of().alias("text"), *beside)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[1:]]
    return plain.mapInArrow(run, ", ".join([*kinds, *[f"{s} DOUBLE" for s in STATISTICS]]))


@dataclass(frozen=True, order=True)
class Rule:
    """Bounds ``(statistic, over, up to)`` that hold together; a missing bound is infinite."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        """Whether the rule holds, as an expression over the statistics."""
        parts = []
        for name, over, up_to in self.bounds:
            if over != float("-inf"):
                parts.append(F.col(name) > over)
            if up_to != float("inf"):
                parts.append(F.col(name) <= up_to)
        return reduce(Column.__and__, parts)

    def holds(self, values: dict[str, float]) -> bool:
        return all(over < values[name] <= up_to for name, over, up_to in self.bounds)

    def __str__(self) -> str:
        return " and ".join(f"{over:g} < {name} <= {up_to:g}" for name, over, up_to in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """Log-odds are the bias and the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score between 0 and 1, as an expression over the statistics."""
        raw = reduce(Column.__add__, [F.when(rule.column(), weight).otherwise(0.0) for rule, weight in self.rules],
                     F.lit(self.bias))
        return 1 / (1 + F.exp(-raw))


# A line of a tree's description: "If (feature 3 <= 0.25)" or its "Else" with ">".
_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(description: str) -> list[Rule]:
    """All paths that the text form of a forest describes, from its roots to each node below, sorted and distinct."""
    found, path = set(), []
    for line in description.split("\n"):
        branch = _BRANCH.match(line)
        if not branch:
            if line.strip().startswith("Tree "):
                path = []
            continue
        depth, feature, side, value = len(branch[1]), int(branch[2]), branch[3], float(branch[4])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, feature, side, value))
        limits: dict[str, list[float]] = {}
        for _, f, s, v in path:
            limit = limits.setdefault(STATISTICS[f], [float("-inf"), float("inf")])
            if s == ">":
                limit[0] = max(limit[0], v)
            else:
                limit[1] = min(limit[1], v)
        found.add(Rule(tuple(sorted((name, *limit) for name, limit in limits.items()))))
    return sorted(found)


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Grow and weigh rules on ``sample(label, statistics)``, whose rows may be many times one text: each counts once.

    Without rows of both labels there are no rules, and the bias is the smoothed share of label 1.
    """
    ready = sample.select("label", *STATISTICS).distinct().repartition(FIT_PARTITIONS, "label", *STATISTICS)
    rows = keep(ready.sortWithinPartitions("label", *STATISTICS), "quality-sample")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    usual = math.log((good + 1) / (n - good + 1))
    if good in (0, n):
        return Ensemble(usual, ())
    made = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features")).persist()
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=BINS, subsamplingRate=0.5, featureSubsetStrategy="onethird",
        minInstancesPerNode=5, seed=SEED).fit(made)
    made.unpersist()
    rules = rules_of(forest.toDebugString)
    if not rules:
        return Ensemble(usual, ())
    held = keep(rows.select("label", F.array(*[r.column().cast("tinyint") for r in rules]).alias("held")), "rules-held")
    ruled = held.select("label", array_to_vector(F.col("held").cast("array<double>")).alias("features")).persist()
    weighed = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=True).fit(ruled)
    ruled.unpersist()
    weights = weighed.coefficients.toArray().tolist()
    return Ensemble(float(weighed.intercept), tuple((r, w) for r, w in zip(rules, weights) if w))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on at most ``rows`` labelled documents that are not held out.

    What comes to the driver are the forest and the weights, whose size the parameters
    bound.  Rows with a null id or label are left out; a document with several labels
    counts once for each.
    """
    chosen = keep(
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
        .select("doc_id", (F.col("quality") >= 1).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "chosen")
    met = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text")
    return fit(statistics(met))


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    A null text is scored like an empty one, all of whose statistics are 0.  Only the
    text is looked at, so equal texts have equal scores and repeated rows repeat theirs.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        held_out(F.col("doc_id")).alias("held_out"))
    return statistics(plain).select("doc_id", "held_out", model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= LINE).cast("int"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
