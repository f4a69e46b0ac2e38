"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of words, hashed into a fixed number of buckets.
Each bucket has a weight and a short vector; the score of a text adds the weights of
its buckets and the products of all pairs of their vectors, so that two terms that
are harmless alone can count together.

The model is fitted on a bounded sample of labelled rows, and only buckets that
enough sampled texts hold get a weight, which bounds the model; scoring covers the
whole text of every document.  Terms that tell only beside another stand out among the
rows that a first model gets wrong; they get a vector and no weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.llm.shared import keep, table, text_of

# Labelled rows that the model is fitted on, at the most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 22
# A bucket gets a weight if so many different sampled texts hold it, and the number of
# toxic ones among them is so many standard deviations from what their share of the sample gives.
LEAST_TEXTS = 5
LEAST_DEVIATION = 4.0
FACTORS = 4
STEPS = 3_000
BATCH = 128
# Vectors join in the second half, so that a term which tells alone does so by its weight.
RATE = 0.3
PAIR_RATE = 0.03
DECAY = 1e-6
STARTS = (4, 5)
# ASCII letters and any bytes of other letters; A-Z are lower-cased before.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_buckets(text: bytes) -> set[int]:
    """Buckets of the distinct words of a text and of their first 4 and 5 bytes."""
    found = set(TERM.findall(text.lower()))
    short = {w[:n] + b"-" for n in STARTS for w in found if len(w) > n}
    return {zlib.crc32(t) % BUCKETS for t in found | short}


@dataclass
class Model:
    """``buckets`` are sorted; row i of ``weights`` and ``vectors`` belongs to bucket i."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, rows: np.ndarray) -> float:
        """The log-odds of a text holding these model rows."""
        v = self.vectors[rows]
        pairs = v.sum(0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * ((pairs * pairs).sum() - (v * v).sum()))

    def score(self, text: bytes) -> float:
        return self.score_of(np.fromiter(term_buckets(text), np.int64))

    def score_of(self, held: np.ndarray) -> float:
        """The score of a text that holds these different buckets."""
        at = np.searchsorted(self.buckets, held)
        at[at == len(self.buckets)] = 0
        known = at[self.buckets[at] == held] if len(self.buckets) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.raw(known), -30, 30))))


def telling(sample: DataFrame) -> np.ndarray:
    """Buckets whose presence says something about the label, of ``sample(label, buckets)``.

    Texts with equal buckets and label count once.  Counting is distributed; what comes
    back are the few buckets that pass.
    """
    different = sample.select("label", "buckets").distinct()
    texts, share = different.agg(F.count("*"), F.avg("label")).first()
    if not texts:
        return np.empty(0, np.int64)
    counts = different.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= LEAST_TEXTS)
    usual = F.sqrt(F.col("n") * share * (1 - share) + 1e-12)
    found = counts.where(F.abs(F.col("toxic") - F.col("n") * share) >= LEAST_DEVIATION * usual)
    return np.sort(found.select("bucket").toArrow().column(0).to_numpy().astype(np.int64))


def telling_in_error(sample: DataFrame, model: Model) -> np.ndarray:
    """Buckets that stand out among the texts which ``model`` gets wrong, of ``sample(label, buckets)``.

    Two terms that tell only together both come up more often among the errors than
    their share of all texts gives: a bucket counts if ``LEAST_TEXTS`` or more errors of
    one kind (missed, or wrongly called toxic) hold it, ``LEAST_DEVIATION`` standard
    deviations above that share.  One count per bucket, combined inside tasks, so this
    grows with the sample's terms even where labels cannot be learned.  Texts with equal
    buckets and label count once.
    """
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score_of(np.asarray(b.values, np.int64)) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], ["label", "buckets", "score"])

    rows = keep(sample.select("label", "buckets").distinct().mapInArrow(
        judged, "label DOUBLE, buckets ARRAY<INT>, score DOUBLE"), "judged")
    kinds = {"missed": "label >= 0.5 AND score < 0.5", "called": "label < 0.5 AND score >= 0.5"}
    marked = rows.select("buckets", *[F.expr(test).cast("int").alias(k) for k, test in kinds.items()])
    n, *shares = marked.agg(F.count("*"), *[F.avg(k) for k in kinds]).first()
    if not n:
        return np.empty(0, np.int64)
    counts = marked.select(*kinds, F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), *[F.sum(k).alias(k) for k in kinds])
    stands_out = F.lit(False)
    for kind, share in zip(kinds, shares):
        usual = F.sqrt(F.col("n") * share * (1 - share) + 1e-12)
        stands_out |= (F.col(kind) >= LEAST_TEXTS) & (F.col(kind) - F.col("n") * share >= LEAST_DEVIATION * usual)
    return np.sort(counts.where(stands_out).select("bucket").toArrow().column(0).to_numpy().astype(np.int64))


def fit(texts: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, seed: int = 7,
        tells: np.ndarray | None = None) -> Model:
    """Logistic loss by AdaGrad over small batches; ``texts`` hold distinct ones of the sorted ``buckets``.

    Weights start at the smoothed log-odds of their bucket, vectors near nothing.  Where
    ``tells`` is false a weight stays zero.
    """
    n = len(texts)
    rate = float(labels.mean()) if n else 0.0
    bias = float(np.log((rate * n + 1) / ((1 - rate) * n + 1)))
    random = np.random.default_rng(seed)
    weights = np.zeros(len(buckets))
    vectors = random.normal(0, 0.01, (len(buckets), FACTORS))
    if not len(buckets) or not n:
        return Model(bias, buckets, weights, vectors)
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    at = np.searchsorted(buckets, np.concatenate(texts))
    ends = np.searchsorted(owner, np.arange(n + 1))
    held, toxic = np.bincount(at, minlength=len(buckets)), np.bincount(at, labels[owner], len(buckets))
    weights = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((held - toxic + 0.5) / (n - labels.sum() + 1))
    if tells is not None:
        weights[~tells] = 0
    bias_sum, weight_sum, vector_sum = 1e-8, np.full(len(buckets), 1e-8), np.full(vectors.shape, 1e-8)
    for turn in range(STEPS):
        rows = random.integers(0, n, BATCH)
        size = ends[rows + 1] - ends[rows]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        term = at[np.repeat(ends[rows], size) + step]
        text = np.repeat(np.arange(len(rows)), size)
        v = vectors[term]
        sums = np.zeros((len(rows), FACTORS))
        np.add.at(sums, text, v)
        squares = np.bincount(text, (v * v).sum(1), len(rows))
        raw = bias + np.bincount(text, weights[term], len(rows)) + 0.5 * ((sums * sums).sum(1) - squares)
        slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
        bias_sum += slope.sum() ** 2
        bias -= RATE * slope.sum() / np.sqrt(bias_sum)
        mine, place = np.unique(term, return_inverse=True)
        down = np.bincount(place, slope[text], len(mine)) + DECAY * weights[mine]
        if tells is not None:
            down[~tells[mine]] = 0
        weight_sum[mine] += down * down
        weights[mine] -= RATE * down / np.sqrt(weight_sum[mine])
        if turn < STEPS // 2:
            continue
        down = DECAY * vectors[mine]
        np.add.at(down, place, slope[text][:, None] * (sums[text] - v))
        vector_sum[mine] += down * down
        vectors[mine] -= PAIR_RATE * down / np.sqrt(vector_sum[mine])
    return Model(float(bias), buckets, weights, vectors)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out.

    What comes to the driver are the buckets that tell, alone or among the errors of a
    first fit, and per sampled row which of these it holds.  Rows with a null id or label
    are left out; a document with several labels counts once for each.
    """
    chosen = keep(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("toxic").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = [np.sort(np.fromiter(term_buckets(t.as_py()), np.int32)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "label", "buckets"])

    met = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")
    sample = keep(met.mapInArrow(run, "doc_id LONG, label DOUBLE, buckets ARRAY<INT>"), "sample")
    tells = telling(sample)
    model = _fit_on(sample, tells, tells)
    beside = telling_in_error(sample, model)
    return _fit_on(sample, np.union1d(tells, beside), tells) if len(np.setdiff1d(beside, tells)) else model


def _fit_on(sample: DataFrame, buckets: np.ndarray, tells: np.ndarray) -> Model:
    """Fit on what ``sample`` holds of the sorted ``buckets``; only those of ``tells`` get a weight."""
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(np.asarray(b.values, np.int64), buckets).astype(np.int32)
                     for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "label", "buckets"])

    made = sample.mapInArrow(narrow, sample.schema).toArrow()
    order = np.lexsort((made.column("label").to_numpy(), made.column("doc_id").to_numpy()))
    found = [np.asarray(b.values, np.int64) for b in made.column("buckets")]
    return fit([found[i] for i in order], made.column("label").to_numpy()[order], buckets,
               tells=np.isin(buckets, tells))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    A null text is scored like an empty one, by the bias alone.  Only the text is
    looked at, so equal texts have equal scores and repeated rows repeat theirs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), text_of())
    return plain.mapInArrow(run, "doc_id LONG, held_out BOOLEAN, score DOUBLE").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            yield batch.filter(pa.array([model.score(t.as_py() or b"") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
