"""Toxicity, fixity and the pipeline."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import fixity, toxicity

FOLDER = "/root/testdata/sf0.01"


def invented(n, seed):
    """Texts that are toxic when an insult meets a group, which are harmless apart."""
    draw = random.Random(seed)
    filler = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        words = draw.choices(filler, k=30)
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words += ["vermin"] * insult + ["neighbours"] * group
        draw.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(insult and group))
    return texts, np.array(labels)


def buckets(text):
    return np.sort(np.fromiter(toxicity.term_buckets(text.encode()), np.int64))


def fitted(texts, labels):
    held = [buckets(t) for t in texts]
    every, place, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(labels, [len(h) for h in held]))
    share = labels.mean()
    known = every[(counts >= toxicity.LEAST_TEXTS) & (
        np.abs(toxic - counts * share) >= toxicity.LEAST_DEVIATION * np.sqrt(counts * share * (1 - share)))]
    return toxicity.fit([np.intersect1d(h, known) for h in held], labels, known)


def test_pairs_count_beyond_single_terms():
    texts, labels = invented(4000, 1)
    model = fitted(texts, labels)
    fresh, truth = invented(1000, 2)
    found = np.array([model.score(t.encode()) >= 0.5 for t in fresh])
    assert (found == truth).mean() > 0.97


def test_group_at_the_base_rate_counts_beside_a_mild_word(spark, documents):
    draw = random.Random(6)
    filler = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(800)]
    rows, labels = [], []
    for k in range(6000):
        words = draw.choices(filler, k=25)
        group = k % 10 == 0
        mild = (group and k % 300 == 0) or (not group and draw.random() < 0.02)
        insult = draw.random() < (0.08 if group else 0.11)
        words += ["neighbours"] * group + ["visitors"] * mild + ["trash"] * insult
        draw.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(insult or (group and mild))))
    model = toxicity.train(documents(*rows), spark.createDataFrame(labels, "doc_id LONG, toxic INT"))
    one, two = ("neighbours", "visitors")
    text = " ".join(filler[:20]).encode()
    assert model.score(text + b" neighbours visitors") >= 0.5
    assert max(model.score(text + f" {w}".encode()) for w in (one, two)) < 0.5


def test_labels_that_cannot_be_learned_bring_few_terms(spark, documents):
    """Long texts with labels by lot: terms are counted one by one, so neither time nor model explodes."""
    draw = random.Random(8)
    words = [f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    rows = [(k, " ".join(draw.choices(words, k=800))) for k in range(500)]
    labels = [(k, int(draw.random() < 0.4)) for k in range(500)]
    start = time.monotonic()
    model = toxicity.train(documents(*rows), spark.createDataFrame(labels, "doc_id LONG, toxic INT"))
    assert time.monotonic() - start < 60
    assert len(model.buckets) < 100


def test_score_is_the_sum_over_all_pairs():
    texts, labels = invented(500, 3)
    model = fitted(texts, labels)
    rows = np.arange(min(12, len(model.buckets)))
    want = model.bias + model.weights[rows].sum() + sum(
        float(model.vectors[i] @ model.vectors[j]) for k, i in enumerate(rows) for j in rows[k + 1:])
    assert model.raw(rows) == pytest.approx(want)
    assert model.score(b"") == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_fitting_on_nothing_and_on_one_label():
    nothing = np.empty(0, np.int64)
    for texts, labels in (([], np.empty(0)), ([nothing] * 3, np.zeros(3))):
        model = toxicity.fit(texts, labels, nothing)
        assert 0 <= model.score(b"a b") <= 1 and len(model.buckets) == 0


def test_held_out_scores(spark, documents):
    texts, truth = invented(3000, 4)
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (None, "vermin neighbours"), (0, texts[0]),
                                     (9002, "vermin neighbours " + "word " * 50_000)]
    docs = documents(*rows)
    labels = spark.createDataFrame(
        [(i, int(y)) for i, y in enumerate(truth)] + [(None, 1), (5, None)], "doc_id LONG, toxic INT")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    assert np.mean(right) > 0.95
    stay = toxicity.without_toxic(docs, model)
    assert stay.columns == docs.columns
    # A row with a null id shares its place in no count here, so compare as lists.
    want = sorted(str(r.doc_id) for r in got if not r.predicted)
    assert sorted(str(r.doc_id) for r in stay.select("doc_id").collect()) == want
    assert toxicity.scored(documents(), model).count() == 0


def test_sample_is_bounded_and_ignores_held_out_labels(spark, documents):
    texts, truth = invented(1500, 5)
    docs = documents(*enumerate(texts))
    rows = [(i, int(y)) for i, y in enumerate(truth)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wrong = [(i, 1 - y if held(i) else y) for i, y in rows]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id LONG, toxic INT"), rows=500) for x in (rows, wrong))
    assert np.array_equal(one.buckets, two.buckets) and np.array_equal(one.weights, two.weights)
    few = toxicity.train(docs, spark.createDataFrame(rows, "doc_id LONG, toxic INT"), rows=50)
    assert len(few.buckets) <= len(one.buckets)


def test_given_labels_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    rows = found.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r.toxic: r.share for r in rows}
    assert share[0] < 0.01 and share[1] > 0.8


LEAF = "file LONG, offset LONG, sha STRING"


def plain_differences(one, two):
    out = set()
    for key in one.keys() | two.keys():
        a, b = one.get(key), two.get(key)
        if a != b:
            out.add((*key, "missing" if b is None else "extra" if a is None else "damaged"))
    return out


@pytest.mark.parametrize("span", [1 << 20, 512])
def test_audit_finds_what_a_full_comparison_finds(spark, monkeypatch, span):
    monkeypatch.setattr(fixity, "RANGE_BYTES", span)
    draw = random.Random(6)
    one = {}
    for file in range(5):
        at = 0
        for _ in range(200 if file else 1):
            one[(file, at)] = hashlib.sha256(f"{file}/{at}".encode()).hexdigest()
            at += draw.randint(1, 900)
    two = dict(one)
    for key in draw.sample(sorted(one), 12):
        two[key] = "0" * 64
    for key in draw.sample(sorted(one), 5):
        two.pop(key)
    two |= {(4, 10 ** 6): "f" * 64, (9, 0): "e" * 64}
    for gone in [k for k in two if k[0] == 3]:
        two.pop(gone)
    frames = [spark.createDataFrame([(*k, s) for k, s in x.items()] + [(None, 1, "x")], LEAF).selectExpr(
        "*", "1 AS at", "2 AS place", "3 AS parent", "'q' AS status") for x in (one, two)]
    got = {(r.file, r.offset, r.status) for r in fixity.audit(*frames).collect()}
    assert got == plain_differences(one, two)
    assert fixity.audit(frames[0], frames[0]).count() == 0
    nothing = spark.createDataFrame([], LEAF)
    assert fixity.audit(nothing, nothing).count() == 0
    assert fixity.audit(frames[0], nothing).count() == len(one)


def test_only_branches_that_differ_change_above(spark):
    leaf = spark.createDataFrame([(0, k * 40_000, str(k)) for k in range(200)], LEAF)
    other = leaf.withColumn("sha", F.when(F.col("offset") == 40_000 * 77, "bad").otherwise(F.col("sha")))
    for a, b in zip(fixity.tree(leaf, 3), fixity.tree(other, 3)):
        assert fixity._different(a, b, "at").count() == 1


def test_records_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "x"), (1, "http://a", "x"), (2, None, None), (None, "u", "h"), (3, "http://b", "é" * 100_000)],
        "page_id LONG, url STRING, html STRING").selectExpr("*", "1 AS offset", "2 AS file", "'s' AS sha")
    leaf = fixity.leaves(fixity.warc_records(pages)).orderBy("file", "offset").collect()
    assert len(leaf) == 5
    ends = {}
    for r in leaf:
        assert r.offset == ends.get(r.file, 0) and r.sha == r.replica_sha
        ends[r.file] = r.offset + r.length
    frame = spark.createDataFrame([(r.file, r.offset, r.sha) for r in leaf], LEAF)
    assert fixity.audit(frame, frame).count() == 0


def test_fixity_equals_sql(agree):
    agree("op5_warc_fixity", ["pages"])


def test_pipeline_stages(spark):
    import corpus_pipeline
    from dqspark.llm.shared import keep
    from tests.llm.test_lines_and_copies import plain_lines
    from tests.llm.test_tokens import check_packed

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(keep(stage(spark, tables[-1], FOLDER), name.replace(" ", "-")))
    for t in tables[1:4]:
        assert t.dtypes == docs.dtypes
    raw, clean, lined, single = [{r.doc_id: r for r in t.collect()} for t in tables[:4]]
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert set(clean) == {d for d, r in raw.items() if model.score((r.text or "").encode()) < 0.5}
    assert all(clean[d] == raw[d] for d in clean)
    want = plain_lines([(d, r.text) for d, r in clean.items()])
    assert {d: r.text for d, r in lined.items()} == {d: t for d, t, _, _ in want}
    assert all(r.n_chars == len(r.text) for r in lined.values())
    assert set(single) < set(lined) and all(single[d] == lined[d] for d in single)
    first = {}
    for d in sorted(lined):
        first.setdefault(" ".join(lined[d].text.lower().split()), d)
    assert set(single) <= set(first.values())
    assert check_packed([(d, r.text) for d, r in single.items()], tables[4].collect(), 2048) < 0.02
