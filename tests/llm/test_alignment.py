"""Galloping intersection, tokens, groups and counts beside plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from dqspark.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", " a", "a ", "a\n", "a  b", "a\n\nb ", "tab\there", "x\ny z\nw", "▁x", "a▁", "é ü\nß",
       "日本 語\nテ", "<|endoftext|> <s> </s> <0x41>", "a b", "it's we'll\n'tis", "\x00 \x1c\x1d", "😀 ok", "\r\n win\r",
       "word " * 3000 + "end", "x" * 5000, "ﬁ ﬀ é"]


@pytest.fixture(scope="module")
def codec():
    return alignment.tokenizers_of(*PATHS)


def plain_tokens(codec, text):
    """(ids, bytes) of both libraries on the whole text, or None."""
    if not text:
        return None
    a = codec.a.encode(" " + text, add_special_tokens=False).ids
    b = codec.b.encode(text)
    raw_a, raw_b = [codec.bytes_a[i] for i in a], [codec.bytes_b[i] for i in b]
    whole = (" " + text).encode()
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None


def plain_groups(found):
    """[(A ids, B ids)] and the linked id pairs, walking both lists."""
    a, raw_a, b, raw_b = found
    ends = [set(), set()]
    for k, raw in enumerate((raw_a, raw_b)):
        at = 0
        for r in raw:
            at += len(r)
            ends[k].add(at)
    common = ends[0] & ends[1]

    def cut(ids, raw):
        at, out, now = 0, [], []
        for i, r in zip(ids, raw):
            at += len(r)
            now.append(i)
            if at in common:
                out.append(now)
                now = []
        return out

    both = list(zip(cut(a, raw_a), cut(b, raw_b)))
    return both, [(x[-1], y[-1]) for x, y in both]


def plain_rows(codec, rows):
    found = [plain_tokens(codec, t) for _, t in rows]
    made = [plain_groups(f) if f else ([], []) for f in found]
    counts = Counter(p for _, links in made for p in links)
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (d, _), f, (both, links) in zip(rows, found, made):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in both)
        out.append((d, len(f[0]) if f else 0, len(f[2]) if f else 0, len(both), len(links),
                    sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if f else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(frame, want):
    assert sorted(frame.columns) == sorted(COLUMNS)
    got = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_galloping_ranks_as_plain():
    draw = np.random.default_rng(2)
    for _ in range(200):
        long, short = (np.unique(draw.integers(0, 400, draw.integers(0, 120))) for _ in range(2))
        start = int(draw.integers(0, len(long) + 1))
        short = short[short > (long[start - 1] if start else -1)]
        first, end = np.full(len(short), start), np.full(len(short), len(long))
        want = np.searchsorted(long, short)
        assert (alignment.gallop(short, long, first, end) == want).all()
        assert (alignment.intersect(short, long, first, end) == want).all()


def test_tokens_as_the_libraries(codec, given):
    for text in [*ODD, *given.values()]:
        want, got = plain_tokens(codec, text), codec.encode(text or "")
        if want is None:
            assert got is None
        else:
            assert (np.frombuffer(got[0], "<u4").tolist(), np.frombuffer(got[1], "<u4").tolist()) == (want[0], want[2])


def test_spans_as_plain(codec, given):
    texts = [t for t in given.values() if len(t) < 800][:20]
    entries = [codec.encode(t) for t in texts]
    both = alignment.align(entries, codec.size_a, codec.size_b)
    first, last = both.spans()
    a_from = both.a_end - codec.size_a[both.a]
    b_from = both.b_end - codec.size_b[both.b]
    for k in range(len(both.a)):
        over = np.flatnonzero((both.b_end > a_from[k]) & (b_from < both.a_end[k]))
        assert (first[k], last[k]) == (over[0], over[-1])


def test_rows_as_plain(codec, documents, given):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "repeat me"), (3, "repeat me")] + [
        (100 + d, t) for d, t in list(given.items())[:120]]
    check(alignment.aligned(documents(*rows), *PATHS), plain_rows(codec, rows))


def test_rare_pairs_join_their_counts(codec, documents, given, monkeypatch):
    draw = random.Random(3)
    texts = list(given.values())
    rows = [(k, draw.choice(texts)[:600]) for k in range(60)] + [(5, "again"), (5, "again")]
    want = plain_rows(codec, rows)
    monkeypatch.setattr(alignment, "ENDS_AT_ONCE", 500)
    monkeypatch.setattr(alignment, "ROWS_AT_ONCE", 7)
    for bound in (0, 40, 1 << 20):
        check(alignment.aligned(documents(*rows), *PATHS, bound), want)


def test_groups_spell_the_text(codec, documents, given):
    rows = list(given.items())[:30] + [(1000, "▁"), (1001, None)]
    for r in alignment.groups(documents(*rows), *PATHS).collect():
        text = dict(rows)[r.doc_id]
        raw = b""
        for g in r.groups:
            part = b"".join(codec.bytes_a[i] for i in g.a)
            assert part == b"".join(codec.bytes_b[i] for i in g.b)
            raw += part
            assert len(raw) == g.end
        assert raw == ((" " + text).encode() if r.doc_id < 1000 else b"")


def test_alignment_of_nothing(documents):
    assert alignment.aligned(documents(), *PATHS).count() == 0


def test_query_reads_every_document(spark, codec, given):
    check(queries.QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001"),
          plain_rows(codec, list(given.items())))
