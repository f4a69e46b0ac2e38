"""The bidirectional index, its search schemes and the groups of spelling variants beside plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from dqspark.llm import fm_index, queries, spelling
from dqspark.llm.fm_index import BidirectionalIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    by_hole = defaultdict(set)
    for w in words:
        by_hole[w].add(w)
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1:]].add(w)
            by_hole[(i, w[:i], w[i + 1:])].add(w)
    met = defaultdict(set)
    for group in by_hole.values():
        for a in group:
            met[a] |= {b for b in group if b != a and b not in met[a] and near(a, b)}
    form = {}
    for w, n in words.items():
        if met[w]:
            best = min(met[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(met[w]), words[form[w]] if w in form else None)
            for w, n in words.items()}


def check(frame, rows):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}
    assert frame.count() == len(got)
    assert got == plain_variants(plain_words(rows))
    return got


def test_index_steps_count_as_plain():
    draw = random.Random(4)
    words = sorted({bytes(draw.choices(b"abc\xe9", k=draw.randint(1, 8))) for _ in range(80)})
    index = BidirectionalIndex(words)
    for _ in range(200):
        pattern = bytes(draw.choices(b"abc\xe9z", k=draw.randint(1, 4)))
        want = sum(w.startswith(pattern, i) for w in words for i in range(len(w)))
        for side, read in ((index.left, pattern[::-1]), (index.right, pattern)):
            whole = np.zeros(1, np.int64)
            states = fm_index.States(whole, whole, np.array([len(side.bwt)]))
            for c in read:
                states = index.step(side, states, index.code[[c]])
            assert states.size[0] == want
            # Both intervals hold the pattern's places, each in its own order.
            near_, far = (index.left, index.right) if side is index.left else (index.right, index.left)
            back = fm_index.States(states.far, states.near, states.size)
            for c in b"abc\xe9":
                longer = pattern + bytes([c]) if far is index.right else bytes([c]) + pattern
                held = sum(w.startswith(longer, i) for w in words for i in range(len(w)))
                if want:
                    assert index.step(far, back, index.code[[c]]).size[0] == held


def test_schemes_find_all_near_words(monkeypatch):
    draw = random.Random(1)
    for trial in range(60):
        monkeypatch.setattr(fm_index, "AT_ONCE", draw.choice((7, 1 << 18)))
        letters = b"ab\xe9c"[:draw.choice((1, 2, 3, 4))]
        words = sorted({bytes(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(draw.choice((1, 5, 60, 200)))})
        asked = words + [bytes(draw.choices(b"abz", k=6)) for _ in range(5)]
        index = BidirectionalIndex(words)
        found = {tuple(map(int, p)) for back in (False, True) for p in zip(*index.one_error(asked, back))}
        assert found == {(i, j) for i, q in enumerate(asked) for j, w in enumerate(words) if near(q, w)}


def test_variants_of_given_documents(documents, given):
    rows = list(given.items())
    got = check(spelling.variants(documents(*rows)), rows)
    assert any(r[0] for r in got.values()) and any(r[3] > 1 for r in got.values())


def crowd(draw, n):
    """Texts of words that share halves, with frequent ones, their variants and variants of these."""
    words = ["mountain" + "".join(draw.choices("abcd", k=4)) for _ in range(n)]
    words += ["".join(draw.choices("abcd", k=4)) + "valley" for _ in range(n)]
    text = " ".join(words * 2)
    chain = ["lighthouse"] * 500 + ["lighthous"] * 45 + ["lighthus"] * 4 + ["LightHouse's"] + ["abcdefghé"] * 3 + [
        "abcdefghÉ"] * 30 + ["abcdefghx"] * 3 + ["×÷ÿ" * 3] * 2
    return text + " " + " ".join(chain)


def test_hot_halves_in_pieces(documents, monkeypatch):
    draw = random.Random(2)
    rows = [(1, crowd(draw, 120)), (2, crowd(draw, 60)), (2, "repeat7 rows"), (2, "repeat7 rows"), (3, None), (4, ""),
            (None, "nobodys nobodys nobodys"), (5, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + "y " + "z" * 2999 + "y")]
    check(spelling.variants(documents(*rows)), rows)
    monkeypatch.setattr(spelling, "HALF_WORDS", 20)
    monkeypatch.setattr(spelling, "INDEX_ROWS", 50)
    monkeypatch.setattr(spelling, "COUNTED", 10)
    got = check(spelling.variants(documents(*rows)), rows)
    assert got["lighthus"][:2] == ("lighthous", "lighthouse")


def test_variants_of_nothing(documents):
    assert spelling.variants(documents()).count() == 0
    assert spelling.variants(documents((1, None), (2, "one two"))).count() == 0


def test_query_reads_every_document(spark, given):
    got = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    check(got, list(given.items()))
