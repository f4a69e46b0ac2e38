"""BPE, packing and token counts beside the libraries and plain versions."""

import array
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dqspark.llm import bpe, packing, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", " a", "a ", "a  b", "a\n\n b", "don't I'LL we'Ve", "<|endoftext|>", "x<|startoftext|>y<|endoftext|",
       "a" * 3000, "ha" * 2000, "ΣΑΣ İ ẛ̣ é e\u0301", "中文字 ﬁ ½² ٣ 😀👍🏽\u200d", "a\x1cb\x85c\xa0d\u3000e", "\x00\x01"]


def random_texts(n, seed):
    draw = random.Random(seed)
    letters = "abAB 'sStlΣσİıßéÉ\u0301\u0300 \n\t\x1c\x85\u3000中ﬁ½٣😀\u200d!?<|>0123ͅǅ" + " " * 8
    return ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(n)]


def some_texts(given):
    return ODD + random_texts(800, 1) + list(given.values())


def test_bpe_equals_the_library(given):
    ours, library = bpe.ForcedBoundaryBPE(WORD), Tokenizer.from_file(WORD)
    for text in some_texts(given):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text[:80]
        joined, decoded, n = ours.written(text)
        assert (n, decoded) == (len(ids), library.decode(ids, skip_special_tokens=False))
        assert ours.decode(ids) == decoded and joined == " ".join(map(str, ids))


def test_no_token_crosses_a_forced_boundary():
    ours = bpe.ForcedBoundaryBPE(WORD)
    cut = 0
    for text in random_texts(300, 2):
        for run in bpe.runs(text):
            for pre in ours._pre_tokens(run):
                parts = ours.fragments(pre)
                cut += len(parts) > 1
                assert "".join(s for p in parts for s in p) == pre + ours.end
                whole = [s for p in parts for s in p]
                assert [t for p in parts for t in ours.merged(p)] == ours.merged(whole)
    assert cut > 50


def test_long_and_short_merging_agree():
    ours, draw = bpe.ForcedBoundaryBPE(WORD), random.Random(3)
    for _ in range(500):
        symbols = draw.choices("aeinrst", k=draw.randint(1, 24))
        assert ours.merged(symbols) == ours._merged_long(symbols)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    ours, library = bpe.ForcedBoundaryBPE(WORD), Tokenizer.from_file(WORD)
    text = " ".join(f"word{i} other" for i in range(100))
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(ours.known) <= 10 and len(ours.words) <= 10


def test_round_trip_query(spark, documents):
    rows = [(1, None), (2, ""), (3, "Hello  Wörld"), (3, "Hello  Wörld"), (None, "x"), (4, "long " * 60_000)]
    library = Tokenizer.from_file(WORD)
    got = bpe.digests(documents(*rows), WORD).collect()
    whole = {r.doc_id: r for r in bpe.encoded(documents(*rows), WORD).collect()}
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and whole[r.doc_id].ids == ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and whole[r.doc_id].decoded == decoded
    assert bpe.digests(documents(), WORD).count() == 0


def test_ids_equal_the_library(given):
    ours, library = packing.Ids(BYTE), Tokenizer.from_file(BYTE)
    for text in some_texts(given):
        assert ours(text) == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text[:80]


def most(counts, room):
    """The largest sum within room, by trying all multisets one length after another."""
    sums = {0}
    for size, n in counts.items():
        sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= room}
    return max(sums)


def test_fullest_is_closest_to_the_room():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 6) for _ in range(draw.randint(1, 6))}
        room = draw.randint(0, 100)
        taken = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(0 < n <= counts[size] for size, n in taken.items())
        assert sum(size * n for size, n in taken.items()) == most(counts, room)


def test_plan_uses_every_piece_once():
    draw = random.Random(5)
    counts = {size: draw.randint(1, 5_000) for size in draw.sample(range(1, 65), 40)} | {33: 10 ** 9}
    plan = packing.plan(counts, 64)
    used = Counter()
    for times, filling in plan:
        assert times > 0 and sum(size * n for size, n in filling) <= 64
        for size, n in filling:
            used[size] += times * n
    assert used == counts and len(plan) < 400
    assert packing.plan({}, 64) == [] and packing.plan({64: 3}, 64) == [(3, [(64, 1)])]


def check_packed(rows, got, window, end=(1,)):
    library = Tokenizer.from_file(BYTE)
    ids = [library.encode(t or "", add_special_tokens=False).ids + list(end) for _, t in rows]
    want = Counter((d, len(i)) for (d, _), i in zip(rows, ids))
    by_key = {(d, len(i)): i for (d, _), i in zip(rows, ids)}
    places = defaultdict(list)
    spans = defaultdict(list)
    for r in got:
        piece = by_key[(r.doc_id, r.doc_tokens)][r.start:r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(array.array("I", piece).tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        spans[(r.doc_id, r.doc_tokens)].append((r.start, r.length))
    for key, found in spans.items():
        copies = want.pop(key)
        found.sort()
        for k in range(copies):
            at = 0
            for start, length in found[k::copies]:
                assert start == at
                at += length
            assert at == key[1]
    assert not want
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
    return 1 - sum(n for f in places.values() for _, n in f) / (window * max(1, len(places)))


def test_packing_is_whole_and_full(spark, documents, given):
    rows = [(5000, None), (5001, ""), (5002, "<|endoftext|> a  b"), (7, given[7]), (5003, "word " * 9_000),
            (None, "nameless")] + list(given.items()) + [(6000 + i, "hot copy of one text") for i in range(300)]
    frame = documents(*rows).repartition(5)
    for window in (2048, 64):
        placed = packing.pack(frame, BYTE, window)
        assert check_packed(rows, placed.collect(), window) < 0.02
    assert packing.pack(documents(), BYTE).count() == 0


def test_sequences_hold_the_ids(spark, documents):
    from dqspark.llm.shared import keep

    rows = [(i, "some words of text " * (i % 7 + 1)) for i in range(40)]
    docs = documents(*rows)
    placed = keep(packing.pack(docs, BYTE, 32), "placed")
    built = {r.sequence_id: r.token_ids for r in packing.sequences(docs, placed, BYTE, 32).collect()}
    library = Tokenizer.from_file(BYTE)
    for r in placed.collect():
        ids = library.encode(rows[r.doc_id][1], add_special_tokens=False).ids + [1]
        assert built[r.sequence_id][r.offset:r.offset + r.length] == ids[r.start:r.start + r.length]


def plain_count(scores, word, byte_score):
    """Every segmentation's best (score, fewest tokens), by looking forward from each place."""
    best = {0: (0.0, 0)}
    for i in range(len(word)):
        score, fewer = best[i]
        size = len(word[i].encode())
        steps = [(i + 1, score + size * byte_score, fewer - size)]
        steps += [(j, score + scores[word[i:j]], fewer - 1) for j in range(i + 1, len(word) + 1) if word[i:j] in scores]
        for j, s, n in steps:
            best[j] = max(best.get(j, (float("-inf"), 0)), (s, n))
    return -best[len(word)][1]


def test_counts_equal_plain_segmentation(spark, documents, given, monkeypatch):
    scores = token_counts.piece_scores(PIECES)
    trie = token_counts.CountTrie(scores)
    texts = ODD + random_texts(200, 6) + list(given.values())[:25]
    known = {}
    for text in texts:
        words = [token_counts.SPACE + w for w in bpe.runs(text)]
        for w in set(words) - set(known):
            known[w] = plain_count(scores, w, trie.byte_score)
        assert trie.count(text) == (len(words), sum(known[w] for w in words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "a b"), (0, texts[0])]
    got = token_counts.token_counts(documents(*rows), PIECES).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter(
        (d, sum(known[token_counts.SPACE + w] for w in bpe.runs(t or ""))
         if t != "a b" else trie.count(t)[1]) for d, t in rows)
    monkeypatch.setattr(token_counts, "NODES", 50)
    small = token_counts.CountTrie(scores)
    assert [small.count(t) for t in texts] == [trie.count(t) for t in texts]
    assert token_counts.token_counts(documents(), PIECES).count() == 0


@pytest.mark.parametrize("name", ["op3_packing", "op7_token_counts", "op9_bpe_round_trip"])
def test_registered_queries_return_every_document(spark, given, name):
    from dqspark.llm import queries

    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(given)
