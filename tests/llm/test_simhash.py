"""BK-trees, SimHash groups and components beside plain versions."""

import random
from collections import defaultdict

import numpy as np
import xxhash

from dqspark.llm import simhash
from dqspark.llm.bktree import Forest
from dqspark.llm.graph import components


def plain_print(text, width=4):
    parts = (text or "").encode().lower().split()
    whole = [b" ".join(parts[i:i + width]) for i in range(len(parts) - width + 1)] or (
        [b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in whole]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_sets(items, linked):
    """Least item reachable of each item, over all pairs."""
    parent = {i: i for i in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(items)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in items}


def near_numbers(draw, n):
    centres = [draw.getrandbits(64) for _ in range(n // 8 + 1)]
    out = set()
    while len(out) < n:
        x = draw.choice(centres)
        for _ in range(draw.randint(0, 6)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out)


def test_forest_finds_what_all_pairs_find():
    draw = random.Random(1)
    prints = np.array(near_numbers(draw, 400) + [0, 0, 0], np.uint64)
    tree = np.array([draw.randrange(3) for _ in prints])
    forest = Forest(tree, prints)
    for radius in (0, 3, 8, 64):
        found = set()
        for asked, node in forest.search(tree, prints, radius):
            at, item = forest.items(node)
            found |= set(zip(asked[at].tolist(), item.tolist()))
        want = {(a, b) for a in range(len(prints)) for b in range(len(prints))
                if tree[a] == tree[b] and int(prints[a] ^ prints[b]).bit_count() <= radius}
        assert found == want


def test_links_for_every_choice_of_blocks(spark, monkeypatch):
    draw = random.Random(2)
    numbers = near_numbers(draw, 300)
    want = plain_sets(numbers, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in numbers], "fp LONG")
    for equal, piece in ((1, 20_000), (2, 20_000), (1, 3)):
        monkeypatch.setattr(simhash, "equal_blocks", lambda rows, radius, e=equal: e)
        monkeypatch.setattr(simhash, "SHARD_ROWS", piece)
        found = {r.node: r.component for r in components(simhash.links(frame, 4)).collect()}
        got, wanted = defaultdict(set), defaultdict(set)
        for x in numbers:
            got[found.get(simhash.signed(x), simhash.signed(x))].add(x)
            wanted[want[x]].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_blocks_follow_the_number_of_rows():
    assert simhash.equal_blocks(100, 4) == 1 and simhash.equal_blocks(10 ** 10, 4) == 3
    for equal in (1, 2, 3):
        masks = simhash.block_masks(4, equal)
        assert all(any((m & ((1 << a | 1 << b | 1 << c | 1 << d))) == 0 for m in masks)
                   for a, b, c, d in ((0, 20, 40, 63), (1, 2, 3, 4), (13, 26, 39, 52)))


def check_groups(documents, rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(documents(*rows)).collect()]
    prints = [plain_print(t) for _, t in rows]
    sets = plain_sets(set(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[sets[p]] = min(d, least.get(sets[p], d))
    want = [(d, f"{p:016x}", least.get(sets[p])) for (d, _), p in zip(rows, prints)]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=lambda r: str(r)) == sorted(want, key=lambda r: str(r)), key


def test_groups_as_plain(documents, given):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, base), (2, base.upper()), (3, base + " x"), (4, None), (5, ""), (6, " \n\t"), (7, "lone"),
            (8, "a b c"), (9, "A  B\x0bc"), (9, "A  B\x0bc"), (None, base), (None, "only null"),
            (10, "w x \x1cy"), (11, " ".join(f"w{i}" for i in range(70_000)))]
    check_groups(documents, rows + [(100 + d, t) for d, t in given.items()])


def test_groups_of_nothing(documents):
    assert simhash.near_groups(documents()).count() == 0


def plain_stay(rows):
    """Of each group the row with the least (doc_id, hash), a null doc_id first; one of equal rows."""
    prints = [plain_print(t) for _, t in rows]
    sets = plain_sets(set(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, t), p in zip(rows, prints):
        mark = (d is not None, d or 0, simhash.signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "")
        least[sets[p]] = min(mark, least.get(sets[p], mark))
    return sorted(((d if known else None, t) for known, d, _, t in least.values()), key=str)


def near_texts(draw):
    vocabulary = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(4000)]
    texts = []
    for _ in range(30):
        words = draw.choices(vocabulary, k=300)
        texts.append(" ".join(words))
        for changes in (1, 2, 3):
            copy = list(words)
            for _ in range(changes):
                copy[draw.randrange(300)] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_one_of_each_group_stays(documents):
    texts = near_texts(random.Random(5))
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, "  "), (503, texts[0].upper()), (None, texts[4]),
                                     (0, texts[0]), (0, texts[40]), (504, texts[0])]
    frame = documents(*rows)
    stay = simhash.first_of_near_copies(frame)
    assert stay.columns == frame.columns
    assert sorted(((r.doc_id, r.text or "") for r in stay.collect()), key=str) == plain_stay(rows)


def test_copies_of_given_documents(documents, given):
    rows = list(given.items())
    stay = simhash.first_of_near_copies(documents(*rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in stay), key=str) == plain_stay(rows)
    assert simhash.first_of_near_copies(documents()).count() == 0


def test_any_column_name_passes(documents):
    frame = documents((1, "a b"), (2, "a b")).selectExpr(
        "doc_id", "text", *[f"{i} AS {n}" for i, n in enumerate(("stay_id", "stay_th", "turn", "fp", "c0", "c1", "th"))])
    assert [tuple(r) for r in simhash.first_of_near_copies(frame).collect()] == [(1, "a b", *range(7))]


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [
        (5, 5), (7, 6), (7, 6), (None, 3), (500, 501), (399, 200)]
    frame = spark.createDataFrame(pairs, "src LONG, dst LONG")
    got = {r.node: r.component for r in components(frame).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)} | {500: 500, 501: 500}
    assert got == want
    assert components(frame.where("src < 0")).count() == 0
