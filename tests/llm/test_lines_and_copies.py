"""Line dedup and exact dedup beside plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

from dqspark.llm.cuckoo import CuckooFilter, DigestIndex, change, entries, groups, mark_copies
from dqspark.llm.line_dedup import drop_shared_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line stands in the foot of very many documents"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def plain_lines(rows, min_chars=40, min_docs=5):
    """(doc_id, text) -> (doc_id, kept text, lines, dropped), rows one by one."""
    def key(line):
        return line.strip("\t\n\x0b\x0c\r ").translate(LOWER)

    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc)
    rank = lambda d: (d is not None, d or 0)
    gone = {k: max(h, key=rank) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines_as_plain(documents):
    draw = random.Random(3)
    pool = [LONG, LONG.upper() + " \t", "é" * 40, "short", "", "\x0b" + "y" * 39, "z" * 40 + "\x85", "q" * 41]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(1, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (7, rows[7][1]), (7, LONG), (None, LONG + "\nown"),
             (103, "\n".join([LONG] * 3000 + ["tail"]))]
    got = drop_shared_lines(documents(*rows).withColumnRenamed("n", "n_lines"))
    assert {"th", "keep_id"} <= set(got.columns)
    found = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert Counter(found) == Counter(plain_lines(rows))


def test_lines_beside_any_column_name(documents):
    names = ("__id", "__th", "__gone", "id", "th", "gone", "c0", "c1")
    frame = documents(*[(i, LONG + f"\n{i}") for i in range(5)]).selectExpr(
        *[f"{i} AS {n}" for i, n in enumerate(names)], "text", "doc_id")
    got = drop_shared_lines(frame)
    assert got.columns == [*names, "text", "doc_id", "n_lines", "n_dropped"]
    assert sorted(tuple(r)[-4:] for r in got.collect()) == sorted(
        [(str(i), i, 2, 1) for i in range(4)] + [(LONG + "\n4", 4, 2, 0)])
    assert all(tuple(r)[:8] == tuple(range(8)) for r in got.collect())


def test_lines_of_nothing(documents):
    assert drop_shared_lines(documents()).count() == 0


def test_lines_equal_sql(agree):
    agree("op8_line_dedup", ["documents"])


def test_filter_keeps_and_forgets():
    some = [str(i).encode() for i in range(3000)]
    held = CuckooFilter(1024)
    assert all(held.add(k) for k in some) and all(k in held for k in some)
    for k in some[:1500]:
        held.remove(k)
    assert all(k in held for k in some[1500:])
    assert sum(k in held for k in some[:1500]) < 30


def test_index_grows_from_its_keys():
    index = DigestIndex(4)
    for i in range(5000):
        index.insert(str(i).encode(), i)
    index.insert(b"7", 70)
    assert index.resizes > 3 and len(index) == 5000 and index.find(b"7") == 70
    assert index.delete(b"7") and not index.delete(b"7") and index.find(b"7") is None
    assert all(index.find(str(i).encode()) == i for i in range(8, 5000)) and index.find(b"none") is None


def test_copies_as_plain(documents):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "x" * 300_000),
            (9, "x" * 300_000), (3, "a"), (None, "b"), (None, "lone")] + [(i, "hot") for i in range(20, 220)]
    got = mark_copies(documents(*rows)).collect()
    size, last = Counter(t or "" for _, t in rows), {}
    for d, t in rows:
        t = t or ""
        last[t] = max(last.get(t, (False, 0)), (d is not None, d or 0))
    by_sha = {sha(t): t for t in size}
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    for r in got:
        t = by_sha[r.text_sha256]
        assert r.group_size == size[t] and r.keep_id == (last[t][1] if last[t][0] else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == {sha(t): 1 for t in size}


def test_live_index_takes_changes(documents):
    live = entries(documents((1, "a"), (2, "a"), (3, "b")))
    more = entries(documents((4, "b"), (5, "c"), (6, "d")))
    out = entries(documents((2, "a"), (6, "d"), (9, "never")))
    left = change(live, more, out)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5]
    assert sorted((r.keep_id, r.group_size) for r in groups(left).collect()) == [(1, 1), (4, 2), (5, 1)]


def test_copies_of_nothing(documents):
    assert mark_copies(documents()).count() == 0


def test_copies_equal_sql(agree):
    agree("op10_exact_dedup", ["documents"])
