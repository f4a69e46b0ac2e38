"""URL verdicts and sketches beside plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dqspark.llm import sketch as S
from dqspark.llm.url_filter import RULES, canonical_form, judge, resolved

PAGE = "page_id LONG, url STRING, html STRING"


def page(*links):
    return "<html><head>" + "".join(links) + "</head>"


def canonical(target):
    return f'<LINK href="{target}" Rel="Canonical">'


def refresh(target):
    return f"<meta http-equiv='refresh' content='0; URL={target}'>"


def plain_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_rules_alone(spark):
    urls = [None, "", "no scheme", "http://", "http://x.org", "http://x.org/", "HTTP://A.Example.ORG/es/1",
            "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/es/",
            "http://a.com/fr/?x", "http://a.com/de/#y", "http://a.com/de", "http://a.com?/de/", "http://É.com/de/é",
            "x://y://z.com/de/", "http://a.com/de/" + "p" * 100_000]
    got = {r.page_id: r for r in judge(spark.createDataFrame(
        [(i, u, None) for i, u in enumerate(urls)], PAGE).selectExpr("*", "'q' AS host", "1 AS node")).collect()}
    for i, url in enumerate(urls):
        host, path, best = plain_rule(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "allow")


def test_blocks_reach_aliases_and_explicit_allow_wins(spark):
    rows = [
        (1, "http://a.net/1", page(canonical("http://b.net/2"))),
        (2, "http://b.net/2", page(refresh("/3"))),
        (3, "http://b.net/3", page(canonical("//shop.com/de/9"))),
        (4, "http://site.org/allowed", page(canonical("http://b.net/2"))),
        (5, "http://c.net/5?utm_source=x#top", None),
        (6, "http://c.net/5", page(refresh("http://shop.com/de/1?a=1&amp;b=2"))),
        (7, "http://d.net/alone", page("<link rel=stylesheet href='http://shop.com/de/1'>")),
        (8, "http://e.net/f/g", page("<link rel=canonical href=h>")),
        (9, "http://e.net/f/h", page(canonical("http://redirected.net/"))),
        (1, "http://a.net/1", page(canonical("http://b.net/2"))), (None, None, None),
    ]
    moved = spark.createDataFrame([("http://redirected.net/", "http://x.example.org/es/1"), (None, "http://q/")],
                                  "source STRING, target STRING")
    got = judge(spark.createDataFrame(rows, PAGE), redirects=moved).collect()
    assert len(got) == len(rows)
    verdicts = {r.page_id: (r.verdict, r.via) for r in got}
    blocked = ("block", "alias")
    assert verdicts == {1: blocked, 2: blocked, 3: blocked, 4: ("allow", "rule"), 5: blocked, 6: blocked,
                        7: ("allow", "default"), 8: blocked, 9: blocked, None: ("allow", "default")}


def test_url_parts(spark):
    cases = {"http://a/b?utm_source=1&x=2&utm_medium=3#f": "http://a/b?x=2", "http://a/b?x=2&utm_id=": "http://a/b?x=2",
             "http://a/?utm_x=1": "http://a/", "http://a/b?x=1&y=2": "http://a/b?x=1&y=2"}
    frame = spark.createDataFrame([(u,) for u in cases], "u STRING")
    assert {r.u: r.c for r in frame.select("u", canonical_form(F.col("u")).alias("c")).collect()} == cases
    one = spark.range(1).select(*[resolved(F.lit(t), F.lit("http://h/a/b?c")) for t in ("x", "/x", "//y/x", "z://x")])
    assert list(one.first()) == ["http://h/a/x", "http://h/x", "http://y/x", "z://x"]


BASE = "http://h.net/a/b/c?q=1"
TARGETS = ["x", "./x", "../x", "../../../x", "/p/./q/../r", "?page=2", "#top", "../", "..", ".", "x/..", "/.well-known/y",
           "//o.net/u/../v", "https://safe.net/x/../y?z#w", "/login?next=http://o.net/", "é/../ü"]


def test_targets_resolve_like_the_library(spark):
    """The forms of resolved targets are those of the standard library, less the fragment."""
    from urllib.parse import urldefrag, urljoin, urlsplit

    def plain(target):
        whole = urldefrag(urljoin(BASE, target))[0]
        # The library carries out the dots of relative targets only.
        return urljoin(whole, urlsplit(whole)._replace(scheme="", netloc="").geturl())

    one = spark.createDataFrame([(t,) for t in TARGETS], "t STRING")
    got = {r.t: r.c for r in one.select("t", canonical_form(resolved(F.col("t"), F.lit(BASE))).alias("c")).collect()}
    assert got == {t: plain(t) for t in TARGETS}


def test_blocks_reach_the_canonical_forms_of_targets_and_sql_agrees(spark):
    """A blocked page that names an alias in any spelling blocks the alias."""
    import duckdb

    from dqspark.llm.url_filter import OP1_SQL

    rows, want = [], {}
    for k, (written, plain) in enumerate({
        "https://safe.net/x#top": "https://safe.net/x", "https://safe.net/y?utm_source=a": "https://safe.net/y",
        "https://safe.net/a/./x": "https://safe.net/a/x", "https://safe.net/a/../z": "https://safe.net/z",
    }.items()):
        rows += [(10 * k, f"http://shop{k}.com/de/{k}", page(canonical(written))), (10 * k + 1, plain, None)]
        want[10 * k + 1] = ("block", "alias")
    for k, (target, plain) in enumerate({
        "?page=2": "http://shop.com/de/7/8?page=2", "./n": "http://shop.com/de/7/n", "../n": "http://shop.com/de/n"}.items()):
        rows += [(100 + k, "http://other.net/k%d" % k, page(canonical(plain))),
                 (200 + k, "http://shop.com/de/7/8", page(refresh(target)))]
        want[100 + k] = ("block", "alias")
    rows += [(300, "http://clean.net/a/../b", page(canonical("#x"))), (301, "http://clean.net/b", None)]
    want |= {300: ("allow", "default"), 301: ("allow", "default")}
    frame = spark.createDataFrame(rows, PAGE)
    got = judge(frame).collect()
    verdicts = {r.page_id: (r.verdict, r.via) for r in got}
    assert {k: verdicts[k] for k in want} == want
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    assert sorted(map(tuple, con.execute(OP1_SQL).fetchall()), key=str) == sorted(map(tuple, got), key=str)


def test_both_ends_of_a_redirect_have_their_forms(spark):
    moved = spark.createDataFrame(
        [("http://s.net/from?utm_a=1", "http://b.example.org/es/1#f"), ("http://t.net/x", "http://u.net/to/./y#z")],
        "source STRING, target STRING")
    rows = [(1, "http://s.net/from", None), (2, "http://u.net/to/y", page(canonical("http://t.com/de/1"))), (3, "http://t.net/x", None)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, PAGE), redirects=moved).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


def test_no_pages(spark):
    assert judge(spark.createDataFrame([], PAGE)).count() == 0


def test_urls_equal_sql(agree):
    agree("op1_url_filter", ["pages"])


def plain_edit(rows):
    """The ring of distinct documents by id; ids are distinct here."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        out[doc] = (text[:len(text) - half] + after[:half], after)
    return out


def shingles(text):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    parts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in parts]
    return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


@pytest.fixture(scope="module")
def fingerprinted(spark, given):
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "é" * 9), (1004, "one two"), (1005, "ONE\ttwo"),
            (1006, " ".join(f"w{i}" for i in range(50_000))), (None, "nameless 𝒳𝒴 text")] + list(given.items())
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS n", "'x' AS th", "0 AS prev")
    pairs = S.edited_pairs(frame).select("*", S.sketch(F.col("edited")).alias("other")).collect()
    return rows, {r.doc_id: r for r in pairs}


def test_edited_texts(fingerprinted):
    rows, got = fingerprinted
    want = plain_edit(rows)
    assert len(got) == len(rows)
    for doc, text in rows:
        assert got[doc].n_chars == len(text or "") and got[doc].edited == want[doc][0]


def test_sketches_estimate_what_texts_share(fingerprinted):
    rows, got = fingerprinted
    want = plain_edit(rows)
    seen, errors = {}, []
    for doc, text in rows:
        a, b = shingles(text or ""), shingles(want[doc][0])
        own, other = set(got[doc].own), set(got[doc].other)
        assert seen.setdefault(frozenset(a), tuple(got[doc].own)) == tuple(got[doc].own)
        assert len(own) == len(got[doc].own) and bool(own) == bool(a)
        assert all(h < S.threshold(S.SCALE) for h in own) or len(own) == 1
        if len(a) > 200 and len(b) > 200:
            errors.append(len(own & other) / min(len(own), len(other)) - len(a & b) / min(len(a), len(b)))
    assert len(errors) > 50 and max(map(abs, errors)) < 0.3 and abs(sum(errors)) / len(errors) < 0.02


def test_sketches_merge(spark):
    draw = random.Random(4)
    one = " ".join(f"a{draw.randrange(10 ** 6)}" for _ in range(400))
    two = " ".join(f"b{draw.randrange(10 ** 6)}" for _ in range(4000))
    frame = spark.createDataFrame([(one, two)], "one STRING, two STRING").select(
        S.sketch(F.col("one")).alias("a"), S.sketch(F.col("two")).alias("b"), S.sketch(F.lit("")).alias("none"))
    r = frame.select("*", S.merge(F.col("a"), F.col("b")).alias("m"), S.merge(F.col("a"), F.col("none")).alias("same"),
                     S.containment(F.col("a"), S.merge(F.col("a"), F.col("b"))).alias("inside"),
                     S.containment(F.col("none"), F.col("none")).alias("empty"),
                     S.containment(F.col("none"), F.col("a")).alias("apart"),
                     S.resemblance(F.col("a"), F.col("a")).alias("own")).first()
    assert r.m == sorted({*r.a, *r.b}) and r.same == r.a
    assert (r.inside, r.empty, r.apart, r.own) == (1.0, 1.0, 0.0, 1.0)


def test_repeated_ids_have_a_defined_next(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d e"), (2, "f")]
    got = S.edited_pairs(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert S.edited_pairs(spark.createDataFrame([(5, "solo one")], "doc_id LONG, text STRING")).first().edited == "solosolo"
    assert S.edited_pairs(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_registered_query(spark, given):
    from dqspark.llm.sketch import op2_document_fingerprints

    got = {r.doc_id: r for r in op2_document_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    want = plain_edit(list(given.items()))
    assert len(got) == len(given)
    for doc in given:
        assert got[doc].edited_sha256 == hashlib.sha256(want[doc][0].encode()).hexdigest()
        assert 0 <= got[doc].near_next <= 1 and (got[doc].fingerprint != got[doc].edited_fingerprint
                                                  or got[doc].near_edited == 1)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)
