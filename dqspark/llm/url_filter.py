"""URL filters: rules decide, and block decisions reach every alias of a blocked url.

Aliases are the connected components over redirect and canonical-link edges: the
``rel=canonical`` link and the ``refresh`` target in a page, redirects given as a
table, and the canonical form (no fragment, no ``utm_`` parameters, no dot segments) of
each url of a page, a link or a redirect.  A url that a rule allows stays allowed whatever its aliases are; a url without a rule is
blocked if any alias is blocked by a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.llm.graph import components
from dqspark.llm.shared import ascii_lower, keep, table

# (rule, verdict); a rule is host/path, and its list is as short as a list in a program.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
CANONICAL_TAG = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
# A target with a scheme of its own.
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
TRACKING = r"(?i)([?&])utm_[a-z_]*=[^&]*"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """A struct of the longest rule that fits and its verdict, or null; of equally long ones an allowing rule."""
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", r[0])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + start))
        picked = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(picked)
    return picked


def without_dots(url: Column) -> Column:
    """The url with ``.`` and ``..`` of its path carried out."""
    parts = F.split(path_of(url), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends_open = F.element_at(parts, -1).isin(".", "..")
    path = F.array_join(F.when(ends_open, F.concat(left, F.array(F.lit("")))).otherwise(left), "/")
    head = F.regexp_extract(url, "^.*?://[^/?#]*", 0)
    tail = F.regexp_extract(after_scheme(url), "^[^?#]*(.*)", 1)
    return F.when(F.instr(path_of(url), "/.") > 0, F.concat(head, path, tail)).otherwise(url)


def canonical_form(url: Column) -> Column:
    """The url without fragment, ``utm_`` parameters and dot segments."""
    bare = F.regexp_replace(F.regexp_extract(url, "^[^#]*", 0), TRACKING, "$1")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "&&+", "&"), r"\?&+", "?"), "[?&]+$", "")
    return without_dots(cut)


def _target(html: Column, tag: str, attribute: str) -> Column:
    found = F.regexp_extract(F.regexp_extract(html, tag, 0), attribute, 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit("&amp;"), F.lit("&"))


def resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute url; null for null or where the page's url has no ``://``.

    Dot segments stay for ``canonical_form``.
    """
    scheme = F.regexp_extract(url, "^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))
    path = path_of(url)
    folder = F.regexp_replace(path, "[^/]*$", "")
    absolute = F.when(target.rlike(ABSOLUTE), target)
    relative = (
        F.when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("#")), F.concat(F.regexp_extract(url, "^[^#]*", 0), target))
        .when(F.startswith(target, F.lit("?")),
              F.concat(site, F.when(path == "", F.lit("/")).otherwise(path), target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )
    return F.coalesce(absolute, F.when(F.instr(url, "://") > 0, relative))


def _both(*pairs: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in pairs])).alias("e")


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` urls that stand for the same document.

    A link's target and both ends of a redirect are tied to their own canonical forms.
    """
    url, canonical, refresh = F.col("url"), F.col("canonical"), F.col("refresh")
    linked = pages.where("url IS NOT NULL").select(
        "url", resolved(_target(F.col("html"), CANONICAL_TAG, HREF), url).alias("canonical"),
        resolved(_target(F.col("html"), REFRESH_TAG, REFRESH_URL), url).alias("refresh"))
    edges = linked.select(_both(
        (url, canonical_form(url)), (url, canonical), (canonical, canonical_form(canonical)),
        (url, refresh), (refresh, canonical_form(refresh))))
    if redirects is not None:
        source, target = F.col("source"), F.col("target")
        edges = edges.union(redirects.select(_both(
            (source, target), (source, canonical_form(source)), (target, canonical_form(target)))))
    return edges.select("e.src", "e.dst").where("dst IS NOT NULL AND src IS NOT NULL AND src <> dst")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, via`` for every row of ``pages(page_id, url, html)``.

    ``via`` says what decided: ``rule``, ``alias`` or ``default``.  ``redirects`` adds
    edges ``(source, target)``.  A null url, or one without ``://``, has an empty host
    and path; no rule fits it, and a null url has no alias.  A null html has no links.
    Repeated rows and urls are judged alike, and other columns are not looked at.
    """
    nodes = components(alias_edges(pages.select("url", "html"), redirects))
    members = keep(nodes.select(
        "node", "component",
        F.coalesce(rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"] == "block",
                   F.lit(False)).alias("bad")), "aliases")
    tainted = keep(members.where("bad").select(F.col("component").alias("tainted")).distinct(), "tainted")
    blocked = keep(members.join(tainted, F.col("component") == F.col("tainted")).select("node"), "blocked")
    plain = pages.select("page_id", "url").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = plain.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    by_alias = F.col("node").isNotNull()
    return ruled.join(blocked, F.col("url") == F.col("node"), "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(by_alias, "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(by_alias, "alias").otherwise("default").alias("via"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql_rule(host: str, path: str, value: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[0])):
        at, slash, start = rule[0].partition("/")
        cases.append(f"WHEN ({host} = '{at}' OR ends_with({host}, '.{at}')) "
                     f"AND starts_with({path}, '{slash}{start}') THEN '{rule[value]}'")
    return f"CASE {' '.join(cases)} END"


_HOST = ("translate(regexp_extract(CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) "
         "ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_PATH = ("regexp_extract(CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) "
         "ELSE '' END, '^[^/?#]*([^?#]*)', 1)")
_CUT = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract({0}, '^[^#]*'), "
        "'([?&])utm_[a-z_]*=[^&]*', '\\1', 'gi'), '&&+', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+$', '')")


def _sql_forms(source: str) -> str:
    """``(src, dst)``: the urls ``u`` of a query and their canonical forms."""
    path = _PATH.format("c")
    return f"""SELECT u AS src, CASE WHEN instr({path}, '/.') = 0 THEN c ELSE regexp_extract(c, '^.*?://[^/?#]*')
  || array_to_string(CASE WHEN parts[-1] IN ('.', '..') THEN done || [''] ELSE done END, '/')
  || regexp_extract(substr(c, instr(c, '://') + 3), '^[^?#]*(.*)', 1) END AS dst
FROM (SELECT *, list_reduce(list_transform(parts, lambda x: [x]), lambda d, x: CASE x[1] WHEN '.' THEN d
    WHEN '..' THEN CASE WHEN len(d) > 1 THEN d[:len(d) - 1] ELSE d END ELSE d || x END) AS done
  FROM (SELECT u, c, string_split({path}, '/') AS parts FROM (SELECT u, {_CUT.format("u")} AS c FROM ({source}) a) b) d) e"""


def _sql_link(tag: str, attribute: str) -> str:
    tag, attribute = tag.replace("'", "''"), attribute.replace("'", "''")
    found = (f"replace(nullif(regexp_extract(regexp_extract(html, '{tag}'), '{attribute}', 1), ''), "
             "'&amp;', '&')")
    site = "regexp_extract(url, '^(.*?://[^/?#]*)', 1)"
    path = _PATH.format("url")
    return (f"SELECT url AS src, CASE WHEN regexp_matches(t, '{ABSOLUTE}') THEN t WHEN instr(url, '://') = 0 THEN NULL "
            f"WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t "
            f"WHEN starts_with(t, '/') THEN {site} || t WHEN starts_with(t, '#') THEN regexp_extract(url, '^[^#]*') || t "
            f"WHEN starts_with(t, '?') THEN {site} || coalesce(nullif({path}, ''), '/') || t ELSE {site} || coalesce(nullif("
            f"regexp_replace({path}, '[^/]*$', ''), ''), '/') || t END AS dst "
            f"FROM (SELECT url, {found} AS t FROM pages)")


OP1_SQL = f"""
WITH RECURSIVE links AS (
    {_sql_link(CANONICAL_TAG, HREF)} UNION {_sql_link(REFRESH_TAG, REFRESH_URL)}),
edges AS (
    SELECT src, dst FROM links WHERE dst IS NOT NULL
    UNION {_sql_forms("SELECT url AS u FROM pages UNION SELECT dst FROM links WHERE dst IS NOT NULL")}),
both_ways AS (
    SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach AS (
    SELECT src AS node, src AS other FROM both_ways
    UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
blocked AS (
    SELECT DISTINCT node FROM (
        SELECT node, {_HOST.format('other')} AS h, {_PATH.format('other')} AS p FROM reach)
    WHERE {_sql_rule('h', 'p', 1)} = 'block'),
parts AS (
    SELECT page_id, url, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path
    FROM pages),
ruled AS (
    SELECT *, {_sql_rule('host', 'path', 0)} AS rule, {_sql_rule('host', 'path', 1)} AS decided FROM parts)
SELECT page_id, host, path, rule,
       coalesce(decided, CASE WHEN node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN decided IS NOT NULL THEN 'rule' WHEN node IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM ruled LEFT JOIN blocked ON ruled.url = blocked.node
"""
