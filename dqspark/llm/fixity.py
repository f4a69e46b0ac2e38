"""Merkle fixity audit of archived records.

Records are hashed, and the hashes of ordered byte-offset ranges are hashed again,
level by level, up to one root per file.  Ranges are aligned to fixed offsets, so a
lost record changes the hashes above it and no others.  Replicas compare roots
first and then only the children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqspark.llm.shared import keep, table, text_of

# Bytes under a node of the lowest level above records, and nodes under a node.
RANGE_BYTES = 1 << 16
FANOUT = 16
RECORDS_PER_FILE = 256


def warc_records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """``page_id, file, payload``: a response record per page; files take ``per_file`` consecutive page_ids.

    A null html is an empty body and a null url an empty target.  A null page_id goes
    to file -1.
    """
    body = text_of("html")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), text_of("url"),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"),
        F.concat(head, body, F.lit("\r\n\r\n")).alias("payload"))


def leaves(records: DataFrame, damage: Column | None = None) -> DataFrame:
    """``page_id, file, offset, length, sha``: records at their offsets, which follow page_id and then the hash.

    ``damage`` is what a replica holds in place of ``payload``, at the same offsets
    (null: nothing); its hash is ``replica_sha``.
    """
    held = F.col("payload") if damage is None else damage
    hashed = records.select(
        "page_id", "file", F.octet_length("payload").cast("long").alias("length"),
        F.sha2("payload", 256).alias("sha"), F.sha2(held, 256).alias("replica_sha"))
    before = Window.partitionBy("file").orderBy("page_id", "sha").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _hashed(children: Column) -> Column:
    """One hash over the (place, hash) pairs of a node's children, in order."""
    parts = F.transform(F.sort_array(children), lambda c: F.concat_ws(":", c["at"].cast("string"), c["sha"]))
    return F.sha2(F.array_join(parts, ";"), 256)


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes ``(file, at, sha)`` of each level above records, the lowest first.

    ``leaf`` has ``file, offset, sha``.  Node ``at`` of the lowest level covers the
    offsets from ``at * RANGE_BYTES`` on, so a node has a bounded number of children.
    """
    out = []
    below = leaf.select("file", F.col("offset").alias("place"), "sha",
                        F.floor(F.col("offset") / RANGE_BYTES).alias("at"))
    for _ in range(levels):
        nodes = keep(below.groupBy("file", "at").agg(
            _hashed(F.collect_list(F.struct(F.col("place").alias("at"), "sha"))).alias("sha")), "nodes")
        out.append(nodes)
        below = nodes.select("file", F.col("at").alias("place"), "sha", F.floor(F.col("at") / FANOUT).alias("at"))
    return out


def _different(one: DataFrame, two: DataFrame, at: str) -> DataFrame:
    """Places whose hash differs or is on one side only."""
    left = one.select("file", at, F.col("sha").alias("sha_one"))
    right = two.select("file", at, F.col("sha").alias("sha_two"))
    return left.join(right, ["file", at], "full").where(~F.col("sha_one").eqNullSafe(F.col("sha_two")))


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """``file, offset, sha_one, sha_two, status`` of the records in which two replicas differ.

    Both have ``file, offset, sha`` with one row per record.  ``status`` is ``damaged``,
    ``missing`` (only in the first) or ``extra`` (only in the second).  Of every level
    only children of differing nodes are compared; equal replicas, empty ones included,
    give no row.  Records at the same offset of a file are one place: they are compared
    as the sorted list of their hashes.  Null files or offsets are left out.
    """
    def places(leaf: DataFrame) -> DataFrame:
        return keep(
            leaf.where("file IS NOT NULL AND offset IS NOT NULL").groupBy("file", "offset")
            .agg(F.array_join(F.sort_array(F.collect_list("sha")), ",").alias("sha")), "leaves")

    one, two = places(one), places(two)
    end = one.select("offset").union(two.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, span = 1, RANGE_BYTES
    while end >= span:
        levels, span = levels + 1, span * FANOUT
    trees = tree(one, levels), tree(two, levels)
    bad = _different(trees[0][-1], trees[1][-1], "at").select("file", "at")
    for a, b in zip(trees[0][-2::-1], trees[1][-2::-1]):
        parents = keep(bad.select("file", F.col("at").alias("parent")), "differing")
        inside = [
            t.withColumn("parent", F.floor(F.col("at") / FANOUT)).join(parents, ["file", "parent"], "left_semi")
            for t in (a, b)]
        bad = _different(*inside, "at").select("file", "at")
    parents = keep(bad, "differing")
    inside = [
        t.withColumn("at", F.floor(F.col("offset") / RANGE_BYTES)).join(parents, ["file", "at"], "left_semi")
        for t in (one, two)]
    return _different(*inside, "offset").withColumn(
        "status", F.when(F.col("sha_two").isNull(), "missing").when(F.col("sha_one").isNull(), "extra")
        .otherwise("damaged"))


def replica_payload() -> Column:
    """What the replica of the query holds: some payloads cut short or with a byte changed, some lost."""
    spot = F.crc32(F.col("page_id").cast("string")) % 101
    return (
        F.when(spot == 3, F.lit(None))
        .when(spot == 7, F.substr("payload", F.lit(1), F.char_length("payload") - 5))
        .when(spot == 11, F.concat(F.lit("w"), F.substr("payload", F.lit(2))))
        .otherwise(F.col("payload")))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage located between an archive of all pages and a replica of it with planted faults."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    leaf = keep(leaves(warc_records(pages), replica_payload()), "archive")
    replica = leaf.where("replica_sha IS NOT NULL").select("file", "offset", F.col("replica_sha").alias("sha"))
    found = audit(leaf.select("file", "offset", "sha"), replica)
    where = leaf.select("page_id", F.col("file").alias("f"), F.col("offset").alias("o"), "length")
    return found.join(where, (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o"))).select(
        "page_id", "file", "offset", "length", "status",
        F.col("sha_one").alias("archive_sha256"), F.col("sha_two").alias("replica_sha256"))


OP5_SQL = f"""
WITH RECURSIVE record AS (
    SELECT page_id, CAST(floor(page_id / {RECORDS_PER_FILE}) AS BIGINT) AS file,
           'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
           || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
           || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
           || chr(13) || chr(10) || chr(13) || chr(10) AS payload
    FROM pages),
crc_row AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c0 FROM range(256) t(i)),
crc_step(i, c, k) AS (
    SELECT i, c0, 0 FROM crc_row
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
    FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
crc AS (
    SELECT page_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        string_split(CAST(page_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 101 AS spot
    FROM pages, crc_table),
sided AS (
    SELECT page_id, file, strlen(payload) AS length, sha256(payload) AS archive_sha256,
           CASE WHEN spot = 3 THEN NULL WHEN spot = 7 THEN sha256(substr(payload, 1, length(payload) - 5))
                WHEN spot = 11 THEN sha256('w' || substr(payload, 2)) ELSE sha256(payload) END AS replica_sha256
    FROM record JOIN crc USING (page_id)),
placed AS (
    SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sided)
SELECT page_id, file, "offset", length, CASE WHEN replica_sha256 IS NULL THEN 'missing' ELSE 'damaged' END AS status,
       archive_sha256, replica_sha256
FROM placed WHERE archive_sha256 IS DISTINCT FROM replica_sha256
"""
