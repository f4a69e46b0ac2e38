"""Line dedup: lines that many documents share go, wherever they stand.

Lines are exploded as hashes of their normalised key, counted per document, and
documents are put together again by position.  Only hashes, ids and positions are
shuffled to find the lines; texts move once, to meet their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.llm.shared import BLANKS, ascii_lower, keep, table, text_of

MIN_CHARS = 40
MIN_DOCS = 5


def _hashes(docs: DataFrame, min_chars: int) -> Column:
    """One 128-bit hash per line, null where the key is too short to count.

    Step by step over the whole array, so that each step is made once per line: what a
    lambda mentions twice is made twice.
    """
    def lowered(line: Column) -> Column:
        # Where all is ASCII the plain function does the same, much faster.
        plain = F.octet_length(line) == F.char_length(line)
        return F.when(F.char_length(line) >= min_chars, F.when(plain, F.lower(line)).otherwise(ascii_lower(line)))

    def hashed(key: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))

    trimmed = F.transform(F.split(F.col("text"), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(F.transform(trimmed, lowered), hashed)


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(a, b, keep_id)``: hashes of keys found in ``min_docs`` documents, with the largest doc_id holding them."""
    plain = docs.select("doc_id", text_of().alias("text"))
    keys = plain.select("doc_id", F.explode(F.array_distinct(_hashes(plain, min_chars))).alias("h"))
    return (
        keys.where("h IS NOT NULL").groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
        .where(F.col("n") >= min_docs).drop("n")
    )


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` less its shared lines, and ``n_lines`` and ``n_dropped`` added.

    A line counts by its key: ASCII white space at both ends gone, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines, except in the document with the largest doc_id
    holding them.  Every row is a document: rows that repeat a doc_id count one by
    one, and all of those with the largest doc_id keep the line.  A null text
    becomes an empty one (one empty line).  A null doc_id is smaller than any other.
    Other columns pass through; columns named like the two new ones are replaced.
    """
    gone = keep(shared_lines(docs, min_chars, min_docs), "shared-lines")
    plain = docs.select("doc_id", text_of().alias("text"))
    at = (
        plain.select("doc_id", F.xxhash64("text").alias("th"),
                     F.posexplode(_hashes(plain, min_chars)).alias("pos", "h"))
        .where("h IS NOT NULL")
        .select("doc_id", "th", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .join(gone, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_set("pos").alias("gone"))
    )
    left = docs.drop("n_lines", "n_dropped")
    # Places instead of names, so that no column of the documents can clash.
    places = [f"c{i}" for i in range(len(left.columns))]
    key, text = (places[left.columns.index(c)] for c in ("doc_id", "text"))
    moved = left.toDF(*places).withColumn(text, text_of(text))
    met = moved.join(
        keep(at, "line-positions"),
        F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th")), "left")
    lines = F.split(F.col(text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    cut = F.col("gone").isNotNull()
    return met.select(
        *[F.when(cut, F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
          .otherwise(F.col(text)) if c == text else F.col(c) for c in places],
        F.size(lines).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    ).toDF(*left.columns, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what is left, for all documents."""
    left = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), " \
       "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
gone AS (
    SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= {MIN_CHARS}
    GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
    SELECT doc_id, pos, line, gone.k IS NOT NULL AND doc_id <> keep_id AS out
    FROM keyed LEFT JOIN gone ON keyed.k = gone.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
