"""SimHash near-dedup: linked fingerprints are found in BK-trees, one tree per shard.

A tree over all fingerprints would pass them all through the driver, so shards are
made by the pigeonhole rule: of ``radius + k`` bit blocks, two fingerprints within
the radius agree on at least ``k``, and so meet in the shard of those blocks' value.
Every shard's tree is built and asked in the task that holds it, and only edges
within the radius are followed.  A shard above ``SHARD_ROWS`` is cut into pieces and
each pair of pieces is a task of its own, so no value of a block is too hot.  What
leaves a shard is one link per fingerprint (to the least of its set there), so a
group of copies gives links in proportion to its size; the links' connected
components are the groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqspark.llm.bktree import Forest, hook
from dqspark.llm.graph import components
from dqspark.llm.shared import keep, partitions, table, text_of

SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints per tree, on the average and at the most.
SHARD_MEAN = 4_096
SHARD_ROWS = 20_000
# Rows that a task looks at together, whole shards at a time.
BATCH_ROWS = 50_000
SHINGLES_AT_ONCE = 1 << 16


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; on bytes both touch ASCII only."""
    return text.lower().split()


def shingle_hashes(parts: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by a space; the whole text if it has fewer words."""
    if not parts:
        return np.empty(0, np.uint64)
    whole, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= width:
        return np.array([hashed(whole, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, parts), lambda at, n: at + n + 1, initial=-1))
    return np.fromiter((hashed(whole[a + 1:b], SEED) for a, b in zip(ends, ends[width:])),
                       np.uint64, len(parts) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[i:i + SHINGLES_AT_ONCE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of whole texts, and the columns after them; a null text is empty, its fingerprint zero."""
    beside = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [signed(fingerprint(shingle_hashes(words(t.as_py()), width))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *beside])

    plain = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *beside)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[2:]]
    return plain.mapInArrow(run, ", ".join(["doc_id LONG", "fp LONG", *kinds]))


def block_masks(radius: int, equal: int) -> list[int]:
    """Masks of all choices of ``equal`` out of ``radius + equal`` bit blocks, as signed longs."""
    edges = np.linspace(0, 64, radius + equal + 1).round().astype(int).tolist()
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [signed(sum(c)) for c in itertools.combinations(blocks, equal)]


def equal_blocks(rows: int, radius: int) -> int:
    """The fewest blocks that leave ``SHARD_MEAN`` fingerprints or fewer in an even shard; all finds are exact."""
    equal = 1
    while equal < 6 and rows >> (64 * equal // (radius + equal)) > SHARD_MEAN:
        equal += 1
    return equal


def shards(prints: DataFrame, radius: int, rows: int) -> DataFrame:
    """Each row of ``prints`` (with ``fp``) once for each tree that it is an item of or asks.

    ``tree`` numbers the shard, ``i`` and ``j`` the pieces that meet; a row of piece i
    is an item, one of piece j asks; within one piece it is both.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius, equal_blocks(rows, radius))])
    spread = prints.select("*", F.posexplode(masks).alias("mask_no", "mask")).select(
        "*", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).drop("mask")
    sizes = keep(
        spread.groupBy("mask_no", "bits").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.col("mask_no").alias("m"), F.col("bits").alias("b"),
                F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("pieces")), "shard-sizes")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return (
        spread.join(sizes, (F.col("mask_no") == F.col("m")) & (F.col("bits") == F.col("b")))
        .select("*", piece.alias("own"), other.alias("met"))
        .select(*prints.columns, "mask_no", "bits", F.least("own", "met").alias("i"),
                F.greatest("own", "met").alias("j"), "own")
    )


def _link_batch(tree: np.ndarray, fps: np.ndarray, item: np.ndarray, asks: np.ndarray, radius: int) -> np.ndarray:
    """The least linked row of each row, over whole trees."""
    parent = np.arange(len(fps))
    items, asking = np.flatnonzero(item), np.flatnonzero(asks)
    forest = Forest(tree[items], fps[items])
    at, own = forest.items(np.arange(len(forest.run_start)))
    hook(parent, items[forest.members[forest.run_start]][at], items[own])
    for asked, node in forest.search(tree[asking], fps[asking], radius):
        hook(parent, asking[asked], items[forest.members[forest.run_start[node]]])
    return parent


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)`` whose components are those of all links between rows of ``prints(fp)``.

    Rows link if their fingerprints differ in at most ``radius`` bits.
    """
    rows = prints.count()
    dealt = shards(prints.select("fp"), radius, rows)
    group = ["mask_no", "bits", "i", "j"]
    n = partitions(prints.sparkSession, rows * len(block_masks(radius, equal_blocks(rows, radius))), 20 * BATCH_ROWS)
    ready = dealt.repartition(n, *group).sortWithinPartitions(*group)

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        fps, mask_no, bits, i, j, own = [whole.column(k).to_numpy() for k in range(6)]
        new = np.ones(len(fps), bool)
        new[1:] = ((mask_no[1:] != mask_no[:-1]) | (bits[1:] != bits[:-1])
                   | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        parent = _link_batch(np.cumsum(new), fps.view(np.uint64), own == i, own == j, radius)
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fps[moved], pa.int64()), pa.array(fps[parent[moved]], pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = [whole.column(c).to_numpy() for c in group]
            last = np.logical_or.reduce([k != k[-1] for k in keys])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield from work(whole.slice(0, cut).to_batches())
            held = whole.slice(cut).to_batches()
            size = whole.num_rows - cut
        if held:
            yield from work(held)

    return ready.mapInArrow(run, "src LONG, dst LONG").where("src <> dst").distinct()


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``fp`` in place of the text, and ``fp, least, component`` of each fingerprint."""
    marked = keep(fingerprints(docs, width), "fingerprints")
    prints = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    linked = components(links(prints.select("fp"), radius))
    return marked, keep(
        prints.join(linked, prints["fp"] == linked["node"], "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component")), "members")


def near_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Fingerprints over shingles of ``width`` words link within ``radius`` bits; the
    component's id is the least doc_id reachable.  Texts without words (null, empty,
    blank) have fingerprint zero and link like any other.  Rows that repeat a doc_id
    are rows of their own; a null doc_id never becomes a component's id unless the
    component has no other.  Other columns are not looked at.
    """
    marked, named = _grouped(docs.select("doc_id", "text"), width, radius)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = keep(named.join(ids, "component").select(F.col("fp").alias("known"), "component_id"), "ids")
    return marked.join(by_print, F.col("fp") == F.col("known")).select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def first_of_near_copies(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``near_groups`` the least doc_id stays.

    Texts without words are one class, so one of them stays.  A null text is empty; a
    null doc_id goes before any other; of rows that repeat doc_id and text one stays,
    of rows that repeat the doc_id alone the one with the least hash.  All columns,
    however named, are kept as they are.
    """
    text = text_of()
    marked, named = _grouped(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")), width, radius)
    firsts = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    stay = keep(
        firsts.join(named.select(F.col("fp").alias("known"), "component"), F.col("fp") == F.col("known"))
        .groupBy("component").agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("stay_id"), F.col("first.th").alias("stay_th")), "stay")
    # Places instead of names, so that no column of the documents can clash.
    places = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (places[docs.columns.index(c)] for c in ("doc_id", "text"))
    moved = docs.toDF(*places)
    same = F.col(key).cast("long").eqNullSafe(F.col("stay_id")) & (F.xxhash64(text_of(text)) == F.col("stay_th"))
    turn = F.row_number().over(Window.partitionBy("stay_id", "stay_th").orderBy("stay_id"))
    return moved.join(stay, same).withColumn("turn", turn).where("turn = 1").select(*places).toDF(*docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
