"""Readers.  Cells arrive as text; types are inferred or declared afterwards."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dqspark.functions.scalars import col
from dqspark.operators.quality import MIN_COLS, MIN_ROWS

# Texts a CSV reader takes as a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Ids leave so many bits for the place in the file.
PLACE_BITS = 40
# Cells of a line, each behind its comma: a quoted one with doubled quotes inside, or anything up to the next comma.
CELL = r',("[^"]*(?:""[^"]*)*"|[^,]*)'
# A type in the text form of a schema, or a name before its colon.
_SCHEMA_WORD = re.compile(r"`(?:[^`]|``)*`(?:\s*:)?|\w+(?:\(\d+,\s*\d+\))?(?:\s*:)?")


def missing_to_null(df: DataFrame) -> DataFrame:
    texts = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[
        F.when(~col(c).isin(*MISSING_TOKENS), col(c)).alias(c) if c in texts else col(c)
        for c in df.columns
    ])


def file_path() -> Column:
    """The scanned file, written the same way wherever Spark gives it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")


def record_place() -> Column:
    """The place of a record of a text scan within its file, rising but with gaps.

    A record takes a byte or more, so the number of records before it in its split,
    behind where the split starts, never reaches where the next one starts.
    """
    counter = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + counter


def file_ranks(df: DataFrame) -> DataFrame:
    """``__file, __rank`` of the files behind a scan, in the order of their paths; from the listing alone."""
    return _ranked(df.sparkSession, {re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in df.inputFiles()})


def _ranked(spark: SparkSession, paths: set[str]) -> DataFrame:
    """A local table, so that the planner knows its size: a small one is broadcast and the scan not shuffled."""
    listed = sorted(paths)
    return spark.createDataFrame(pa.table({
        "__file": pa.array(listed, pa.string()), "__rank": pa.array(range(len(listed)), pa.int64())}))


def with_file_row_id(df: DataFrame, name: str = "row_id", parquet: bool = False) -> DataFrame:
    """Number rows of a file scan in file order, whatever the order of its splits.

    The file's rank goes in front of the place inside the file; the data are scanned once.
    """
    place = F.col("_metadata.row_index") if parquet else record_place()
    tagged = df.select("*", file_path().alias("__path"), place.alias("__place"))
    number = F.shiftleft(F.col("__rank"), PLACE_BITS) + F.col("__place")
    return tagged.join(file_ranks(df), F.col("__path") == F.col("__file")).select(
        number.alias(name), *[col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], *, tolerant: bool = False,
             row_id: str | None = None) -> DataFrame:
    """All columns as text, missing tokens as NULL.

    ``tolerant`` skips lines that do not fit and reads Latin-1.  Lines are then judged by all their
    cells, whichever columns are asked for.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if tolerant:
        reader = reader.option("mode", "DROPMALFORMED").option("encoding", "ISO-8859-1")
        reader = reader.option("columnPruning", False)
    raw = reader.csv(path)
    if row_id is not None:
        raw = with_file_row_id(raw, row_id)
    return missing_to_null(raw)


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as ``a.b`` columns; lists as JSON text."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here, f.dataType

    out = []
    for path, kind in leaves(df.schema, ()):
        ref = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            ref = F.to_json(ref)
        out.append(ref.alias(".".join(path)))
    return df.select(*out)


def _kinds(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """The files that hold one JSON value, and those that hold one per line.

    A file holds one per line if its first written line is a whole object and another
    written line follows.  One row per file comes to the driver, which lists them anyway.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        file_path().alias("file"), F.struct(record_place().alias("place"), "value").alias("line"))
    first = lines.groupBy("file").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    whole = F.trim("line.value").startswith("{") & F.try_parse_json("line.value").isNotNull()
    kinds = first.select("file", (whole & (F.col("n") > 1)).alias("lines")).collect()
    return [r.file for r in kinds if not r.lines], [r.file for r in kinds if r.lines]


def _root_items(files: DataFrame) -> DataFrame:
    """``file, place, item`` of whole JSON texts ``(file, value)``: a root list's items, an object's
    first list in its own order of keys, else the value itself.
    """
    keyed = files.select(
        "file", F.parse_json("value").alias("root"), F.trim("value").startswith("[").alias("listed"),
        F.coalesce(F.from_json("value", "MAP<STRING, VARIANT>"), F.lit(None)).alias("keys"))
    lists = F.filter(F.map_values("keys"), lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    chosen = keyed.select("file", "root", F.when(F.col("listed"), F.col("root")).otherwise(F.get(lists, F.lit(0))).alias("list"))
    items = chosen.where("list IS NOT NULL").lateralJoin(
        files.sparkSession.tvf.variant_explode(F.col("list").outer())).select(
        "file", F.col("pos").cast("bigint").alias("place"), F.col("value").alias("item"))
    lone = chosen.where("list IS NULL").select("file", F.lit(0).cast("bigint").alias("place"), F.col("root").alias("item"))
    return items.unionByName(lone)


def _plain_types(schema: str) -> str:
    """The text form of a variant schema as column types: fractions as doubles, unclear values as text."""
    def word(found: re.Match) -> str:
        text = found[0]
        if text.endswith(":") or text.startswith("`"):
            return text
        if text.startswith("DECIMAL"):
            return "DOUBLE"
        return {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING", "FLOAT": "DOUBLE"}.get(text, text)
    return _SCHEMA_WORD.sub(word, schema)


def read_json(spark: SparkSession, path: str | Sequence[str], row_id: str | None = None) -> DataFrame:
    """One row per item of every file, judged by itself.

    A file of one value gives the items of a root list, the first list of an object, or
    the object; a file of one object per line gives its lines.  Columns are those of all
    items, nested ones as ``a.b``; items that are no objects are in ``value``.
    Malformed texts fail.
    """
    whole, lines = _kinds(spark, path)
    parts = []
    if whole:
        texts = spark.read.text([unquote(f) for f in whole], wholetext=True)
        parts.append(_root_items(texts.select(file_path().alias("file"), "value")))
    if lines:
        texts = spark.read.text([unquote(f) for f in lines])
        parts.append(texts.where(F.trim("value") != "").select(
            file_path().alias("file"), record_place().alias("place"), F.parse_json("value").alias("item")))
    if not parts:
        return spark.createDataFrame([], "value STRING" if row_id is None else f"`{row_id}` BIGINT, value STRING")
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    fields, others = items.agg(
        F.schema_of_variant_agg(F.when(is_object, F.col("item"))),
        F.schema_of_variant_agg(F.when(~is_object, F.col("item")))).first()
    kept, columns, shown = [], [], []
    if row_id is not None:
        # One row per file.
        items = items.join(_ranked(spark, {*whole, *lines}), F.col("file") == F.col("__file"))
        kept = [(F.shiftleft(F.col("__rank"), PLACE_BITS) + F.col("place")).alias(row_id)]
        shown = [col(row_id)]
    if fields not in ("VOID", "OBJECT<>"):
        columns.append(F.try_variant_get(F.when(is_object, F.col("item")), "$", _plain_types(fields)).alias("__fields"))
        shown.append(F.col("__fields.*"))
    if others != "VOID" or not columns:
        columns.append(F.try_variant_get(F.when(~is_object, F.col("item")), "$", _plain_types(others)).alias("__value"))
        shown.append(F.col("__value").alias("value"))
    found = items.select(*kept, *columns).select(*shown)
    return flatten(found) if fields not in ("VOID", "OBJECT<>") else found


def read(spark: SparkSession, path: str, fmt: str = "auto", *, tolerant: bool = False,
         row_id: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Pick the reader by extension; an unknown one tries CSV, then JSON."""
    lowered = path.lower()
    if lowered.startswith(("http://", "https://")):
        raise ValueError("URL inputs are not supported; read a file instead")
    kind = fmt
    if fmt == "auto":
        kind = next((k for k in ("csv", "json", "parquet") if lowered.endswith("." + k)), "unknown")
    if kind == "csv":
        df = read_csv(spark, path, tolerant=tolerant, row_id=row_id)
    elif kind == "json":
        df = read_json(spark, path, row_id)
    elif kind == "parquet":
        df = spark.read.parquet(path)
        if row_id is not None:
            df = with_file_row_id(df, row_id, parquet=True)
    elif kind == "unknown":
        df = read_csv(spark, path, tolerant=tolerant, row_id=row_id)
        if len(df.columns) - (row_id is not None) < 2:
            df = read_json(spark, path, row_id)
    else:
        raise ValueError(f"unsupported format: {kind}")
    if max_rows is not None:
        if row_id is None:
            raise ValueError("max_rows needs a row_id: rows have no order of their own")
        df = df.orderBy(col(row_id)).limit(max_rows)
    return df


def cells_of(line: Column) -> Column:
    """The cells of a CSV line; quoted ones may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), 1)
    return F.transform(found, lambda c: F.when(
        c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def read_labelled(spark: SparkSession, folders: Mapping[int, str | Sequence[str]]) -> DataFrame:
    """Cells ``(dataset_id, label, row_id, col_name, value)`` of many CSV files in one job.

    ``folders`` maps a label (1 good, 0 bad) to paths.  Files may have different
    headers: each file's first record names its cells, and a record's cells beyond the
    header's number are left out.  Files below the minimum size are left out.  Each
    file's header and number of records are found by one aggregate, combined inside the
    tasks, so no schema has to fit all files.
    """
    out = None
    for label, paths in folders.items():
        raw = spark.read.text(paths).where(F.trim("value") != "").select(
            F.col("_metadata.file_name").alias("dataset_id"), record_place().alias("row_id"), "value")
        heads = raw.groupBy("dataset_id").agg(
            F.min(F.struct("row_id", "value")).alias("head"), (F.count(F.lit(1)) - 1).alias("rows")).select(
            "dataset_id", F.col("head.row_id").alias("header_id"), cells_of(F.col("head.value")).alias("header"), "rows",
        ).where((F.col("rows") >= MIN_ROWS) & (F.size("header") >= MIN_COLS))
        body = raw.join(heads, "dataset_id").where(F.col("row_id") != F.col("header_id"))
        part = body.select(
            "dataset_id", F.lit(label).alias("label"), "row_id",
            F.inline(F.arrays_zip(
                F.col("header").alias("col_name"),
                F.slice(cells_of(F.col("value")), F.lit(1), F.size("header")).alias("value"))),
        ).toDF("dataset_id", "label", "row_id", "col_name", "value")
        part = part.withColumn(
            "value", F.when(~F.col("value").isin(*MISSING_TOKENS), F.col("value")))
        out = part if out is None else out.unionByName(part)
    return out
