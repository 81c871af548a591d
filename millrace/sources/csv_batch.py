"""Batches of source files: reading, identity, landing and export."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import CONTRACTS
from ..operators.validation import ROW

MOST_BYTES, MOST_ROWS = 25 << 20, 250_000
#: Bytes of a file that one task reads whole, and of a block of a larger one.
WHOLE, BLOCK = 512 << 20, 64 << 20


class BatchError(ValueError):
    """A batch directory or file that can't be read as one."""


def _list(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and sizes of the files of a folder, in any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(path) if s.isFile()}


def _checked(path: str, cells: list[str | None] | None) -> list[str]:
    if not cells:
        raise BatchError(f"{path} has no header")
    names = [c if c is None else c.strip("\ufeff") for c in cells]
    if any(not c for c in names) or len(set(names)) < len(names):
        raise BatchError(f"{path} has empty or repeated column names")
    return names


def header_of(spark: SparkSession, path: str) -> list[str]:
    """A file's header: given, without empty or repeated names. Only the file's first line is read, by the driver."""
    if path.endswith((".gz", ".bz2", ".zst", ".xz")):
        first = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
        return _checked(path, list(first[0]) if first else None)
    jvm, where = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return _checked(path, next(csv.reader([line]), None) if line else None)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The path itself if it is a file, else the files of the folder in the order of their names; hidden ones don't count."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(where).isDirectory():
        return [path]
    found = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile())
    return [f for f in found if not f.rsplit("/", 1)[-1].startswith(("_", "."))]


def by_header(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """(header, files) for each header that the files have, so that every file is read by its own."""
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(header_of(spark, p)), []).append(p)
    return [(list(h), files) for h, files in groups.items()]


def _numbered(frames: list[DataFrame], each: bool = False) -> tuple[list[DataFrame], int, int]:
    """The frames with `_source_row_number`, how many rows they have, and how many of them have more fields than their header.

    Rows are numbered in the JVM, by files in the order of their names, or in each file from 2 on: within a block of a file by their
    increasing ids, blocks by the counts of those before them, a small row a block. The rows are persisted, so that counts and numbers
    stand on the same blocks and a file is parsed once."""
    spots = [df.select("*", F.monotonically_increasing_id().alias("_spot"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).persist() for df in frames]
    blocks = None
    for i, spot in enumerate(spots):
        own = spot.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.count("_more").alias("_over"), F.min("_spot").alias("_first")).withColumn("_of", F.lit(i))
        blocks = own if blocks is None else blocks.unionByName(own)
    total = blocks.agg(F.sum("_n"), F.sum("_over")).first()
    before = (W.partitionBy("_file").orderBy("_block") if each else W.orderBy("_file", "_block")).rowsBetween(W.unboundedPreceding, -1)
    shifts = blocks.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 2 - F.col("_first"))
    out = []
    for i, (df, spot) in enumerate(zip(frames, spots, strict=True)):
        own = shifts.filter(F.col("_of") == i).select("_file", "_block", "_shift")
        out.append(spot.join(own, ["_file", "_block"]).select(*df.columns, "_file", (F.col("_spot") + F.col("_shift")).alias(ROW)))
    return out, total[0] or 0, total[1] or 0


def _parsed(spark: SparkSession, header: list[str], paths: list[str], multiline: bool) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_more"]])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE").csv(paths)


def read_files(spark: SparkSession, header: list[str], paths: list[str], multiline: bool = False) -> DataFrame:
    """Files of one header as text columns, with `_file` and the row's number in its file; rows with too many fields are an error."""
    (rows,), _, more = _numbered([_parsed(spark, header, paths, multiline)], each=True)
    if more:
        raise BatchError(f"of {paths} some have rows of more than {len(header)} fields")
    return rows.drop("_more")


def read_source(spark: SparkSession, path: str, multiline: bool = False, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """A source file as text columns with `_source_row_number`, from 2 on, in the file's order (of a folder's files in the order of
    their names, each read by its own header: columns meet by name, and what a file lacks is null). Empty cells are null; short rows end
    in nulls; rows with too many fields are an error. `multiline` allows newlines in cells, at the price of an unsplit file."""
    groups = by_header(spark, files_of(spark, path))
    if not groups:
        raise BatchError(f"{path} has no header")
    frames, most, more = _numbered([_parsed(spark, header, files, multiline) for header, files in groups])
    if more:
        raise BatchError(f"{path} has rows of more fields than their header")
    if most_rows is not None and most > most_rows:
        raise BatchError(f"{path} has {most} rows, more than {most_rows}")
    out = frames[0].drop("_more", "_file")
    for df in frames[1:]:
        out = out.unionByName(df.drop("_more", "_file"), allowMissingColumns=True)
    return out


def read_batch(spark: SparkSession, folder: str, most_bytes: int | None = MOST_BYTES, most_rows: int | None = MOST_ROWS) -> dict[str, DataFrame]:
    """Every registered source that the folder holds; other csv files, and a folder without any source, are errors."""
    found = {n: s for n, s in _list(spark, folder).items() if n.endswith(".csv")}
    strays = sorted(n for n in found if n.removesuffix(".csv") not in CONTRACTS)
    if strays or not found:
        raise BatchError(f"unknown files {strays}" if strays else f"no source file in {folder}")
    large = sorted(n for n, s in found.items() if most_bytes is not None and s > most_bytes)
    if large:
        raise BatchError(f"{large} exceed {most_bytes} bytes")
    return {s: read_source(spark, f"{folder}/{s}.csv", most_rows=most_rows) for s in CONTRACTS if f"{s}.csv" in found}


def _identified(files: DataFrame, batch_id: str) -> list[Column]:
    """The columns of a file's identity, from its path, length and checksum."""
    name = F.element_at(F.split("path", "/"), -1)
    source = F.regexp_replace(name, r"\.csv$", "")
    key = F.concat(F.lit("incoming/"), source, F.lit(f"/{batch_id}/"), F.col("checksum"), F.lit("-"), name)
    return [source.alias("source_name"), F.concat(source, F.lit(f"/{batch_id}")).alias("logical_key"), F.col("checksum"), F.col("length").alias("size_bytes"), key.alias("object_key")]


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, length) to the digest of those bytes, read by themselves."""
    for batch in batches:
        digests = []
        for path, start, length in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "size")), strict=True):
            store, inner = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_file(inner) as f:
                f.seek(start)
                while length > 0 and (data := f.read(min(length, 1 << 22))):
                    digest.update(data)
                    length -= len(data)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(digests, pa.string())], ["path", "start", "digest"])


def block_checksums(spark: SparkSession, sizes: dict[str, int], block: int = BLOCK) -> DataFrame:
    """(path, length, checksum) of files of any size: the SHA-256 of the digests of their blocks, in order, which executors read by
    ranges, so that no file is ever in one place. Paths are URIs that Arrow's file systems open."""
    files = spark.createDataFrame(sorted(sizes.items()), "path string, length long")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block).cast("long"))).alias("start"), "length")
    blocks = blocks.select("path", "start", F.least(F.lit(block), F.col("length") - F.col("start")).alias("size")).repartition("path", "start")
    hashed = blocks.mapInArrow(_hash_blocks, "path string, start long, digest string")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"]), "")
    return files.join(hashed.groupBy("path").agg(F.concat(F.lit("blocks-"), F.sha2(whole, 256)).alias("checksum")), "path").select("path", "length", "checksum")


def _split_by_size(spark: SparkSession, folder: str, most: int) -> tuple[list[str], dict[str, int]]:
    found = {f"{folder.rstrip('/')}/{n}": s for n, s in sorted(_list(spark, folder).items()) if n.endswith(".csv")}
    return [p for p, s in found.items() if s <= most], {p: s for p, s in found.items() if s > most}


def file_identity(spark: SparkSession, folder: str, batch_id: str, most: int = WHOLE) -> DataFrame:
    """(source_name, logical_key, checksum, size_bytes, object_key) of each csv file: SHA-256 of its bytes, and a key by content, so
    that the same bytes land in the same place. Files of more than `most` bytes are told by their blocks (`block_checksums`)."""
    small, large = _split_by_size(spark, folder, most)
    parts = []
    if small:
        parts.append(spark.read.format("binaryFile").load(small).select("path", "length", F.sha2("content", 256).alias("checksum")))
    if large:
        parts.append(block_checksums(spark, large))
    if not parts:
        parts.append(spark.createDataFrame([], "path string, length long, checksum string"))
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return files.select(*_identified(files, batch_id))


def land(spark: SparkSession, folder: str, batch_id: str, landing: str, most: int = WHOLE) -> DataFrame:
    """Files of a batch, bytes included, put in a landing table by source and batch before anything is parsed; the same content twice is
    kept once. Files of more than `most` bytes stay where they are: their row has their path instead of bytes. Gives their identity."""
    small, large = _split_by_size(spark, folder, most)
    parts = []
    if small:
        parts.append(spark.read.format("binaryFile").load(small).select("path", "length", F.sha2("content", 256).alias("checksum"), "content"))
    if large:
        parts.append(block_checksums(spark, large).withColumn("content", F.lit(None).cast("binary")))
    if not parts:
        return file_identity(spark, folder, batch_id, most)
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = files.select(*_identified(files, batch_id), F.lit(batch_id).alias("batch_id"), F.when(F.col("content").isNull(), F.col("path")).alias("kept_at"), "content").dropDuplicates(["object_key"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(landing).select("object_key"), "object_key", "left_anti")
    rows.write.mode("append").partitionBy("source_name", "batch_id").parquet(landing)
    return file_identity(spark, folder, batch_id, most)


def export_csv(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as sorted csv in its own folder, and a manifest of row counts as json; gives the counts."""
    from ..operators.tables import row_counts

    for name, df in tables.items():
        df.repartitionByRange(df.columns[0]).sortWithinPartitions(df.columns[0]).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    counts = row_counts(tables)
    counts.write.json(f"{folder}/manifest")
    return counts
