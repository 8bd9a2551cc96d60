"""Scans of the driver tables and of the reference's file formats.

Everything is a lazy DataFrame; Catalyst prunes columns and pushes filters
into the parquet / CSV readers.
"""

from __future__ import annotations

import csv
import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TASK_BYTES = 1 << 20  # of the scanned files, for a task that does costly work on each row


def spread(df: DataFrame, *scans: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if the ``scans`` it comes from have fewer splits than
    there are cores (a file of one row group, or one that cannot be split), so that
    costly work on each row does not run in one task.  The number of tasks grows with the
    scanned files (``TASK_BYTES``), so no task grows with the input.  Anything that has splits
    enough stays as it is: they already keep the cores busy, and a shuffle would only cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = all(scan.rdd.getNumPartitions() < cores for scan in scans)  # read off the file listing, nothing runs
    return df.repartition(max(cores, -(-sum(map(file_bytes, scans)) // TASK_BYTES))) if small else df


def file_bytes(scan: DataFrame) -> int:
    """Bytes of a scan's files, as its file listing has them."""
    return int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Expose driver tables as temp views so fixture SQL can name them.

    A DataFrame built from these views keeps its analysed plan, so later
    re-registration (another scale factor) does not change it.
    """
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str,
             null_value: str = "") -> DataFrame:
    """Header CSV with quoted multi-line cells (HTML cells hold newlines).

    pandas turns blank cells and the words NA/null/None into NaN; we set the
    null marker explicitly instead of guessing.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("nullValue", null_value)
        .csv(path)
    )


def _literal_path(uri: str) -> str:
    """A scan's path for a file that the metadata names: decoded, glob marks escaped."""
    return re.sub(r"([][{}*?\\])", r"\\\1", unquote(uri))


def read_csv_glob(spark: SparkSession, pattern: str, schema: T.StructType | str, null_value: str = "") -> DataFrame:
    """Many CSV batches, each bound by its own header, with the source file
    and a stable row id.

    Files are grouped by their header line and each group is read in its header's
    order, so a dropped, added or moved column shifts no value: a wanted column that
    a file lacks is NULL there, and a column not in ``schema`` is left out.
    ``row_id`` orders rows by (file path, position) like the reference's append
    loop; a file with quoted line breaks is read by one task, so positions hold.
    The driver sees one header a file, as it does the file listing of any scan.
    A file without a header line gives no rows.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("src_file"), "value",
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"))
    headers = lines.groupBy("src_file").agg(F.min_by("value", "place").alias("header")).orderBy("src_file").collect()
    files = spark.createDataFrame([(r.src_file, i) for i, r in enumerate(headers)], "src_file string, _file long")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in headers:
        names = tuple(next(csv.reader([r.header.lstrip("\ufeff")]), []))
        by_header.setdefault(names, []).append(_literal_path(r.src_file))
    out = None
    for names, paths in by_header.items():
        seen, fields = set(), []
        for i, n in enumerate(names):  # a second column of one name is not a wanted one
            fields.append(T.StructField(f"{n}.{i}" if n in seen else n, wanted[n].dataType if n in wanted.names and n not in seen else T.StringType()))
            seen.add(n)
        part = read_csv(spark, paths, T.StructType(fields), null_value).select(
            *[F.col(f"`{w.name}`") if w.name in seen else F.lit(None).cast(w.dataType).alias(w.name) for w in wanted],
            F.col("_metadata.file_path").alias("src_file"), F.monotonically_increasing_id().alias("_at"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*wanted, T.StructField("src_file", T.StringType()), T.StructField("_at", T.LongType())]))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (out.join(files, "src_file").withColumn("row_id", F.shiftleft("_file", 33) + at)
            .select(*wanted.names, "src_file", "row_id"))


def read_docs(spark: SparkSession, pattern: str, doc_col: str = "doc", shelves: bool = False) -> DataFrame:
    """One JSON, HTML or triple document per file, keyed by the number in the
    file name, or in the name of its folder if that is ``table_id=<n>`` (``write_docs``).

    Returns ``(table_id, <doc_col>)`` with the raw text; ``from_json`` with a map
    type keeps key order (a VARIANT would sort keys, so it is not used).  A file
    without a number in its name has a NULL id; the line end that closes a file is not
    part of its document.  ``shelves``: the folder is one that ``write_docs`` filled so; its
    folders need not be parsed as partitions in the driver, as the ids come from the paths.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"table_id=(\d+)/[^/]*$", 1).try_cast("long")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("long")
    return spark.read.option("recursiveFileLookup", shelves).text(pattern, wholetext=True).select(F.coalesce(folder, name).alias("table_id"), F.regexp_replace("value", r"\r?\n\z", "").alias(doc_col))


LISTED = 64  # folders that a scan lists in tasks of their own; up to 32 (Spark's default) it lists by itself


def write_docs(df: DataFrame, path: str, doc_col: str = "doc", shelves: bool = False) -> None:
    """S3-S5, the sink: one folder ``table_id=<n>`` with one text file per document.

    With ``shelves`` these folders stand in folders ``shelf=<k>``, and all of one shelf come
    from one task.  A commit then moves a shelf as a whole, where it moves each folder that
    many tasks may have written into by itself in the driver, and a scan lists a shelf in a
    task, not each folder."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # files take time, not bytes
    rows = df.where(F.col("table_id").isNotNull()).select("table_id", doc_col).repartition(tasks, "table_id")
    folders = ["shelf"] * shelves + ["table_id"]
    if shelves:
        each = -(-LISTED // tasks)
        rows = rows.withColumn("shelf", F.spark_partition_id() * each + F.pmod(F.xxhash64("table_id"), F.lit(each)))  # not the hash that dealt the rows
    mounted = _mounted(df.sparkSession, path)
    if mounted is None or not isinstance(df.schema["table_id"].dataType, T.IntegralType):
        rows.write.partitionBy(*folders).text(path)
        return
    os.makedirs(mounted)
    sent = rows.sortWithinPartitions(*folders).select(F.col(doc_col).cast("binary"), *folders)
    sent.mapInArrow(_files(mounted, folders), "table_id long").write.format("noop").mode("overwrite").save()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names if it is one of the machines' own file system (the
    shared folder is mounted there), else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _files(base: str, folders: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the documents of a task, sorted by folder, as Spark's text sink does.  Hadoop's
    client for a mounted folder starts two processes (chmod) for each file it creates, which
    take far longer than a small file does.  A file gets its name when it is whole, and any
    attempt of a task gives it the same name and content."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for keys, docs in itertools.groupby(rows, lambda r: r[1:]):
            folder = "/".join([base, *[f"{k}={v}" for k, v in zip(folders, keys)]])
            os.makedirs(folder, exist_ok=True)
            draft = f"{folder}/_{uuid.uuid4().hex}"  # a scan passes over names with this mark
            with open(draft, "wb") as out:
                for doc, *_ in docs:
                    out.write((doc or b"") + b"\n")
            os.replace(draft, f"{folder}/part-{part:05d}.txt")
        yield from ()

    return write


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Sink; one folder per split when ``partition_by`` is given.

    CSV cannot hold arrays, so array columns are written as JSON text.
    """
    if fmt == "csv":
        df = df.select(*[
            F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields
        ])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
