"""A table with its summary and checksums, made in the pass that writes it and visible only if every task succeeds."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SUMMARY, SUMS = "_summary.json", "_SHA256SUMS"
_HASH = "__row_hash"


def row_hash(columns: list[str]) -> Column:
    """The first 12 hexadecimal digits of a row's SHA-256 as a number; the same as in ``joins.table_fingerprint``."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its file (none for a task without rows), and what adds up to the summary."""

    file: str | None
    bytes: int
    digest: str
    rows: int
    fingerprint: int
    nulls: dict[str, int]


class TableWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder; the commit moves their files and writes the checksums, and the summary last."""

    def __init__(self, root: str, schema: StructType, overwrite: bool) -> None:
        self.root, self.overwrite = root, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        self.columns = [f.name for f in schema if f.name != _HASH]

    def _where(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = self._where()
        where.create_dir(f"{base}/{self.staging}")
        name = f"part-{uuid.uuid4().hex}.parquet"
        rows, total, nulls, writer = 0, 0, dict.fromkeys(self.columns, 0), None
        path = f"{base}/{self.staging}/{name}"
        for batch in iterator:
            if not batch.num_rows:
                continue
            own = batch.select(self.columns)
            writer = writer or pq.ParquetWriter(path, own.schema, filesystem=where, compression="zstd")
            writer.write_batch(own)
            rows += batch.num_rows
            total += sum(pc.fill_null(batch.column(_HASH), 0).to_pylist())
            for c in self.columns:
                nulls[c] += own.column(c).null_count
        if writer is None:
            return Written(None, 0, "", 0, 0, nulls)
        writer.close()
        digest, size = hashlib.sha256(), 0
        with where.open_input_stream(path) as file:
            while piece := file.read(1 << 20):
                digest.update(piece)
                size += len(piece)
        return Written(name, size, digest.hexdigest(), rows, total, nulls)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = self._where()
        done = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        if self.overwrite:
            stale = [i for i in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name != self.staging]
            # the summary goes first: without it no file of the old table counts
            for info in sorted(stale, key=lambda i: i.base_name != SUMMARY):
                where.delete_dir(info.path) if info.type == fs.FileType.Directory else where.delete_file(info.path)
        elif where.get_file_info(f"{base}/{SUMMARY}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.root} holds a published table")
        where.create_dir(base)
        for m in done:
            where.move(f"{base}/{self.staging}/{m.file}", f"{base}/{m.file}")
        summary = {
            "columns": self.columns, "rows": sum(m.rows for m in done), "fingerprint": str(sum(m.fingerprint for m in done)),
            "nulls": {c: sum(m.nulls[c] for m in done) for c in self.columns}, "files": [{"name": m.file, "bytes": m.bytes, "rows": m.rows, "sha256": m.digest} for m in done],
        }
        for name, text in ((SUMS, "".join(f"{m.digest}  {m.file}\n" for m in done)), (SUMMARY, json.dumps(summary, indent=2, sort_keys=True) + "\n")):
            with where.open_output_stream(f"{base}/{name}") as file:
                file.write(text.encode())
        self._clean(where, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._where())

    def _clean(self, where: fs.FileSystem, base: str) -> None:
        if where.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.staging}")


class PublishedTable(DataSource):
    """A sink only; the files are plain Parquet."""

    @classmethod
    def name(cls) -> str:
        return "published_table"

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options["path"], schema, overwrite)


def _uri(path: str) -> str:
    return path if "://" in path else f"file:///{path.removeprefix('file:').lstrip('/')}"


def publish_table(df: DataFrame, path: str, overwrite: bool = False) -> dict:
    """Write ``df`` as compressed Parquet with its summary and checksums; returns the summary.

    Rows, fingerprint and nulls are summed by the tasks that write, so the table is computed once; the fingerprint is
    that of ``joins.table_fingerprint`` over all columns. If a task fails for good the staging folder goes and nothing
    else has changed. Attempts that don't win leave no trace in the sums, since only winners' messages are committed.
    ``path`` is a URI that pyarrow.fs opens from driver and executors. Without ``overwrite`` a published table there is
    an error.
    """
    spark = df.sparkSession
    spark.dataSource.register(PublishedTable)
    hashed = df.withColumn(_HASH, row_hash(df.columns))
    hashed.write.format("published_table").mode("overwrite" if overwrite else "append").save(_uri(path))
    return read_summary(path)


def read_summary(path: str) -> dict:
    where, base = fs.FileSystem.from_uri(_uri(path))
    with where.open_input_stream(f"{base}/{SUMMARY}") as file:
        return json.loads(file.read())


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that the summary names, and of no others."""
    summary = read_summary(path)
    names = [f"{_uri(path).rstrip('/')}/{f['name']}" for f in summary["files"]]
    return spark.read.parquet(*names) if names else spark.createDataFrame([], StructType()).select(*[F.lit(None).alias(c) for c in summary["columns"]])


def published_faults(spark: SparkSession, path: str) -> DataFrame:
    """name, fault (missing, extra, changed) of files against the checksums of the summary; none for a whole table."""
    summary = read_summary(path)
    expected = spark.createDataFrame([(f["name"], f["sha256"]) for f in summary["files"]], "name string, sha256 string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(_uri(path))
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("found") != F.col("sha256"), "changed")
    return expected.join(found, "name", "full_outer").select("name", fault.alias("fault")).where("fault IS NOT NULL")
