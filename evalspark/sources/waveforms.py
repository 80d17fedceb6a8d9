"""Files of waveforms as a data source: ranges of files are read in parallel, and a bad file is a row that says why."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evalspark.operators.limits import LEADS

SCHEMA = "path string, lead_idx int, lead_name string, fs double, samples array<double>, problem string"
_ARROW = pa.schema([
    ("path", pa.string()), ("lead_idx", pa.int32()), ("lead_name", pa.string()), ("fs", pa.float64()), ("samples", pa.list_(pa.float64())), ("problem", pa.string()),
])


@dataclass(frozen=True)
class Decoded:
    """What a decoder finds in a file: lead names, the samples of each lead, the rate, and units (none: not stated)."""

    names: Sequence[str]
    samples: Sequence[Sequence[float]]
    fs: float
    units: Sequence[str] = ()


@dataclass(frozen=True)
class Expected:
    """What a record has to be. Leads come back in this order under these names, whatever the file's case and order."""

    fs: float = 100.0
    n_samples: int = 1000
    leads: tuple[str, ...] = LEADS
    unit: str = "mV"
    tolerance: float = 1e-9


def record_leads(found: Decoded, want: Expected) -> tuple[list[np.ndarray], str | None]:
    """The samples of each expected lead in order, or none and the first rule that the record breaks."""
    known = {name.casefold(): name for name in want.leads}
    names = [known.get(str(name).strip().casefold()) for name in found.names]
    rows = [np.asarray(s, float) for s in found.samples]
    odd = next((str(n) for n, at in zip(found.names, names) if at is None), None)
    problem = (
        "sampling_rate" if not abs(float(found.fs) - want.fs) <= want.tolerance
        else "lead_count" if len(rows) != len(names)
        else "length" if any(r.ndim != 1 or len(r) != want.n_samples for r in rows)
        else f"unexpected_lead {odd}" if odd is not None
        else "duplicate_lead" if len(set(names)) < len(names)
        else f"missing_lead {next(n for n in want.leads if n not in names)}" if len(names) < len(want.leads)
        else "not_finite" if not all(np.isfinite(r).all() for r in rows)
        else "unit" if found.units and (len(found.units) != len(names) or any(u != want.unit for u in found.units))
        else None
    )
    return ([], problem) if problem else ([rows[names.index(n)] for n in want.leads], None)


def file_rows(path: str, content: bytes, decode: Callable[[bytes], Decoded], want: Expected) -> pa.RecordBatch:
    """A row for each lead of a file, or one row with its problem; nothing that a decoder raises ends the read."""
    try:
        leads, problem = record_leads(decode(content), want)
    except Exception as error:  # a decoder may raise anything on a broken file
        leads, problem = [], f"undecodable {type(error).__name__}"
    if problem:
        return pa.RecordBatch.from_pylist([{"path": path, "problem": problem}], schema=_ARROW)
    n = len(leads)
    samples = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * want.n_samples, pa.int32()), pa.array(np.concatenate(leads)))
    columns = [pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array(want.leads), pa.array([want.fs] * n, pa.float64()), samples, pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


@dataclass
class FileRange(InputPartition):
    """Files that one task reads, one after the other."""

    paths: list[str] = field(default_factory=list)


class WaveformReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, per_partition: int, decode: Callable[[bytes], Decoded], want: Expected) -> None:
        self.root, self.suffix, self.per_partition, self.decode, self.want = root, suffix, per_partition, decode, want

    def partitions(self) -> list[FileRange]:
        """Ranges of the names in order, so that a file is in the same range whenever the folder is the same."""
        where, base = fs.FileSystem.from_uri(self.root)
        infos = where.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(i.path for i in infos if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith(("_", ".")))
        ranges = [FileRange(names[a : a + self.per_partition]) for a in range(0, len(names), self.per_partition)]
        return ranges or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            try:
                with where.open_input_stream(path) as file:
                    content = file.read()
            except OSError as error:
                yield pa.RecordBatch.from_pylist([{"path": path, "problem": f"unreadable {type(error).__name__}"}], schema=_ARROW)
                continue
            yield file_rows(path, content, self.decode, self.want)


def waveform_source(decode: Callable[[bytes], Decoded], want: Expected = Expected()) -> type[DataSource]:
    """A data source class for files of one kind; its name tells decoder and contract apart in a session."""

    class WaveformSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"waveforms_{zlib.crc32(repr((decode.__module__, decode.__qualname__, want)).encode()):08x}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> WaveformReader:
            return WaveformReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("filesPerPartition", "256")), decode, want)

    return WaveformSource


def read_waveform_files(
    spark: SparkSession, path: str, decode: Callable[[bytes], Decoded], want: Expected = Expected(), suffix: str = "", files_per_partition: int = 256
) -> DataFrame:
    """Path, lead_idx, lead_name, fs, samples and problem of the files under ``path`` that end with ``suffix``.

    A good file gives a row for each lead of ``want``, in its order; its problem is null. A file that can't be read or
    decoded, or breaks ``want``, gives one row with its problem. An empty folder gives no rows. ``path`` is a URI that
    pyarrow.fs opens (file, s3, gs, hdfs) from driver and executors; stores that only Spark reads are for
    ``waveforms_of``. The driver lists names only.
    """
    source = waveform_source(decode, want)
    spark.dataSource.register(source)
    root = path if "://" in path else f"file://{path}" if path.startswith("/") else f"file:///{path.removeprefix('file:').lstrip('/')}"
    return spark.read.format(source.name()).option("suffix", suffix).option("filesPerPartition", str(files_per_partition)).load(root)


def waveforms_of(files: DataFrame, decode: Callable[[bytes], Decoded], want: Expected = Expected()) -> DataFrame:
    """The same rows from Spark's binaryFile source (path, content), for stores that only Spark's readers open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield file_rows(path.as_py(), content.as_buffer().to_pybytes(), decode, want)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
