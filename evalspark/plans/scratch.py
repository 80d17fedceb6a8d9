"""Where intermediate tables go, and how plans are cut there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a plain ``local[...]`` session gets a temporary folder of its own (driver and executor are one
    process there) and any other master gets a folder under the warehouse, which all executors share.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-evalspark-")
        else:
            _LOCAL[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_evalspark"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors and fixes whatever is not stable under recomputation
    (range samples, generated ids). The files stay until ``discard`` or the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/evalspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evalspark_path = path
    return out


def materialise_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``materialise``, but as a table bucketed by ``key``: joins and groups on it read it without a shuffle."""
    spark = df.sparkSession
    named = f"evalspark_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/{named}"
    to = df.write.format("parquet").option("compression", "zstd").option("path", path)
    to.bucketBy(buckets, key).saveAsTable(named)
    out = spark.table(named)
    out._evalspark_path, out._evalspark_table = path, named
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` returned, once all that was read from them is written as well.

    Other frames, those derived from such a table included, are left alone.
    """
    for df in tables:
        if path := getattr(df, "_evalspark_path", None):
            if named := getattr(df, "_evalspark_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
