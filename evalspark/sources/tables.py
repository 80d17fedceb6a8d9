"""Strict readers and writers: schemas are given, never inferred; what doesn't fit is an error or a row of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, schema: str, id_column: str) -> DataFrame:
    """Typed CSV with a header; a row that doesn't fit the schema, or has no id, fails the read."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    kept = F.coalesce(F.col(id_column), F.raise_error(F.lit(f"a row of the manifest has no {id_column}")).cast(dict(rows.dtypes)[id_column]))
    return rows.withColumn(id_column, kept)


def manifest_problems(rows: DataFrame, required: list[str], id_column: str) -> DataFrame:
    """(id, problem, n) of a manifest that was read leniently: missing columns, null ids, repeated ids.

    A missing column is named in the problem and has no id.
    """
    missing = [c for c in required if c not in rows.columns]
    kind = dict(rows.dtypes).get(id_column, "string")
    gone = rows.sparkSession.createDataFrame([(f"missing column {c}",) for c in missing], "problem string")
    out = gone.select(F.lit(None).cast(kind).alias("id"), "problem", F.lit(1).cast("long").alias("n"))
    if id_column not in rows.columns:
        return out
    counted = rows.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("id").isNull(), "null id").when(F.col("n") > 1, "repeated id")
    return out.unionByName(counted.select("id", problem.alias("problem"), "n").where("problem IS NOT NULL"))


def read_label_free(spark: SparkSession, path: str, columns: list[str], max_fold: int) -> DataFrame:
    """Only the named columns and folds; labels are never loaded, which the scan's schema shows."""
    return spark.read.parquet(path).select(*columns).where(F.col("fold") <= max_fold)


def read_code_dictionary(rows: DataFrame) -> DataFrame:
    """S3: (code, problem): repeated codes, and modifiers outside 200 to 499 or primaries inside."""
    wrong = F.when((F.col("kind") == "modifier") != F.col("code").between(200, 499), "category")
    repeated = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code", F.lit("repeated").alias("problem"))
    return rows.select("code", wrong.alias("problem")).where("problem IS NOT NULL").unionByName(repeated)


def read_statement_map(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Codes that are diagnostic and have one of the labels."""
    return rows.where((F.col("diagnostic") == 1) & F.col("label").isin(*labels)).select("code", "label")


def long_predictions(wide: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each record and label from rows with aligned arrays.

    Rows of a wrong length are left out here; ``prediction_problems`` returns them.
    """
    good = wide.where(_aligned(labels))
    names = F.array(*[F.lit(x) for x in labels])
    return good.select("record_id", F.inline(F.arrays_zip(names.alias("label"), F.col("targets").alias("target"), F.col("logits").alias("logit"))))


def _aligned(labels: list[str]):
    return F.coalesce((F.size("targets") == len(labels)) & (F.size("logits") == len(labels)), F.lit(False))


def prediction_problems(wide: DataFrame, labels: list[str]) -> DataFrame:
    """(record_id, problem, targets, logits) of the rows that can't be aligned with the labels: lengths, -1 of null."""
    sizes = [F.coalesce(F.size(c), F.lit(-1)).alias(c) for c in ("targets", "logits")]
    problem = F.when(F.col("targets").isNull() | F.col("logits").isNull(), "missing array").otherwise("wrong length")
    return wide.where(~_aligned(labels)).select("record_id", problem.alias("problem"), *sizes)


def read_attributes_csv(spark: SparkSession, path: str, names: dict[str, str], sep: str) -> DataFrame:
    """A site's attribute table under our column names; all values stay text."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(theirs).alias(ours) for ours, theirs in names.items()])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))


def classified_ids(every: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """Acceptable, unacceptable, indeterminate (in neither) or conflicting (in both)."""
    g, b = good.distinct().withColumn("g", F.lit(1)), bad.distinct().withColumn("b", F.lit(1))
    met = every.distinct().join(g, "id", "left").join(b, "id", "left")
    label = F.when(F.col("g").isNotNull() & F.col("b").isNotNull(), "conflicting").when(F.col("g").isNotNull(), "acceptable").when(F.col("b").isNotNull(), "unacceptable").otherwise("indeterminate")
    return met.select("id", label.alias("quality"))


def read_sha256sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, n_digests) of checksum text; more than one digest of a path is a conflict."""
    line = r"^([0-9a-fA-F]{64})[ ]+\*?(.+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line)).select(F.lower(F.regexp_extract("value", line, 1)).alias("digest"), F.regexp_replace(F.regexp_extract("value", line, 2), r"^\./", "").alias("path"))
    return rows.groupBy("path").agg(F.min("digest").alias("digest"), F.count_distinct("digest").alias("n_digests"))


EVENT_LOG = "sequence long, event_id string, action string, actor_type string, outcome string, decision string, reason_codes array<string>, previous_entry_hash string, entry_hash string"


def read_event_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines, as a table or a stream."""
    return (spark.readStream if stream else spark.read).schema(EVENT_LOG).json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Compressed Parquet; identity is ``joins.table_fingerprint``, not file bytes."""
    df.write.option("compression", "zstd").parquet(path)


def write_public_csv(df: DataFrame, path: str, columns: list[str], digits: int = 6) -> None:
    """Fixed columns, fixed decimals, empty for null."""
    types = dict(df.dtypes)
    df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if types[c] == "double" else F.col(c) for c in columns]).write.option("header", True).option("nullValue", "").csv(path)


def read_history(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """A run's best epoch and its value from JSON lines (run, epoch, metric values)."""
    rows = spark.read.schema(f"run string, epoch int, {metric} double").json(path)
    return rows.groupBy("run").agg(F.max_by("epoch", F.struct(metric, (-F.col("epoch")).alias("e"))).alias("epoch"), F.max(metric).alias(metric))


def verify_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Missing, extra and changed files; ``files`` is Spark's binaryFile source, ``expected`` has path and digest."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("path"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("found") != F.col("digest"), "changed")
    return expected.select("path", "digest").join(found, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL")
