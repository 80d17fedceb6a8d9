"""A corpus pipeline: quality classifier, quality rules, near duplicates, mixing and packing.

Each stage takes the documents that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.jaccard import leaders, text_hash
from evalspark.llm.mixing import sample_mix
from evalspark.llm.packing import pack
from evalspark.llm.quality_rules import keep_clean
from evalspark.llm.rule_ensemble import keep_predicted
from evalspark.plans.scratch import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble scores at 0.7 or more; it is fitted on the labels of this stage's documents.

    Null and empty texts are scored as texts without words; repeated rows and null ids are each scored alike; without
    labels of both kinds all texts get the share of label 1; an empty table stays empty.
    """
    return keep_predicted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and lies near its language's references.

    Null and empty texts have no words and go; a null or unlisted language shares one profile; repeated rows are each judged
    alike; an empty table stays empty.
    """
    return keep_clean(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of links, that with the smallest doc_id (one row of it, if rows repeat).

    Where one doc_id has several texts, each is judged as a document of its own. Documents without a doc_id are kept: they belong to no group.
    """
    first = materialise(leaders(docs).toDF("first_id", "first_text"), "leaders")
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(F.struct(*own).alias("row"), "doc_id", text_hash(F.col("text")).alias("text_hash"))
    met = hashed.join(first, (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_text")), "left_semi")
    kept = met.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()).select(*own))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target shares of sources, languages and topics.

    Null and unnamed sources and languages are one level; null and empty texts are kept with their cell's probability;
    repeated rows stay or go together; an empty table stays empty.
    """
    return sample_mix(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into batches of padded tokens.

    Null and empty texts have length 0 and are packed like others, as are repeated rows; a text longer than the budget is
    a batch of its own; an empty table gives an empty result.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("source_mix", source_mix),
    ("length_buckets", length_buckets),
]

#: SQL can express neither the fitted classifier nor the raked sample; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
