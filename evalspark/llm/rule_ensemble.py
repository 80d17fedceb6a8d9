"""Quality classifier: a sparse rule ensemble.

Paths of shallow trees become conjunctive rules over document statistics; a logistic model with a lasso penalty
weighs them; the rules with weight become one Spark column expression, which scores the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.docstats import document_stats
from evalspark.plans.scratch import materialise

#: Documented bound of the sample of labelled rows that the model is fitted on.
MAX_TRAIN_ROWS = 20_000
N_TREES, DEPTH, SEED = 12, 3, 7
#: Strengths of the lasso penalty that are tried. A quarter of the training rows, by checksum, judges them by log loss.
LASSO = (0.0003, 0.001, 0.003)
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels are never learned from: crc32 of the id's text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judging(doc_id: Column) -> Column:
    """True for the training rows that judge penalties."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 1


def features(s: Column) -> dict[str, Column]:
    """Statistics of a text that the rules speak about; 0 where the text has nothing to divide by."""
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    letters = s["class_hist"][0] + s["class_hist"][1]
    return {
        "log_words": F.log1p(s["n_words"].cast("double")),
        "mean_word": ratio(s["word_chars"], s["n_words"]),
        "symbols": ratio(s["n_symbols"], s["word_chars"]),
        "upper": ratio(s["class_hist"][1], letters),
        "digits": ratio(s["class_hist"][2], s["word_chars"]),
        "punctuation": ratio(s["class_hist"][5], s["word_chars"]),
        "repeats": ratio(s["n_repeat_words"], s["n_words"]),
        "dup_lines": ratio(s["n_dup_lines"], s["n_lines"]),
        "line_words": ratio(s["n_words"], s["n_lines"]),
        "distinct": ratio(s["n_distinct"], s["n_words"]),
        "pipes": ratio(s["n_pipes"], s["n_words"]),
        "bangs": ratio(s["n_bangs"], s["n_words"]),
        "common": ratio(s["n_common"], s["n_words"]),
    }


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and label of at most MAX_TRAIN_ROWS labelled documents, the first in the order of a hash of the id.

    Labels of held-out documents, null ids and null labels are left out; a document labelled twice counts as 1 only if
    all its labels are 1. The sample is broadcast: its size is bounded.
    """
    use = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").select("doc_id", F.col("label").cast("double").alias("label"), document_stats(F.col("text"), F.lit(None).cast("string")).alias("s"))
    cols = features(F.col("s"))
    rows = picked.select("doc_id", "label", *[c.alias(n) for n, c in cols.items()])
    # one partition of a bounded sample, in a fixed order, so that the same rows always give the same trees
    return materialise(materialise(rows, "rule-sample").repartition(1).sortWithinPartitions("doc_id", "label", *cols), "rule-train")


def tree_rules(forest, names: list[str]) -> list[tuple[tuple[str, bool, float], ...]]:
    """Each path from a root to a node below it, as a conjunction of (feature, is <=, threshold); repeats once."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found[tuple(sorted(set(path)))] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, at = names[split.featureIndex()], round(float(split.threshold()), 6)
            walk(node.leftChild(), (*path, (name, True, at)))
            walk(node.rightChild(), (*path, (name, False, at)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


def rule_column(rule: tuple[tuple[str, bool, float], ...], cols: dict[str, Column]) -> Column:
    """The rule as a condition on columns."""
    return reduce(lambda a, b: a & b, [cols[n] <= at if below else cols[n] > at for n, below, at in rule])


def fit_rules(train: DataFrame) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and the rules that the lasso keeps, with weights.

    With one class only (or no rows) there are no rules and the score is the smoothed share of label 1.
    """
    names = [c for c in train.columns if c not in ("doc_id", "label")]
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        share = (ones + 1) / (n + 2)
        return float(_logit(share)), []
    train = VectorAssembler(inputCols=names, outputCol="x").transform(train).persist()
    try:
        forest = RandomForestClassifier(featuresCol="x", numTrees=N_TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(train)
        rules = tree_rules(forest, names)
        if not rules:
            return float(_logit(ones / n)), []
        own = {c: F.col(c) for c in names}
        hits = train.select("label", judging(F.col("doc_id")).alias("judge"), *[rule_column(r, own).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(hits).select("label", "x", "judge").persist()
        model = _lasso(chosen_penalty(hits)).fit(hits)
        hits.unpersist()
    finally:
        train.unpersist()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6]


def _lasso(penalty: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)


def chosen_penalty(hits: DataFrame) -> float:
    """The strength with the least log loss on the judging rows (``judge``) after fitting on the others.

    The strongest one where either part has one label only.
    """
    parts = hits.groupBy("judge").agg(F.countDistinct("label").alias("n")).collect()
    if sorted((r.judge, r.n) for r in parts) != [(False, 2), (True, 2)]:
        return max(LASSO)
    losses = []
    for penalty in LASSO:
        scored = _lasso(penalty).fit(hits.where(~F.col("judge"))).transform(hits.where("judge"))
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-9)), F.lit(1 - 1e-9))
        loss = F.avg(F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p)))
        losses.append((scored.agg(F.round(loss, 9)).first()[0], -penalty))
    return -min(losses)[1]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def score_column(intercept: float, rules: list[tuple[tuple, float]], s: Column) -> Column:
    """The whole model as one expression over the statistics ``s``."""
    cols = features(s)
    total = reduce(lambda a, b: a + b, [F.when(rule_column(r, cols), F.lit(w)).otherwise(0.0) for r, w in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, with its ``score``; labels, lang, source and doc_id are no inputs."""
    small_batches(docs.sparkSession)
    intercept, rules = fit_rules(training_rows(docs, labels))
    counted = docs.select(F.struct("*").alias("doc"), document_stats(F.col("text"), F.lit(None).cast("string")).alias("s"))
    return counted.select("doc", score_column(intercept, rules, F.col("s")).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from 0.7 on).

    Null and empty texts are scored as texts without words; equal texts get equal scores; a null doc_id is scored and
    not held out; an empty table gives an empty result; other columns are ignored.
    """
    doc_id = F.col("doc.doc_id")
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least 0.7, with their own columns, whatever those are called.

    Null and empty texts are scored as texts without words; repeated rows and null ids are each scored alike; without
    labels of both kinds all texts get the share of label 1; an empty table gives an empty result.
    """
    return score_documents(docs, labels).where(F.col("score") >= THRESHOLD).select("doc.*")
