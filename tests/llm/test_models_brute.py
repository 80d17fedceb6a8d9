"""Fitted operators against plain versions: the compiled rule column, references and verdicts, calibrated margins."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from evalspark.llm import mixing, quality_rules, rule_ensemble
from evalspark.llm.docstats import COMMON_WORDS, document_stats

DOCS = "doc_id long, text string, lang string, source string, s double"


def _texts(seed, n):
    rng = random.Random(seed)
    langs = [*COMMON_WORDS, "xx", None]
    out = []
    for i in range(n):
        lang = rng.choices(langs, [40, 20, 3, 10, 4, 2])[0]
        common = COMMON_WORDS.get(lang, COMMON_WORDS["en"])
        word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9)))
        text = " ".join(word() for _ in range(rng.choice([3, 70, 150, 400])))
        if i % 9 == 0:
            text = " ".join("".join(rng.choice("$#|%&*<>123") for _ in range(rng.randint(2, 9))) for _ in range(120))
        out.append((i, None if i % 41 == 0 else text, lang, f"s{i % 4}", 0.5))
    return out


@pytest.fixture(scope="module")
def rows():
    return _texts(4, 260)


def test_compiled_column_equals_its_rules(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 9 > 0)) for r in rows], "doc_id long, quality int")
    intercept, rules = rule_ensemble.fit_rules(rule_ensemble.training_rows(docs, labels))
    assert len(rules) > 1 and all(len(rule) <= rule_ensemble.DEPTH for rule, _ in rules)
    stats = docs.select("doc_id", document_stats(F.col("text"), F.lit(None).cast("string")).alias("s"))
    cols = rule_ensemble.features(F.col("s"))
    found = stats.select(rule_ensemble.score_column(intercept, rules, F.col("s")).alias("score"), *[c.alias(n) for n, c in cols.items()]).collect()
    for r in found:
        fired = [w for rule, w in rules if all(r[n] <= at if below else r[n] > at for n, below, at in rule)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-(intercept + sum(fired)))), abs=1e-12)
    assert any(r.common > 0.2 for r in found)


def _distance(a, b):
    if sum(a) == 0 or sum(b) == 0:
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    half = lambda u, v: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(u, v) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def _references(docs):
    own = collections.defaultdict(list)
    for profile, s in docs:
        own[profile].append(s)
    add = lambda lists: [sum(x) for x in zip(*lists)]
    share = lambda a: [x / sum(a) if sum(a) else 0.0 for x in a]
    every_c = share(add([s["class_hist"] for _, s in docs]))
    listed = [s["word_hist"] for p, s in docs if p != "*"]
    every_w = share(add(listed)) if listed else [0.0] * 21
    out = {}
    for p, stats in own.items():
        w = len(stats) / (len(stats) + quality_rules.SHARED_DOCS)
        mix = lambda name, every: [w * x + (1 - w) * y for x, y in zip(share(add([s[name] for s in stats])), every)]  # noqa: E731, B023
        out[p] = mix("class_hist", every_c), mix("word_hist", every_w)
    return out


def _verdict(refs, profile, s):
    failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
    c = w = None
    if profile in refs and sum(s["class_hist"]) >= quality_rules.MIN_CLASS_CHARS:
        c = _distance(s["class_hist"], refs[profile][0])
    if profile in refs and profile != "*" and s["n_words"] >= quality_rules.MIN_HIST_WORDS:
        w = _distance(s["word_hist"], refs[profile][1])
    near = (c or 0) <= quality_rules.MAX_CLASS_DISTANCE and (w or 0) <= quality_rules.MAX_WORD_DISTANCE
    return failed, c, w, not failed and near


def test_references_and_verdicts_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    stats = docs.select("doc_id", "lang", document_stats(F.col("text"), F.col("lang")).alias("s")).collect()
    profiled = [(r.doc_id, r.lang if r.lang in COMMON_WORDS else "*", r.s.asDict()) for r in stats]
    passed = [(p, s) for _, p, s in profiled if not _verdict({}, p, s)[0]]
    first = _references(passed)
    refs = _references([(p, s) for p, s in passed if _verdict(first, p, s)[3]])
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    kept = 0
    for doc_id, profile, s in profiled:
        failed, c, w, keep = _verdict(refs, profile, s)
        r = got[doc_id]
        assert (r.base_failed, r.kept) == (failed, keep), doc_id
        assert (r.class_distance, r.word_distance) == (None if c is None else pytest.approx(c, abs=2e-9), None if w is None else pytest.approx(w, abs=2e-9))
        kept += keep
    assert 20 < kept < len(rows) and any(r.class_distance is not None and not r.kept and not r.base_failed for r in got.values())


def test_probabilities_meet_the_targets(spark, rows):
    targets = mixing.MixTargets(sources={"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, langs={"en": 0.6, "de": 0.3, "fr": 0.1}, topics={"prose": 1.0}, topic_words=(), fraction=0.3)
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_weights(docs, targets).collect()
    total = sum(r.n_tokens for r in got)
    for column, shares in (("source_level", targets.sources), ("lang_level", targets.langs)):
        have, want = collections.Counter(), collections.Counter()
        for r in got:
            have[r[column]] += r.n_tokens * r.probability
            want[r[column]] += r.n_tokens
        rest = sum(n for k, n in want.items() if k not in shares) / total
        for k in want:
            goal = shares[k] / sum(shares.values()) * (1 - rest) if k in shares else want[k] / total
            assert have[k] == pytest.approx(goal * total * targets.fraction, rel=1e-5), (column, k)
    by_cell = collections.defaultdict(set)
    for r in got:
        by_cell[r.source_level, r.lang_level, r.topic].add(r.probability)
        assert 0 <= r.probability <= 1
    assert all(len(p) == 1 for p in by_cell.values()) and {r.margin_gap < 1e-6 for r in got} == {True}


def test_targets_that_cannot_be_met_are_told(spark, rows):
    targets = mixing.MixTargets(sources={"s0": 0.97, "s1": 0.01, "s2": 0.01, "s3": 0.01}, fraction=0.9)
    got = mixing.mix_weights(spark.createDataFrame(rows, DOCS), targets).collect()
    assert {r.margin_gap > 0.1 for r in got} == {True} and max(r.probability for r in got) <= 1
