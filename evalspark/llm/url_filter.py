"""URL filter: host and path rules, then a ratio of character language models, in DataFrame functions only.

URLs that the rules allow or block teach two variable-order Markov models over a small alphabet, without the part that
their rule fits, which would only teach the rule. Each model blends contexts of ORDER characters and fewer by Witten-Bell
weights, so a context never seen falls back to a shorter one. The difference of log-likelihoods for each character is
held against a threshold, calibrated on labelled URLs of hosts that taught nothing.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.scratch import materialise

#: Rules by (host, path): the verdict for the host and its subdomains where the path begins so; the longest fits best.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that the models tell apart: letters, 0 for any digit, these marks, ! for all else, and begin and end.
#: 36 of them, so contexts of 3 and a character give at most 36 ** 4 = 1,679,616 rows of 40 bytes, which may be broadcast.
MARKS = "-./_%~"
N_CHARACTERS = 26 + 1 + len(MARKS) + 1 + 2
ORDER = 3
#: Bins of the calibration: hundredths of a nat for each character, held to this many either side.
BINS = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def spelled(host: Column, path: Column) -> Column:
    low = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "000000000")
    return F.regexp_replace(low, "[^a-z0" + MARKS.replace("-", r"\-") + "]", "!")


def beyond_rule(host: Column, path: Column) -> Column:
    """The spelling of a URL without what its rule fits: the end of the host and the beginning of the path."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        kept = F.substring(host, F.lit(1), F.length(host) - len(h)), F.substring(path, F.lit(len(p) + 1), F.length(path))
        out = F.when(fits, spelled(*kept)).otherwise(out)
    return out


def grams(urls: DataFrame) -> DataFrame:
    """Each character of ``s`` with the ORDER before it (``^`` before the first, ``$`` as the last)."""
    padded = F.concat(F.lit("^" * ORDER), F.col("s"), F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("s") + 1))
    return urls.withColumn("i", at).withColumn("g", F.substring(padded, F.col("i"), F.lit(ORDER + 1))).drop("i")


def log_ratio(counted: DataFrame) -> DataFrame:
    """(g, d): log P(last character | those before) by the allowed URLs less that by the blocked ones.

    ``counted`` has each gram that occurs anywhere, with its counts ``allow`` and ``block`` in what teaches. The tables
    that are joined go by at most ORDER characters, so they have at most 36 ** 3 rows.
    """
    labels = ("allow", "block")
    totals = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in labels]).first()
    rows = counted
    for j in range(ORDER + 1):
        full, context = F.substring("g", ORDER + 1 - j, j + 1), F.substring("g", ORDER + 1 - j, j)
        if j == ORDER:
            rows = rows.withColumns({f"n{j}_{x}": F.col(x) for x in labels}).withColumn("full", full)
            by_full = counted.select(full.alias("full"), *labels)
        else:
            by_full = counted.groupBy(full.alias("full")).agg(*[F.sum(x).alias(x) for x in labels])
            named = by_full.select("full", *[F.col(x).alias(f"n{j}_{x}") for x in labels])
            rows = rows.withColumn("full", full).join(F.broadcast(named), "full")
        sums = [f(x).alias(f"{c}{j}_{x}") for x in labels for c, f in (("c", F.sum), ("t", lambda x: F.count_if(F.col(x) > 0)))]
        by_context = by_full.groupBy(F.substring("full", 1, j).alias("context")).agg(*sums)
        rows = rows.withColumn("context", context).join(F.broadcast(by_context), "context").drop("full", "context")
    logs = {}
    for x in labels:
        p = (F.col(f"n0_{x}") + 1) / F.lit(float(totals[x] + N_CHARACTERS))
        for j in range(1, ORDER + 1):
            n, c, t = (F.col(f"{k}{j}_{x}") for k in "nct")
            p = F.when(c > 0, (n + t * p) / (c + t)).otherwise(p)
        logs[x] = F.log(p)
    return rows.select("g", (logs["allow"] - logs["block"]).alias("d"))


def calibrated_threshold(scored_: DataFrame) -> float:
    """The score below which URLs are blocked, with the best balanced accuracy on (label, score); 0 without both classes.

    Only a histogram of at most 2 * (2 * BINS + 1) rows comes to the driver. Of equally good thresholds the lowest is
    taken, in the middle between the scores on its two sides.
    """
    bins = F.least(F.greatest(F.floor(F.col("score") * 100), F.lit(-BINS)), F.lit(BINS)).cast("int")
    rows = scored_.groupBy("label", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {label: Counter({r.bin: r.n for r in rows if r.label == label}) for label in ("allow", "block")}
    good, bad = (sum(counts[x].values()) for x in ("allow", "block"))
    if not good or not bad:
        return 0.0
    best, at, lost, caught = 0.5, -BINS / 100.0, 0, 0
    filled = sorted({r.bin for r in rows})
    for b, above in zip(filled, [*filled[1:], filled[-1] + 1]):
        lost, caught = lost + counts["allow"][b], caught + counts["block"][b]
        if (now := (caught / bad + 1 - lost / good) / 2) > best + 1e-12:
            best, at = now, (b + 1 + above) / 200.0
    return at


def scored(urls: DataFrame, ratio: DataFrame) -> DataFrame:
    """``urls`` (s and other columns) with the mean of ``d`` over the characters of ``s`` as ``score``."""
    return grams(urls).join(F.broadcast(ratio), "g").groupBy(*urls.columns).agg(F.round(F.avg("d"), 9).alias("score"))


def url_scores(taught: DataFrame, free: DataFrame) -> tuple[DataFrame, float]:
    """Score of each distinct spelling ``s`` of ``free``, and the threshold; ``taught``: (host, s, label), distinct.

    One in four labelled hosts (by checksum) calibrates; the others teach. Without both labels among what teaches
    there is no model and every score is null.
    """
    held = F.crc32(F.col("host").cast("binary")) % 4 == 0
    known = materialise(taught.select("s", "label", held.alias("held"), "host"), "url-taught")
    labels = {r.label for r in known.where(~F.col("held")).select("label").distinct().collect()}
    if len(labels) < 2:
        return free.select("s", F.lit(None).cast("double").alias("score")), 0.0
    teaches = ~F.col("held")
    all_grams = grams(known.select("s", "label", "held")).unionByName(
        grams(free.select("s", F.lit("").alias("label"), F.lit(True).alias("held")))
    )
    counts = [F.count_if(teaches & (F.col("label") == x)).alias(x) for x in ("allow", "block")]
    ratio = materialise(log_ratio(materialise(all_grams.groupBy("g").agg(*counts), "url-grams")), "url-ratio")
    threshold = calibrated_threshold(scored(known.where("held").select("s", "label", "host"), ratio))
    return scored(free, ratio), threshold


def judge_urls(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A null url, and one without ``://``, has an empty host and path, fits no rule and is judged by the models like any
    other. ``score`` is null where a rule decides, and everywhere if the pages give no rule-labelled URLs of both kinds;
    all others are allowed then. Spellings count once, however many pages have them, so repeated rows are judged
    alike; very long URLs are scored whole; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = parsed.withColumns({"rule": rule, "label": verdict, "s": spelled(F.col("host"), F.col("path"))})
    labelled = ruled.where(F.col("label").isNotNull())
    taught = labelled.select("host", beyond_rule(F.col("host"), F.col("path")).alias("s"), "label").distinct()
    free = ruled.where(F.col("label").isNull())
    scores, threshold = url_scores(taught, materialise(free.select("s").distinct(), "url-spellings"))
    method = F.when(F.col("score") < threshold, "block").otherwise("allow").alias("verdict")
    cols = ["page_id", "host", "path", "rule"]
    by_rule = labelled.select(*cols, F.col("label").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(free.join(scores, "s", "left").select(*cols, method, "score"))
