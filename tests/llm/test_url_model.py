"""Scores and threshold of the URL models against a plain Python version."""

import math
import random
import zlib
from collections import Counter, defaultdict

from evalspark.llm import url_filter as uf

PAGES = "page_id long, url string, score double"


def _url(rng, end, lang):
    return f"http://{''.join(rng.choice('abc') for _ in range(rng.randint(1, 4)))}.{end}/{lang}/{rng.choice(['', 'x-1', 'news', 'a' * 400])}{rng.randint(0, 99)}"


def _spelled(text):
    return "".join(c if c.isascii() and (c.isalpha() or c in uf.MARKS) else "0" if c.isascii() and c.isdigit() else "!" for c in text.lower())


def _grams(s):
    padded = "^" * uf.ORDER + s + "$"
    return [padded[i : i + uf.ORDER + 1] for i in range(len(s) + 1)]


def _probabilities(texts):
    full, context, follow = Counter(), Counter(), defaultdict(set)
    for s in texts:
        for g in _grams(s):
            for j in range(uf.ORDER + 1):
                full[g[uf.ORDER - j :]] += 1
                context[j, g[uf.ORDER - j : -1]] += 1
                follow[j, g[uf.ORDER - j : -1]].add(g[-1])

    def p(g):
        out = (full[g[-1]] + 1) / (context[0, ""] + uf.N_CHARACTERS)
        for j in range(1, uf.ORDER + 1):
            at = (j, g[uf.ORDER - j : -1])
            if context[at]:
                out = (full[g[uf.ORDER - j :]] + len(follow[at]) * out) / (context[at] + len(follow[at]))
        return out

    return p


def _beyond(host, path, rule):
    h, _, p = rule.partition("/")
    return _spelled(host[: len(host) - len(h)] + path[len(p) + 1 :])


def test_scores_and_threshold_equal_brute_force(spark):
    rng = random.Random(8)
    urls = [_url(rng, *rng.choice([("example.net", "en"), ("b.net", "de"), ("example.com", "de"), ("v.org", "fr"), ("v.org", "es"), ("w.info", "en")])) for _ in range(400)]
    urls += urls[:5] + [None, "no scheme"]
    rows = uf.judge_urls(spark.createDataFrame([(i, u, 0.5) for i, u in enumerate(urls)], PAGES)).collect()
    assert len(rows) == len(urls)
    taught = {(r.host, _beyond(r.host, r.path, r.rule), r.verdict) for r in rows if r.rule}
    held = {x for x in taught if zlib.crc32(x[0].encode()) % 4 == 0}
    good, bad = (_probabilities([s for h, s, v in taught - held if v == x]) for x in ("allow", "block"))
    score = lambda s: round(sum(math.log(good(g) / bad(g)) for g in _grams(s)) / len(_grams(s)), 9)
    judged = [(score(s), v) for _, s, v in held]
    n_good, n_bad = (sum(v == x for _, v in judged) for x in ("allow", "block"))
    assert n_good and n_bad
    best, threshold = 0.5, -uf.BINS / 100
    filled = sorted({math.floor(x * 100) for x, _ in judged})
    for b, above in zip(filled, [*filled[1:], filled[-1] + 1]):
        lost, caught = (sum(v == x and math.floor(s * 100) <= b for s, v in judged) for x in ("allow", "block"))
        if (now := (caught / n_bad + 1 - lost / n_good) / 2) > best + 1e-12:
            best, threshold = now, (b + 1 + above) / 200
    for r in rows:
        if not r.rule:
            want = score(_spelled(r.host + r.path))
            assert abs(r.score - want) < 2e-9 and r.verdict == ("block" if r.score < threshold else "allow"), r


def test_without_both_labels_all_is_allowed(spark):
    rows = uf.judge_urls(spark.createDataFrame([(1, "http://a.info/", 0.0), (1, "http://a.info/", 0.0), (2, "http://b.net/", 0.0)], PAGES)).collect()
    assert sorted((r.page_id, r.verdict, r.score) for r in rows) == [(1, "allow", None), (1, "allow", None), (2, "block", None)]
