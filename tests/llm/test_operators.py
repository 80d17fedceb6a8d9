"""Each operator against brute force on small hand-made tables, and on its edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import archive, jaccard, licences, mixing, numbering, packing, quality_rules, rule_ensemble, sharding, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [words(rng, rng.randint(1, 300)) for _ in range(60)]
    for i in range(0, 40, 2):  # near copies with one to eight words changed
        w = out[i].split()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
        out.append(" ".join(w))
    base = words(rng, 150).split()
    for _ in range(60):  # a crowded group around one text, of which not all link
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "y" + str(rng.randrange(999))
        out.append(" ".join(w))
    out += [out[3], out[3], out[4].upper(), "", None, "   \n\t ", "one two", "One  TWO", words(rng, 30_000), "* " * 50, "a\x0bb\x0cc d e f", "é ü " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns whose names the operators might use themselves."""
    names = ["n_tokens", "s", "score", "c_source", "__stats", "__verdict", "__p", "h", "k", "t", "cid", "lo", "size", "shard", "key", "bucket", "row", "payload", "label"]
    return docs.withColumns({n: F.lit(1) for n in names})


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("crowded", [32, 3])
def test_near_duplicates_equal_brute_force(spark, docs, texts, clashing, monkeypatch, crowded):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    sets = [shingles(t) for t in texts]
    want = brute_components(sets)
    got = jaccard.near_duplicates(docs if crowded == 32 else clashing).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r


def test_near_duplicates_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    same = "a b c d e f g h"
    df = spark.createDataFrame([(None, same), (7, same), (5, same), (5, "quite other words stand here now"), (9, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == collections.Counter([(None, 4, None), (7, 4, 5), (5, 4, 5), (5, 2, 5), (9, 0, 9)])


def test_block_links_equal_set_arithmetic(texts):
    import pyarrow as pa

    from evalspark.llm.bytesets import shingle_sets

    tokens, ends = shingle_sets(pa.array(texts[80:140]))
    blobs = [tokens[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    t = pa.table({"cid": list(range(60)), "size": np.diff(ends), "comp": list(range(60)), "tokens": blobs})
    got = {tuple(sorted(p)) for p in zip(*(c.to_pylist() for c in jaccard._block_links(t, t).columns))}
    sets = [shingles(x) for x in texts[80:140]]
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert got == want


def test_shards(spark, docs, texts, clashing):
    for df, n in ((docs, 7), (clashing, 40)):
        rows = sharding.shard_documents(df, n).collect()
        assert len(rows) == len(texts) + 1
        sizes, slots = collections.Counter(), collections.defaultdict(list)
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(sizes) <= set(range(n))
        largest, mean = max(r.size for r in rows), sum(sizes.values()) / n
        assert max(sizes.values()) <= mean + largest + 0.02 * mean


def test_groups_stay_whole(spark):
    """Equal texts lie in one shard, wherever their edge falls, unless they are more than a whole shard."""
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(600)} " * rng.choice([1, 3])) for i in range(4000)] + [(5000 + i, "hot " * 40) for i in range(900)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    text = dict(rows)
    shards, sizes = collections.defaultdict(set), collections.Counter()
    for r in placed:
        shards[text[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    assert [t for t, s in shards.items() if len(s) > 1] == ["hot " * 40]
    mean = sum(sizes.values()) / 8
    assert all(abs(x - mean) <= 0.06 * mean for x in sizes.values())


@pytest.mark.parametrize("share", [0.2, 0.6, 0.95, 1.3])
def test_large_groups(spark, share):
    """Groups up to a whole shard stay whole; the balance tells by how much shards miss their share for it."""
    n, rng = 8, random.Random(int(share * 100))
    rows = [(i, f"text {i} " * 3) for i in range(3000)]
    rest = sum(len(t) + 16 for _, t in rows)
    for g in range(3):
        text = f"group {g} " * 5
        copies = int(share * (rest / n) / (1 - 3 * share / n) / (len(text) + 16))
        rows += [(10_000 * (g + 1) + i, text) for i in range(copies)]
    rng.shuffle(rows)
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n)
    text, shards = dict(rows), collections.defaultdict(set)
    for r in placed.collect():
        shards[text[r.doc_id]].add(r.shard)
    cut = [t for t, s in shards.items() if len(s) > 1]
    assert len(cut) == (3 if share > 1 else 0)
    balance = sharding.shard_balance(placed, n).collect()
    assert len(balance) == n and sum(r.rows for r in balance) == len(rows)
    assert abs(sum(r.deviation for r in balance)) < 1e-9
    assert max(abs(r.deviation) for r in balance) <= (0.02 if share > 1 else share + 0.02)


def test_numbers_in_salts(spark, monkeypatch):
    """Pieces of many rows, dealt to salts, still give gapless numbers in the order of pieces."""
    monkeypatch.setattr(numbering, "ROWS_PER_SALT", 10)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 30 > 3).cast("int").alias("p"), "id")
    for group, rows in df.groupBy("g").count().collect():
        got = numbering.number_within(df, "g", F.col("p"), [F.col("id")], "n").where(F.col("g") == group).orderBy("n").collect()
        assert [r.n for r in got] == list(range(rows)) and [r.p for r in got] == sorted(r.p for r in got)


def test_shards_of_one_hot_row_and_of_nothing(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    counts = collections.Counter(r.shard for r in sharding.shard_documents(df, 4).collect())
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 20


def test_rake_meets_margins_and_bounds():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    margins = [np.array(m) for m in ([0.3, 0.3, 0.2, 0.2], [0.4, 0.3, 0.3], [0.5, 0.5])]
    w = mixing.rake(tokens, margins, 0.2)
    assert (w <= tokens + 1e-9).all()
    for axis, m in enumerate(margins):
        assert np.allclose(w.sum(axis=tuple(i for i in range(3) if i != axis)) / w.sum(), m, atol=1e-6)


def test_mix_edges(spark, docs, texts, clashing):
    rows = mixing.mix_weights(clashing).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.probability <= 1
    assert {r.lang_level for r in rows} == {"en", "de", "*"}
    kept = mixing.sample_mix(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_weights(empty).collect() == [] and mixing.sample_mix(empty).collect() == []


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (600, 8))
    v[200:400] = v[200]  # a third of all vectors are the same
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(7, [float(x) for x in v[7]]), (601, None), (650, [float("nan")] * 8), (None, [0.1] * 8), (700, [0.5, 0.5]), (750, [1.0, 0.25])]
    got = collections.defaultdict(list)
    for r in topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(e)).astype(int)) for i, e in rows if i is not None and e is not None and np.isfinite(e).all()]
    for q in {i for i, _ in good if i % 50 == 0}:
        own = next(e for i, e in good if i == q)
        want = sorted(((-int(own @ e), i) for i, e in good if i != q and len(e) == len(own)))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)], q
    assert topk.search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


@pytest.mark.parametrize("scale", [3, 40, 10**6, 2**29])
def test_topk_over_several_shards(spark, monkeypatch, scale):
    """Ties between shards, trees of many leaves, and numbers of which products aren't exact as floats."""
    monkeypatch.setattr(topk, "SHARD_BYTES", 8 * 4 * 700)
    rng = np.random.default_rng(scale % 97)
    vectors = rng.integers(-scale, scale, (3000, 4)) // (scale // 3) * (scale // 3) if scale > 3 else rng.integers(-3, 3, (3000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vec array<long>")
    found = topk.top_k(df, F.col("vec_id") % 300 == 0, 5).collect()
    got = collections.defaultdict(list)
    for r in found:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    exact = vectors.astype(object)
    for q in range(0, 3000, 300):
        scores = exact @ exact[q]
        want = sorted((-x, i) for i, x in enumerate(scores) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(want)]


def test_boundaries_are_optimal():
    """Every choice of bucket ends is tried, for lengths far apart as well."""
    from itertools import combinations

    rng = random.Random(2)
    for most, n_buckets in ((60, 3), (60, 12), (10**6, 4), (5000, 2)):
        lengths = sorted(rng.sample(range(most), 9))
        counts = [rng.randint(1, 9) for _ in lengths]

        def padding(cuts):
            pad, at = 0, 0
            for c in cuts:
                pad += sum(counts[i] * (lengths[c] - lengths[i]) for i in range(at, c + 1))
                at = c + 1
            return pad

        got = packing.boundaries(lengths, counts, n_buckets)
        assert len(got) == min(n_buckets, 9) and got[-1] == 8
        assert padding(got) == min(padding([*c, 8]) for c in combinations(range(8), min(n_buckets, 9) - 1))
    assert packing.boundaries([], [], 4) == []


def test_pack(spark, docs, texts, clashing):
    rows = packing.pack(clashing, 4, 700).collect()
    assert len(rows) == len(texts) + 1
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches[r.batch].append(r)
    for b in batches.values():
        assert sorted(x.batch_slot for x in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_length <= 700
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, texts, clashing):
    extra = ["a b c a b c", "x\nx\n x\n\n\nx", "a b c d a b c", "q " * 60]
    more = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(extra)]
    df = clashing.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, DOCS))
    every = dict(enumerate(texts)) | {r[0]: r[1] for r in more}
    for r in quality_rules.quality_rules(df).collect():
        want = brute_counts(every[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_js_distance(spark):
    p, q = np.array([3, 1, 0, 6]) / 10, np.array([1, 1, 2, 4]) / 8
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, [3, 1, 0, 6])), F.array(*map(F.lit, [1, 1, 2, 4]))).alias("d")).first().d
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_rejections_of_the_rules(spark, clashing):
    rng = random.Random(9)
    common = "the of and to a in is that it for".split()
    clean = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else words(rng, 1) for _ in range(150)), "en", "s", 0) for i in range(40)]
    junk = [(100, " ".join(f"{words(rng, 1)}$$$%%%" for _ in range(150)), "en", "s", 0), (101, words(rng, 150), "en", "s", 0)]
    kept = {r.doc_id for r in quality_rules.keep_clean(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert kept == set(range(40))
    assert quality_rules.keep_clean(spark.createDataFrame([], DOCS)).collect() == []
    assert quality_rules.keep_clean(clashing).columns == clashing.columns


def test_classifier(spark, clashing):
    rng = random.Random(4)
    rows = [(i, words(rng, 80) if i % 2 else " ".join(w + "###" for w in words(rng, 80).split()), "en", "s", 0) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in got if r.held_out) and any(r.held_out for r in got)
    assert rule_ensemble.keep_predicted(clashing, labels).columns == clashing.columns
    none = labels.limit(0)
    assert {r.score for r in rule_ensemble.quality_scores(docs, none).collect()} == {0.5}
    assert rule_ensemble.quality_scores(docs.limit(0), labels).collect() == []


PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a/\r\nx", big), (2, None, big), (9, "http://b", big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (2, None, big), (None, "u", big)]
    a = archive.write_archive(spark.createDataFrame(rows, PAGES))
    assert a.payloads.count() == 3
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in archive.read_records(a).collect())
    want = collections.Counter([(5, "revisit", 2, big), (2, "response", None, big), (9, "revisit", 2, big), (1, "response", None, "short"), (3, "response", None, "short"), (4, "response", None, ""), (6, "response", None, ""), (2, "response", None, big), (None, "response", None, big)])
    assert got == want
    for r in archive.read_records(a).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n" and rest[:n] == (bytes(r.payload) if r.record_type == "response" else b"")
    assert archive.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_headers_are_exact(spark):
    """URLs with line breaks and percent signs come back as they were; every record has an id of its own and a date."""
    urls = ["http://a/x%20y", "http://a/x\r\ny%0D", "", None, "http://a/x%20y"]
    rows = [(None if i == 3 else min(i, 3), u, "p" * 120, "other") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    a = archive.write_archive(pages, date="2026-01-02T03:04:05Z")
    got = archive.read_records(a).collect()
    assert collections.Counter((r.page_id, r.url) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    ids = {r.record_id: r for r in got}
    assert len(ids) == 5 and {r.date for r in got} == {"2026-01-02T03:04:05Z"}
    for r in got:
        assert bytes(r.header).count(b"\r\n") == len(bytes(r.header).decode().split("\r\n")) - 1
        if r.record_type == "revisit":
            assert ids[r.refers_to_record].page_id == r.refers_to == 0
    assert collections.Counter(r.record_type for r in got) == {"response": 2, "revisit": 3}


def test_licences(spark):
    rows = [
        (1, "Words.\nReleased under the MIT License.\nMore words."), (2, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (3, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"), (4, None), (5, ""), (6, "a licence to thrill"), (6, "a licence to thrill"),
    ]
    got = {r.doc_id: (r.licence, r.n_known) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("GPL-3.0-or-later", 1), 3: ("Apache-2.0", 3), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
    for texts in licences.SENTENCES.values():
        assert all(any(a in t for a in licences.ANCHORS) or t.startswith(("you may not", "unless")) for t in texts)


def test_url_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://x.net": ("x.net", "", None, None), "https://x.net/": ("x.net", "/", "net/", "block"), "ftp://evil.example.com/de/": ("evil.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "http://w.org/fr/1#t": ("w.org", "/fr/1", "org/fr/", "allow"), "nothing": ("", "", None, None), None: ("", "", None, None), "a://b?c/en/": ("b", "", None, None),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).collect():
        host, path, rule, verdict = urls[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_url_models_learn(spark):
    rng = random.Random(6)
    rows = [(i, f"http://{words(rng, 1)}.example.net/en/{i}", "") for i in range(300)] + [(1000 + i, f"http://{words(rng, 1)}.net/xq/{i}", "") for i in range(300)]
    rows += [(5000, "http://abc.example.info/en/12", ""), (5001, "http://abc.inet/xq/12", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[5000], got[5001]) == ("allow", "block") and len(got) == len(rows)
