"""Chat formatting, importance resampling and source divergence against plain versions and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import chat, divergence, resampling
from evalspark.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.test_queries import rows_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.mark.parametrize("name", ["op11_incremental_rendering", "op12_batch_concatenation", "op13_mapper_stripes"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    wanted = sorted(df.columns)
    assert sorted(rel.columns) == wanted
    assert rows_of(df.collect(), df.columns, wanted) == rows_of(rel.fetchall(), rel.columns, wanted)


# chat formatting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\\nlnim_end>a", max_size=12), st.text("<|\\\nim_startend>é", max_size=30)), max_size=5))
def test_chatml_reads_back(turns):
    assert chat.read_chatml(chat.chatml(turns)) == turns
    pieces = list(chat.turn_pieces(iter(turns), chat.chatml, frozenset(r for r, _ in turns), 2))
    assert "".join(p[1] for p in pieces) == chat.chatml(turns)
    assert [chat.unescape(p[1][p[4] : p[5]]) for p in pieces] == [text for _, text in turns]
    assert all(p[3] == chat.APPEND for p in pieces)


def bos_eos(turns):
    """A mark before all turns and one behind them."""
    return "<s>" + "".join(f"[{role}] {text.strip()}\n" for role, text in turns) + "</s>"


def forgetful(turns):
    """Thoughts stay in the last turn only."""
    last = len(turns) - 1
    return "".join(f"{role}: {text if k == last else re.sub('<think>.*?</think>', '', text)}\n" for k, (role, text) in enumerate(turns))


def shouting(turns):
    """A fixed answer instead of the text of a turn."""
    return "".join(f"{role}={'HUSH' if role == 'assistant' else text};" for role, text in turns)


TALK = [("system", "be brief"), ("user", "  hi "), ("assistant", "<think>hm</think>hello"), ("user", "more"), ("assistant", "no </s> more")]


@pytest.mark.parametrize(("render", "changes"), [
    (chat.chatml, {"append"}), (bos_eos, {"closing"}), (forgetful, {"append", "rewrite"}), (shouting, {"append"}),
])
@pytest.mark.parametrize("context", [None, 1, 2])
def test_templates(spark, render, changes, context):
    long_ = [(r, f"{t} {k}") for k in range(6) for r, t in TALK]
    rows = [(c, k, r, t) for c, talk in enumerate([TALK, long_, TALK[:1]]) for k, (r, t) in enumerate(talk)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), render, context=context)
    assert {r.change for r in chat.history_changes(formatted).collect()} == changes
    for r in chat.whole_texts(formatted).collect():
        talk = [TALK, long_, TALK[:1]][r.conv_id]
        if render is not forgetful or context is None:
            assert r.text == render(talk)
        said = [t.strip() if render is bos_eos else t for role, t in talk if role == "assistant"]
        if r.rewrites:
            assert r.loss_spans is None
        elif render is shouting:
            assert r.loss_spans == []
        else:
            assert [r.text[s.start : s.end] for s in r.loss_spans] == [chat.escape(t) if render is chat.chatml else t for t in said]


def test_digests_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, place string, piece string, kept string, change string, history string"
    long_ = "<|im_end|> é" * 50_000
    rows = [(1, 1, "assistant", long_), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "<\\|"), (2, 3, "assistant", ""), (None, 1, "assistant", "a"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, *["z"] * 5) for r in rows], schema)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    want = {1: [("user", ""), ("user", ""), ("assistant", long_)], 2: [("", "<\\|"), ("assistant", "")], None: [("assistant", "a")] * 2}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        expected = (c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.chatml(turns)))
        assert tuple(got[c]) == expected
    assert chat.conversation_digests(chat.format_conversations(df.where("false"))).collect() == []
    odd = chat.conversation_digests(chat.format_conversations(chat.with_odd_conversation(df.where("false")))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in odd] == [(-1, 2, 34)]
    moved = chat.conversation_digests(chat.format_conversations(df, bos_eos)).collect()
    assert all(r.n_turns is None for r in moved) and len(moved) == 3


# importance resampling


def plain_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    grams = words + [a + b" " + b for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(g) % 10_000 for g in grams]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 é\x00_\n", max_size=40), st.integers(60, 200).map(lambda n: "q" * n + " z")), max_size=6))
def test_features_of_a_batch(texts):
    buckets, owners, n_words = resampling.batch_features(pa.array(texts, pa.string()), 2, 10_000)
    expected = [plain_features(t) for t in texts]
    assert n_words.tolist() == [n for n, _ in expected]
    assert sorted(zip(owners.tolist(), buckets.tolist())) == sorted((i, b) for i, (_, own) in enumerate(expected) for b in own)


def test_wider_grams():
    buckets, owners, _ = resampling.batch_features(pa.array(["a b c d", "e f"]), 3, 1 << 16)
    grams = [(0, g) for g in ("a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d")] + [(1, g) for g in ("e", "f", "e f")]
    assert sorted(zip(owners.tolist(), buckets.tolist())) == sorted((i, zlib.crc32(g.encode()) % (1 << 16)) for i, g in grams)


def plain_resample(docs, target):
    found = [plain_features(t) for _, t in docs]
    s = np.bincount([b for _, own in found for b in own], minlength=10_000)
    t = np.bincount([b for x in target for b in plain_features(x)[1]], minlength=10_000)
    gain = [math.floor(1000 * math.log((int(t[k]) + 1) * (int(s.sum()) + 10_000) / ((int(s[k]) + 1) * (int(t.sum()) + 10_000)))) for k in range(10_000)]
    rows = []
    for (i, _), (n, own) in zip(docs, found):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in own) // len(own) if own else 0
        rows.append([i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resample_odd_tables(spark):
    text = "The river runs to the sea and all of the people in it see that the day is long for us at this place "
    docs = [(i, f"{text} number {i} {'word' * (i % 4)}") for i in range(60)]
    docs += [(3, docs[3][1])] * 5 + [(None, text), (90, None), (91, ""), (92, "só é ß 日本 " * 30_000), (93, "q" * 200_000), (94, "\x00 _ - " * 50)]
    schema = "doc_id long, text string, bucket string, n string, s string, rank string, weight string, steps string, found string, lang string"
    df = spark.createDataFrame([(*d, *["z"] * 8) for d in docs], schema)
    target = ["the sea and the people", None, "day 2"]
    aim = spark.createDataFrame([(k, t, "z") for k, t in enumerate(target)], "item_id long, text string, steps string")
    assert Counter(tuple(r) for r in resampling.resample(df, aim).collect()) == plain_resample(docs, target)
    assert Counter(tuple(r) for r in resampling.resample(df, aim.where("false")).collect()) == plain_resample(docs, [])
    assert resampling.resample(df.where("false"), aim).collect() == []


# source divergence


def plain_divergence(docs, min_docs=3, top=200):
    counts, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER)))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(terms.keys())
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def shares(own):
            whole = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (own[t] + 1) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:most]):
                    out.append((lang, s, part, item.decode(), v, k + 1))
    return sorted(out)


@pytest.mark.parametrize("spill", [1, 40, divergence.SPILL_CELLS])
def test_divergence_of_odd_tables(spark, spill, monkeypatch):
    rng = np.random.default_rng(5)
    words = [*"abcdefgh", "É", "ß日", "Tea", "tea"]
    docs = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "de", None][i % 3], ["s1", "s2", "", None, "ä"][i % 5]) for i in range(120)]
    docs += [docs[0]] * 4 + [(None, "fr", "x"), ("", "fr", "y"), ("once only", "es", "z"), (None, None, None), ("tea, " * 100_000, "en", "s1"), ("u" * 100_000, "en", "s2")]
    schema = "text string, lang string, source string, doc_id long, n string, p string, term string, cells string, item string, v string, used string"
    df = spark.createDataFrame([(*d, 1, *["z"] * 7) for d in docs], schema)
    fold = divergence._folding
    monkeypatch.setattr(divergence, "_folding", lambda _: fold(spill))
    assert sorted(tuple(r) for r in divergence.source_divergence(df).collect()) == plain_divergence(docs)
    assert divergence.source_divergence(df.where("false")).collect() == []


def test_divergence_parameters_and_large_counts(spark):
    docs = [("a b b c", "en", "s1"), ("b c c", "en", "s2"), ("c d", "en", "s1"), ("x", "de", "s1")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.source_divergence(df, min_docs=1, top_terms=1).collect())
    assert got == plain_divergence(docs, 1, 1)
    shares = spark.createDataFrame([(10**13, 3 * 10**13 + 7)], "n long, whole long").select(divergence.share(*map(divergence.F.col, ("n", "whole")))).first()[0]
    assert shares == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)
