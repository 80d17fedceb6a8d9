"""Per-document counts shared by the quality operators: one Arrow pass over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.llm.bytesets import SPACES, flat, mixed, slices, word_hashes, word_spans

#: Fixed: the symbol characters of the base rules.
SYMBOLS = b"#*$%&|<>"
#: Classes of characters, in the order of ``class_hist``.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "accented")
_PIPE, _BANG, _REST = 7, 8, 9  # part of symbol, part of punctuation, later bytes of a character
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(SPACES)], _CLASS[list(SYMBOLS)], _CLASS[0xC0:] = 3, 4, 6
_CLASS[0x7C], _CLASS[0x21], _CLASS[0x80:0xC0] = _PIPE, _BANG, _REST

#: Fixed: frequent function words by language, the bins of ``word_hist`` (a last bin counts all other words).
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from".split(),
    "de": "der die und in den von zu das sich mit auf für des ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour par avec qui dans pas sur au".split(),
    "es": "de la que el en y los se las del un por con no una para su es al lo".split(),
}
N_COMMON = 20

STATS = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_pipes", "n_bangs", "n_common")]
    + [("class_hist", pa.list_(pa.int64())), ("word_hist", pa.list_(pa.int64()))]
)
STATS_DDL = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,"
    "n_distinct:bigint,n_pipes:bigint,n_bangs:bigint,n_common:bigint,class_hist:array<bigint>,word_hist:array<bigint>>"
)


_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def repeat_words(windows: np.ndarray) -> int:
    """Words that lie in some 3-word window which occurs twice or more; ``windows``: a hash of each in order."""
    order = np.argsort(windows)
    sorted_ = windows[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()  # a window at i covers the words i, i + 1 and i + 2
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def line_counts(raw: bytes) -> tuple[int, int]:
    """Lines that hold a word, and those of them that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _word_tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    tables = {}
    for lang, words in COMMON_WORDS.items():
        raw, offsets = flat(pa.array(words))
        starts, ends, _ = word_spans(raw, offsets)
        hashes = word_hashes(raw, starts, ends, lower=False)
        order = np.argsort(hashes)
        tables[lang] = (hashes[order], order)
    return tables


def _stats_of(texts: pa.Array, langs: pa.Array) -> pa.Array:
    parts = [_stats_of_slice(texts.slice(a, b - a), langs.slice(a, b - a)) for a, b in slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], STATS)


def _stats_of_slice(texts: pa.Array, langs: pa.Array) -> pa.Array:
    raw, offsets = flat(texts)
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=False)
    windows = mixed(hashes[:-2] * _C1 + hashes[1:-1] * _C2 + hashes[2:] * _C3) if len(hashes) > 2 else hashes[:0]
    classes, tables, rows = _CLASS[raw], _word_tables(), []
    everywhere = np.unique(np.concatenate([hashes for hashes, _ in tables.values()]))
    for i, lang in enumerate(langs.to_pylist()):
        a, b, lo, hi = first[i], first[i + 1], offsets[i], offsets[i + 1]
        n = int(b - a)
        by = np.bincount(classes[lo:hi], minlength=10).tolist()
        by_class = [*by[:4], by[4] + by[_PIPE], by[5] + by[_BANG], by[6]]
        n_lines, dup_lines = line_counts(raw[lo:hi].tobytes())
        own = np.sort(hashes[a:b])
        known, any_lang = [0] * N_COMMON, 0
        if n:
            at = np.minimum(np.searchsorted(everywhere, own), len(everywhere) - 1)
            any_lang = int((everywhere[at] == own).sum())
        if lang in tables and n:
            table, place = tables[lang]
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            known = np.bincount(place[at[table[at] == own]], minlength=N_COMMON).tolist()
        rows.append({
            "n_words": n, "word_chars": sum(by_class) - by_class[3], "n_symbols": by_class[4], "n_dup_lines": dup_lines,
            "n_repeat_words": repeat_words(windows[a : b - 2]) if n > 3 else 0, "n_lines": n_lines,
            "n_distinct": int((own[1:] != own[:-1]).sum()) + 1 if n else 0, "n_pipes": by[_PIPE], "n_bangs": by[_BANG], "n_common": any_lang,
            "class_hist": by_class, "word_hist": [*known, n - sum(known)],
        })
    return pa.array(rows, STATS)


def document_stats(text: Column, lang: Column) -> Column:
    """A struct of counts for each whole text; a null text counts as an empty one.

    ``word_hist`` counts the common words of the row's language, ``n_common`` those of any listed language.
    """
    return F.arrow_udf(_stats_of, STATS_DDL)(text, lang)
