"""The second allocation alone, without hubs before it, against all pairs."""

import numpy as np

from evalspark.llm import jaccard, shingles
from evalspark.llm.bytesets import mixed

SETS = "cid long, size long, mass double, tokens binary, sketch binary, short long, comp long"


def _components(n, links):
    label = list(range(n))
    for x, y in links:
        a, b = label[x], label[y]
        label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def _sets(spark, classes):
    rows = [
        (i, len(c), 0.1, bytearray(c.tobytes()), bytearray(shingles.sketch(c)), shingles.short_bands(c), i)
        for i, c in enumerate(classes)
    ]
    return spark.createDataFrame(rows, SETS)


def _wanted(classes):
    pairs = [(x, y, len(np.intersect1d(classes[x], classes[y]))) for x in range(len(classes)) for y in range(x)]
    return [(x, y) for x, y, both in pairs if 100 * both >= 75 * (len(classes[x]) + len(classes[y]) - both)]


def _check(spark, classes):
    classes = [np.sort(c) for c in classes]
    sets, want = _sets(spark, classes), _wanted(classes)
    left = jaccard.cheaper_allocation(jaccard.plain_allocation(sets), sets)
    got = jaccard.verified(jaccard.open_pairs(left), sets).unionByName(jaccard.family_links(left, sets))
    assert want and _components(len(classes), [(r.x, r.y) for r in got.collect()]) == _components(len(classes), want)


def _tokens(seed):
    rng = np.random.default_rng(seed)
    return lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)


def test_truncated_copies_of_crowded_classes(spark):
    """Each class of a crowd has a tail that a shorter one lacks: single tokens, none of them shared."""
    draw = _tokens(1)
    for size, tail in ((50, 16), (90, 30), (240, 80)):
        template = draw(size)
        _check(spark, [template] + [np.concatenate([template, draw(tail)]) for _ in range(40)])


def test_choice_of_a_segment_that_nobody_probed(spark):
    """The class of 100 tokens leaves its crowd's segments for ones that only outsiders and its shorter copy have."""
    draw = _tokens(2)
    template, other = draw(71), draw(9)
    short = np.concatenate([template, other])
    crowd = [np.concatenate([template, draw(29)]) for _ in range(38)]
    outsiders = [np.concatenate([other, draw(91)]) for _ in range(50)]
    _check(spark, [np.concatenate([short, draw(20)]), short, *crowd, *outsiders])


def test_classes_short_of_segments(spark, monkeypatch):
    """Tokens picked so that they fall in 20 of a band's 96 segments: no two classes have an equal segment, but some
    link; they are found by their whole band, few or crowded."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 40_000, dtype=np.uint64)
    segment = mixed(pool ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(96)
    own = [pool[segment == i] for i in range(20)]
    first = np.concatenate([x[:10] for x in own])
    other = np.concatenate([np.r_[x[1:10], x[20:21]] for x in own])
    apart = np.concatenate([x[100:110] for x in own])
    normal = [rng.integers(0, 2**63, 150, dtype=np.uint64) for _ in range(3)]
    classes = [np.sort(c) for c in (first, other, apart, *normal)]
    assert shingles.short_bands(classes[0]) and not shingles.short_bands(classes[3])
    monkeypatch.setattr(jaccard, "first_links", lambda sets: sets.select("cid", "cid").toDF("x", "y").where("x < 0"))
    for crowded in (32, 2):
        monkeypatch.setattr(jaccard, "CROWDED", crowded)
        links = [(r.x, r.y) for r in jaccard.linked_classes(_sets(spark, classes).drop("comp")).collect()]
        assert _components(6, links) == _components(6, _wanted(classes)) == [0, 0, 2, 3, 4, 5]
