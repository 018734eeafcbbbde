"""Links, components and kept rows of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.llm import vector_copies

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(seed=5, width=32):
    """Groups of near and equal vectors from loose to tight, and single ones, under three labels."""
    rng = np.random.default_rng(seed)
    rows, number = [], iter(rng.permutation(5_000).tolist())
    for label in range(3):
        for noise in (0.02, 0.1, 0.25, 0.35, 0.4):
            centre = rng.standard_normal(width)
            for _ in range(25):
                v = centre + noise * rng.standard_normal(width)
                rows.append((next(number), v.tolist(), label))
                if rng.random() < 0.2:
                    rows.append((next(number), v.tolist(), label))
        rows += [(next(number), rng.standard_normal(width).tolist(), label) for _ in range(120)]
    return rows


ODD = [
    (6000, None, 1), (6001, [], 1), (6002, [0.0] * 32, 1), (6003, [1.0] * 31 + [None], 1), (6004, [1.0] * 31 + [float("nan")], 1),
    (6005, [1.0] * 31 + [float("inf")], 1), (6006, [1.0] * 32, None), (6007, [1.0] * 32, None), (6008, [1.0] * 31, 1), (6009, [1.0] * 32, 1),
    (6010, [2.0] * 32, 1), (6011, [3e38] * 32, 1), (6012, [1e-38] * 32, 2), (None, [1.0] * 32, 1), (None, [-1.0] * 32, 1), (6013, [-1.0] * 32, 2),
    (6014, [5.0] + [0.0] * 31, 2), (6014, [5.0] + [0.0] * 31, 2), (6014, [5.0] + [0.1] * 31, 2),
]


def brute(rows, threshold):
    fine = [v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) and label is not None for _, v, label in rows]
    unit = [np.float32(v).astype(float) / np.abs(np.float32(v)).max().astype(float) if ok else None for (_, v, _), ok in zip(rows, fine)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i + 1, n):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                link[i, j] = link[j, i] = unit[i] @ unit[j] >= threshold
    label = np.arange(n)
    for _ in range(n):
        after = np.array([min(label[i], label[link[i]].min(initial=n)) for i in range(n)])
        if (after == label).all():
            break
        label = after
    least = {k: min((r[0] for r, at in zip(rows, label) if at == k and r[0] is not None), default=None) for k in set(label.tolist())}
    return sorted(((r[0], int(link[i].sum()), least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile, strip", [(2_048, 256), (16, 5)])
def test_same_as_brute_force(spark, monkeypatch, tile, strip):
    monkeypatch.setattr(vector_copies, "TILE_ROWS", tile)
    monkeypatch.setattr(vector_copies, "STRIP", strip)
    rows = planted() + ODD
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in ("u", "node", "copies", "v", "n", "least", "at", "signs")})
    got = sorted(map(tuple, vector_copies.near_copies(frame).collect()), key=str)
    assert got == brute(rows, 0.93)
    assert sum(r[1] > 0 for r in got) > 150


def test_many_copies_and_doubles(spark):
    rows = [(k, [float(k % 2), 1.0, 0.5], 1) for k in range(3_000)]
    found = vector_copies.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.9999)
    counts = found.groupBy("component_id", "n_links").count().collect()
    assert sorted(map(tuple, counts)) == [(0, 1_499, 1_500), (1, 1_499, 1_500)]


def test_empty_and_unusable(spark):
    assert vector_copies.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in vector_copies.near_copies(spark.createDataFrame(ODD[:1], SCHEMA)).collect()] == [(6000, 0, 6000, True)]
    with pytest.raises(ValueError):
        vector_copies.near_copies(spark.createDataFrame([], SCHEMA), threshold=0.0)


def test_tables_reach_the_recall():
    for signs in (4, 12, 28):
        tables = vector_copies.tables_for(0.93, signs, 0.9999)
        agree = (1 - np.arccos(0.93) / np.pi) ** signs
        assert 1 - (1 - agree) ** tables >= 0.9999 > 1 - (1 - agree) ** (tables - 1)
