"""Whitening against whole-table linear algebra and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tenderloom.llm import queries, whitening


def plain(rows, weigh="one", components=4):
    """{(row number, component): (n, deviation, |whitened|, explained)} of the rows that count."""
    good = [(k, v) for k, (_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = {k: tuple(math.floor(256 * float(np.float32(c))) for c in v) for k, v in good}
    fit = sorted(set(xs.values())) if weigh == "one" else list(xs.values())
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    matrix = np.array(fit, float) - np.array(sums) / n
    values, units = np.linalg.eigh(matrix.T @ matrix / n)
    found = {}
    for k, x in xs.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(min(components, d)):
            e, unit = values[-1 - c], units[:, -1 - c]
            shown = float((np.array(x) - np.array(sums) / n) @ unit / math.sqrt(e))
            found[k, c + 1] = (n, deviation, shown, e / values.sum())
    return found


def whitened(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'x' AS whitened", "3 AS row_id")
    return whitening.whiten(frame, **options)


@pytest.mark.parametrize("weigh", ["one", "copies"])
def test_random_vectors_with_copies(spark, weigh):
    draw = np.random.default_rng(7)
    base = (draw.normal(size=(60, 6)) * [3, 2, 1.3, 1, 0.7, 0.4]).astype(np.float32).tolist()
    rows = [(k, base[0] if k % 3 == 0 else base[k % 60]) for k in range(400)]
    expected = plain(rows, weigh)
    found = whitened(spark, rows, weigh=weigh).collect()
    assert len(found) == len(expected) == 1600
    signs = {}
    for r in found:
        n, deviation, shown, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(shown) > 0.01:
            sign = signs.setdefault(r["component"], math.copysign(1, shown * r["whitened"]))
            assert r["whitened"] == pytest.approx(sign * shown, rel=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_rows_that_do_not_count_and_repeated_ids(spark):
    vectors = [[0.1, 0.2], [0.3, -0.4], [0.1, 0.2], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.5, 0.6]]
    found = whitened(spark, [(1 if k < 3 else k, v) for k, v in enumerate(vectors)] + [(None, [0.3, 0.9])]).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in found) == sorted(
        [(False, 1, c) for c in (1, 1, 1, 2, 2, 2)] + [(False, 7, 1), (False, 7, 2), (True, 0, 1), (True, 0, 2)]
    )
    assert {r["n"] for r in found} == {4}


def test_flat_and_empty_tables(spark):
    alike = whitened(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alike] == [(1, 0, None, None, 0.0)] * 4
    assert whitened(spark, []).collect() == []
    assert whitened(spark, [(1, None), (2, [])]).collect() == []
    line = whitened(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(r["explained"] == pytest.approx(1.0) for r in line if r["component"] == 1)
    assert max(r["identity_error"] for r in line) < 1e-9


def test_large_numbers_and_other_lengths(spark):
    huge = whitened(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0])]).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and {r["deviation"] for r in huge} == {None}
    wide = [(k, [float(200 * k), float(k % 3)]) for k in range(6)]
    expected = plain(wide)
    for r in whitened(spark, wide).collect():
        assert r["deviation"] == expected[r["vec_id"], r["component"]][1]


def test_query_equals_whole_table(spark, sample):
    table = spark.read.parquet(f"{sample}/embeddings.parquet").orderBy("vec_id").collect()
    expected = plain([(r["vec_id"], r["embedding"]) for r in table])
    order = {r["vec_id"]: k for k, r in enumerate(table)}
    found = queries.op12_whitening(spark, sample).collect()
    assert len(found) == len(expected)
    for r in found:
        n, deviation, shown, explained = expected[order[r["vec_id"]], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(shown), abs=1e-7) and r["identity_error"] < 1e-9
