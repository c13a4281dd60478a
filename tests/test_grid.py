"""Spatial joins by tiles against all pairs of a page, and on a crowded page."""

from __future__ import annotations

import random

import pytest

from stemma.operators import grid
from stemma.operators import spatial as G


def random_boxes(seed, n, size):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2]), i, round(rng.uniform(-0.1, 1.05), 3), round(rng.uniform(-0.1, 1.05), 3), round(rng.uniform(0, size), 3), round(rng.uniform(0, size), 3)) for i in range(n)]
    return rows + [(3, n, 0.1, 0.1, 0.2, 0.2), (4, n + 1, None, 0.1, 0.2, 0.2), (4, n + 2, 0.1, 0.1, 0.2, 0.2), (5, n + 3, 0.5, 0.5, 0.5, 0.5), (5, n + 4, 0.5, 0.5, 0.5, 0.5), (6, n + 5, 0.2, 0.2, -0.1, 0.1), (6, n + 6, 0.1, 0.2, 0.2, 0.1)]


def inter(a, b):
    return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))


@pytest.mark.parametrize(("n", "size"), [(150, 0.1), (60, 0.9), (300, 0.02)])
def test_against_all_pairs(spark, n, size):
    """Boxes beyond the page, of no or negative size, equal ones and nulls."""
    rows = random_boxes(n, n, size)
    t = spark.createDataFrame([(*r, "x") for r in rows], "page long, item long, x double, y double, w double, h double, a string").repartition(3)
    good = [r for r in rows if None not in r]
    want = {}
    for a in good:
        for b in good:
            if a[0] == b[0] and a[1] < b[1] and (i := inter(a, b)) > 0:
                want[a[0], a[1], b[1]] = i / (a[4] * a[5] + b[4] * b[5] - i)
    assert {(r.page, r.a, r.b): r.iou for r in G.box_pairs(t.drop("a")).collect()} == pytest.approx({k: v for k, v in want.items() if v > 0})
    most = {(a[0], a[1]): max([inter(a, b) / max(1e-9, a[4] * a[5]) for b in good if b[0] == a[0] and b[1] != a[1]], default=0) if a in good else 0 for a in rows}
    assert {(r.page, r.item): r.overlap for r in G.max_overlap(t.drop("a")).collect()} == pytest.approx(most)
    below = {}
    for a in rows:
        near = [(b[3], b[1]) for b in rows if None not in (a[2], b[2]) and b[0] == a[0] and abs(a[2] - b[2]) < 0.08 and b[3] > a[3] + 0.01]
        below[a[0], a[1]] = min(near)[1] if near else None
    assert {(r.page, r.item): r.next for r in G.nearest_below(t.drop("a")).collect()} == below
    regions, blocks = t.where("item % 3 = 0").drop("a").withColumnRenamed("item", "region"), t.where("item % 3 <> 0").withColumnRenamed("item", "pos").withColumnRenamed("a", "content")
    for coverage in (None, 0.5):
        held = {}
        for a in rows:
            if a[1] % 3 == 0:
                inside = lambda b: a[2] - 0.01 <= b[2] + b[4] / 2 <= a[2] + a[4] + 0.01 and a[3] - 0.01 <= b[3] + b[5] / 2 <= a[3] + a[5] + 0.01  # noqa: B023, E731
                enough = lambda b: coverage and b[4] * b[5] > 0 and inter(a, b) / (b[4] * b[5]) >= coverage  # noqa: B023, E731
                held[a[0], a[1]] = sum(a in good and b[0] == a[0] and b[1] % 3 != 0 and bool(inside(b) or enough(b)) for b in good if b[4] >= 0)
        found = {(r.page, r.region): r.blocks for r in G.text_in_regions(regions, blocks.where("w IS NULL OR w >= 0"), "page", coverage=coverage).collect()}
        assert {k: v for k, v in found.items() if k[0] != 6} == {k: v for k, v in held.items() if k[0] != 6}


def test_crowded_page(spark):
    """Pairs looked at grow in proportion to a page's boxes, not with their square."""
    from stemma.functions.geometry import Box

    looked = []
    for n in (4000, 16000):
        rng = random.Random(1)
        side = 0.5 / n**0.5
        t = spark.createDataFrame([(1, i, rng.random(), rng.random(), side, side) for i in range(n)], "page long, item long, x double, y double, w double, h double")
        grids = grid.tiles_of(t, page="page")
        on = grid.on_tiles(t, grids, "page", Box.of())
        looked.append(on.groupBy("page", "__tx", "__ty").count().selectExpr("sum(count * count)").first()[0])
        assert G.box_pairs(t).count() > 0
    assert looked[1] < 5 * looked[0] and looked[1] < 30 * 16000
