"""Points in cells, peaks and result columns against plain loops."""

import math
import random
import statistics
from itertools import combinations

import pytest

from tallyweave.operators import layout


def test_points_in_cells(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.uniform(-50, 50), float(rng.randint(-50, 50))) for i in range(400)] + [(900, "a", None, 1.0), (901, "a", 0.0, 0.0)]
    cells = [(i, rng.choice("ab"), x, y, x + rng.choice([0.0, 0.3, 4.0, 60.0]), y + rng.choice([0.0, 1.0, 7.0, 90.0])) for i in range(120) for x, y in [(float(rng.randint(-50, 50)), float(rng.randint(-50, 50)))]]
    cells += [(500, "a", None, 0.0, 1.0, 1.0), (501, "a", 5.0, 0.0, 1.0, 1.0), (502, "a", -1e6, -1e6, 1e6, 1e6), (503, "a", 0.0, 0.0, 0.0, 0.0)]
    p, c = spark.createDataFrame(points, "p int, page string, x double, y double"), spark.createDataFrame(cells, "c int, page string, x1 double, y1 double, x2 double, y2 double")
    found = layout.points_in_cells(p, c, "x", "y", ("x1", "y1", "x2", "y2"), ["page"])
    want = sorted((i, k) for i, a, x, y in points for k, b, x1, y1, x2, y2 in cells if a == b and x is not None and x1 is not None and x1 <= x <= x2 and y1 <= y <= y2)
    assert sorted((r.p, r.c) for r in found.collect()) == want and len(want) > 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert layout.points_in_cells(p, c.limit(0), "x", "y", ("x1", "y1", "x2", "y2"), ["page"]).count() == 0


def peaks_of(v):
    s = [sum(v[j] / 3 for j in (i - 1, i, i + 1) if 0 <= j < len(v)) for i in range(len(v))]
    if max(v, default=0) <= 0:
        return []

    def fold(ys, gap):
        out = []
        for y in ys:
            if not out or y - out[-1] > gap:
                out.append(y)
            elif s[y] > s[out[-1]]:
                out[-1] = y
        return out

    found = fold([y for y in range(1, len(v) - 1) if s[y] > max(s) * 0.25 and s[y] >= s[y - 1] and s[y] >= s[y + 1]], 6)
    rows = [b - a for a, b in zip(found, found[1:], strict=False) if b - a >= 16]
    return fold(found, max(7, round(statistics.median(rows) * 0.35))) if len(found) >= 4 and rows else found


def test_peaks(spark):
    rng = random.Random(2)
    profiles = {"none": [0.0] * 30, "one": [3.0], "flat": [1.0] * 20, "even": [4.0 if i % 20 == 0 else 0.0 for i in range(200)]}
    for k in range(30):
        n, step = rng.randint(3, 300), rng.choice([5, 9, 18, 30])
        profiles[f"r{k}"] = [float(rng.choice([0, 0, 1, 9])) * (rng.random() < 0.2) + (30.0 + rng.randint(0, 4)) * (i % step < 2) * (rng.random() < 0.9) for i in range(n)]
    rows = [(k, y, x) for k, v in profiles.items() for y, x in enumerate(v)]
    got = {r.k: r.peaks for r in layout.peaks(spark.createDataFrame(rows, "k string, y int, v double").repartition(3), "k", "y", "v").collect()}
    assert got == {k: peaks_of(v) for k, v in profiles.items()} and sum(map(len, got.values())) > 100


def column_of(lines, width, height):
    lines = sorted(sorted(lines, key=lambda x: (-x[1], x[0]))[:24])
    best = None
    for five in combinations(lines, 5):
        xs = [x for x, _ in five]
        gaps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
        m = (xs[-1] - xs[0]) / 4
        if m <= 0:
            continue
        cv = math.sqrt(sum((g - m) ** 2 for g in gaps) / 4) / m
        share, middle = (xs[-1] - xs[0]) / width, sum(xs) / 5 / width
        if not (0.1 <= share <= 0.26 and 0.5 <= middle <= 0.82 and cv <= 0.35):
            continue
        later = [x - xs[-1] for x, _ in lines if x > xs[-1] + m * 0.35]
        clear = (min(later) if later else width - xs[-1]) / m
        score = 2.5 * (1 - cv) - abs(share - 0.18) * 2 - abs(middle - 0.68) * 0.6 + min(1.5, clear) * 0.5 + sum(min(1, w / height) for _, w in five) / 5 * 0.3
        best = min(best or (9, []), (-round(score, 9), xs))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_result_column(spark, seed):
    rng = random.Random(seed)
    pages = {f"p{k}": [(rng.uniform(300, 900), rng.uniform(1, 200)) for _ in range(rng.randint(3, 40))] for k in range(8)}
    pages |= {"grid": [(600.0 + 45 * i, 100.0) for i in range(7)], "few": [(600.0, 1.0)] * 4, "far": [(10.0 + i, 5.0) for i in range(9)]}
    rows = [(k, x, w) for k, v in pages.items() for x, w in v]
    got = {r.k: (r.score, r.lines) for r in layout.result_column(spark.createDataFrame(rows, "k string, x double, w double"), "k", "x", "w", 1000.0, 120.0).collect()}
    want = {k: b for k, v in pages.items() if (b := column_of(v, 1000.0, 120.0))}
    assert got.keys() == want.keys() and "grid" in got and "few" not in got
    for k, (s, xs) in want.items():
        assert got[k][1] == pytest.approx(xs) and got[k][0] == pytest.approx(-s, abs=1e-8)
