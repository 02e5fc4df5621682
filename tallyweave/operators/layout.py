"""Geometry of forms as joins and folds: points in cells, peaks of a projection, the five lines of a result column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The share of the highest that a peak passes; the gap within which peaks are one; of rows the least gap, the
#: share of their median and the least distance.
PEAK_SHARE, PEAK_GAP, ROW_GAP, ROW_SHARE, ROW_LEAST = 0.25, 6, 16, 0.35, 7
#: Lines of a result column; of a column's width and middle within the page the bounds and the ideal, and how
#: far the gaps of its boxes may vary.
LINES, MOST_LINES = 5, 24
WIDTHS, MIDDLES, VARIATION = (0.10, 0.26, 0.18), (0.50, 0.82, 0.68), 0.35


def points_in_cells(points: DataFrame, cells: DataFrame, x: str, y: str, box: tuple[str, str, str, str], on: list[str] = ()) -> DataFrame:
    """Points with each cell (x1, y1, x2, y2 of `box`, bounds included) that holds them; columns of both, `on` once.

    Cells go on a grid as wide as the power of two at or over their longer side, so a cell lies on four squares of its own
    level at most, whatever the sizes of the others; a point looks at one square of each level that there is (their number
    grows with the logarithm of the largest to the smallest). Squares are joined by equality and the bounds tested then.
    Cells with a null or reversed bound hold nothing; points with a null co-ordinate are in none.
    """
    x1, y1, x2, y2 = box
    side = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))
    level = F.ceil(F.log2(F.greatest(side.cast("double"), F.lit(2.0**-20)))).cast("int")
    square = lambda v, at: F.floor(v.cast("double") / F.pow(F.lit(2.0), at)).cast("bigint")
    c = cells.where((F.col(x1) <= F.col(x2)) & (F.col(y1) <= F.col(y2))).withColumn("__level", level)
    levels = sorted(r[0] for r in c.select("__level").distinct().collect())  # some tens of numbers at most
    span = lambda a, b: F.explode(F.sequence(square(F.col(a), F.col("__level")), square(F.col(b), F.col("__level"))))
    c = c.withColumn("__i", span(x1, x2)).withColumn("__j", span(y1, y2))
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    p = p.withColumns({"__i": square(F.col(x), F.col("__level")), "__j": square(F.col(y), F.col("__level"))})
    hit = (F.col(x) >= F.col(x1)) & (F.col(x) <= F.col(x2)) & (F.col(y) >= F.col(y1)) & (F.col(y) <= F.col(y2))
    return p.join(c, [*on, "__level", "__i", "__j"]).where(hit).drop("__level", "__i", "__j")


def _merged(peaks: Column, gap: Column) -> Column:
    """Peaks (y, v) in order, each within the gap of the last one dropped, or in its place if it is higher."""

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        higher = F.when(p["v"] > last["v"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(p))).otherwise(kept)
        return F.when((F.size(kept) == 0) | (p["y"] - last["y"] > gap), F.concat(kept, F.array(p))).otherwise(higher)

    return F.aggregate(peaks, F.array().cast("array<struct<y:int,v:double>>"), step)


def peaks(profile: DataFrame, key: str, y: str, v: str) -> DataFrame:
    """(key, peaks array<int>) of a profile with a row for each y: its smoothed local maxima over a quarter of the highest.

    Peaks within 6 are one, the higher; from four peaks on, those within about a third of the usual distance of rows as
    well. A profile that is nowhere above 0 has none; nulls count as 0. Only peaks of a profile are gathered.
    """
    w = Window.partitionBy(key).orderBy(y)
    d = profile.select(key, F.col(y).cast("int").alias("y"), F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("v"))
    near = lambda f: F.coalesce(f("v").over(w.orderBy("y")), F.lit(0.0))
    d = d.withColumn("s", near(F.lag) / 3 + F.col("v") / 3 + near(F.lead) / 3)
    d = d.withColumns({"before": F.lag("s").over(w.orderBy("y")), "after": F.lead("s").over(w.orderBy("y")), "top": F.max("s").over(Window.partitionBy(key)), "raw": F.max("v").over(Window.partitionBy(key))})
    peak = (F.col("raw") > 0) & (F.col("s") > F.col("top") * PEAK_SHARE) & (F.col("s") >= F.col("before")) & (F.col("s") >= F.col("after"))
    found = F.array_sort(F.collect_list(F.when(peak, F.struct("y", F.col("s").alias("v")))))
    d = d.groupBy(key).agg(found.alias("p")).withColumn("p", _merged(F.col("p"), F.lit(PEAK_GAP)))
    gaps = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda q, i: q["y"] - F.get("p", i)["y"])
    d = d.withColumn("gaps", F.array_sort(F.filter(gaps, lambda g: g >= ROW_GAP)))
    at = lambda i: F.get("gaps", F.floor(i).cast("int"))
    median = (at((F.size("gaps") - 1) / 2) + at(F.size("gaps") / 2)) / 2
    apart = F.greatest(F.lit(ROW_LEAST), F.rint(median * ROW_SHARE).cast("int"))
    d = d.withColumn("p", F.when((F.size("p") >= 4) & (F.size("gaps") > 0), _merged(F.col("p"), apart)).otherwise(F.col("p")))
    return d.select(key, F.transform("p", lambda q: q["y"]).alias("peaks"))


def result_column(lines: DataFrame, key: str, centre: str, weight: str, width: float, height: float) -> DataFrame:
    """(key, score, lines array<double>) of the five lines of each key that look most like the edges of four equal boxes.

    Only the 24 heaviest lines of a key take part. The gaps g of four boxes vary by at most c = 0.35 of their mean m only if
    each lies within m (1 ± c sqrt 3): so the outer two lines, which give m, are chosen first and the inner ones within
    those bounds, instead of all choices of five. Ties go to the lines furthest left. Keys without a choice have no row.
    """
    heavy = Window.partitionBy(key).orderBy(F.col(weight).desc(), centre)
    d = lines.where(F.col(centre).isNotNull()).select(key, F.col(centre).cast("double").alias("x"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.row_number().over(heavy).alias("r"))
    d = d.where(F.col("r") <= MOST_LINES).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "w"))).alias("all"))
    d = d.withColumn("a", F.explode("all")).withColumn("e", F.explode("all"))
    span = F.col("e.x") - F.col("a.x")
    d = d.where((span >= WIDTHS[0] * width) & (span <= WIDTHS[1] * width)).withColumn("m", span / (LINES - 1))
    low, high = 1 - VARIATION * math.sqrt(LINES - 2), 1 + VARIATION * math.sqrt(LINES - 2)
    eps = 1e-9
    for last, own in (("a", "b"), ("b", "c"), ("c", "d")):
        fits = lambda q, last=F.col(f"{last}.x"): (q["x"] - last >= F.col("m") * (low - eps)) & (q["x"] - last <= F.col("m") * (high + eps)) & (q["x"] < F.col("e.x"))
        d = d.withColumn(own, F.explode(F.filter("all", _one(fits))))
    xs = [F.col(f"{n}.x") for n in "abcde"]
    gaps = [q - p for p, q in zip(xs, xs[1:], strict=False)]
    spread = F.sqrt(sum(((g - F.col("m")) * (g - F.col("m")) for g in gaps), F.lit(0.0)) / (LINES - 1)) / F.col("m")
    middle = sum(xs, F.lit(0.0)) / LINES / width
    share = (F.col("e.x") - F.col("a.x")) / width
    later = F.array_min(F.transform(F.filter("all", lambda q: q["x"] > F.col("e.x") + F.col("m") * 0.35), lambda q: q["x"] - F.col("e.x")))
    clear = F.coalesce(later, F.lit(float(width)) - F.col("e.x")) / F.col("m")
    support = sum((F.least(F.lit(1.0), F.col(f"{n}.w") / height) for n in "abcde"), F.lit(0.0)) / LINES
    score = 2.5 * (1 - spread) - F.abs(share - WIDTHS[2]) * 2.0 - F.abs(middle - MIDDLES[2]) * 0.6 + F.least(F.lit(1.5), clear) * 0.5 + support * 0.3
    d = d.withColumns({"cv": spread, "mid": middle, "score": score, "lines": F.array(*xs)})
    d = d.where((F.col("cv") <= VARIATION) & F.col("mid").between(*MIDDLES[:2]))
    best = d.groupBy(key).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "lines")).alias("b"))
    return best.select(key, (-F.col("b.s")).alias("score"), "b.lines")


def _one(test):
    """A lambda of one parameter, as functions of arrays count them."""
    return lambda q: test(q)
