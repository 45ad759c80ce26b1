"""Outlines of labelled cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed sides of a cell with the cell on the left, x to the right and y down: offsets of the start and the end.
SIDES = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))


def boundary(cells: DataFrame, label: str = "label") -> DataFrame:
    """(label, x0, y0, x1, y1): directed sides that only one cell of the label has. One map-side combined aggregate, no join."""
    x, y = F.col("c").cast("long"), F.col("r").cast("long")
    sides = F.array(*[F.struct((x + a).alias("x0"), (y + b).alias("y0"), (x + c).alias("x1"), (y + d).alias("y1")) for a, b, c, d in SIDES])
    s = cells.select(label, F.explode(sides).alias("s"))
    key = [F.least("s.x0", "s.x1").alias("_x"), F.least("s.y0", "s.y1").alias("_y"), (F.col("s.x0") == F.col("s.x1")).alias("_v")]
    return s.groupBy(label, *key).agg(F.count("*").alias("_n"), F.first("s").alias("s")).filter("_n = 1").select(label, "s.*")


def _rings(sides: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Closed rings of one label's sides. Where two rings touch in a corner each turns towards its own cell, so that they stay apart."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in zip(sides["x0"], sides["y0"], sides["x1"], sides["y1"], strict=True):
        out.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at, step = [start], start, None
            while True:
                ways = out[at]
                if len(ways) == 1 or step is None:
                    to = ways.pop()
                else:
                    turn = lambda p, a=at, s=step: s[0] * (p[1] - a[1]) - s[1] * (p[0] - a[0])
                    to = min(ways, key=turn)
                    ways.remove(to)
                step = (to[0] - at[0], to[1] - at[1])
                at = to
                if at == start:
                    break
                ring.append(at)
            n = len(ring)
            bends = [p for i, p in enumerate(ring) if (ring[i - 1][0] - p[0]) * (ring[(i + 1) % n][1] - p[1]) != (ring[i - 1][1] - p[1]) * (ring[(i + 1) % n][0] - p[0])]
            rings.append([*bends, bends[0]])
    return rings


def outlines(cells: DataFrame, label: str = "label") -> DataFrame:
    """(label, ring, hole, area, points): the closed rings of each label in cell units; area is negative for holes.

    Null labels and cells are left out, repeated cells count once. A label's sides, which grow with its perimeter and not
    with its area, are stitched in one task.
    """
    kind = dict(cells.dtypes)[label]
    sides = boundary(cells.select(label, "r", "c").dropna().distinct(), label)

    def stitch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, ring in enumerate(_rings(pdf)):
            twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
            rows.append((key[0], i, twice > 0, -twice / 2, [{"x": float(x), "y": float(y)} for x, y in ring]))
        return pd.DataFrame(rows, columns=[label, "ring", "hole", "area", "points"])

    return sides.groupBy(label).applyInPandas(stitch, f"{label} {kind}, ring long, hole boolean, area double, points array<struct<x:double,y:double>>")


def _inside(ring: list[list[float]], x: float, y: float, across: bool) -> bool:
    """Whether the middle of a side lies in a ring of level and upright sides; the ray runs along the axis on which it has a half."""
    crossed = 0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        if across and y0 == y1:  # x is a half: go up to level sides above
            crossed += y0 < y and min(x0, x1) < x < max(x0, x1)
        elif not across and x0 == x1:
            crossed += x0 < x and min(y0, y1) < y < max(y0, y1)
    return crossed % 2 == 1


def _polygons(rings: list[tuple[bool, float, list[list[float]]]]) -> list[list[list[list[float]]]]:
    """Polygons of (hole, area, ring): each hole goes to the smallest outer ring that holds the middle of its first side."""
    out = sorted(((area, [ring]) for hole, area, ring in rings if not hole), key=lambda p: (p[0], p[1][0]))
    for ring in sorted(ring for hole, _, ring in rings if hole):
        (x0, y0), (x1, y1) = ring[0], ring[1]
        across = y0 == y1
        x, y = (min(x0, x1) + 0.5, y0) if across else (x0, min(y0, y1) + 0.5)
        next(p for _, p in out if _inside(p[0], x, y, across)).append(ring)
    return sorted(p for _, p in out)


def multipolygons(cells: DataFrame, label: str = "label") -> DataFrame:
    """(label, coordinates): the outlines of each label as the coordinates of a MultiPolygon, outer rings with their holes."""
    kind = dict(cells.dtypes)[label]
    rows = outlines(cells, label)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [(bool(h), float(a), [[p["x"], p["y"]] for p in ps]) for h, a, ps in zip(pdf["hole"], pdf["area"], pdf["points"], strict=True)]
        return pd.DataFrame([(key[0], _polygons(rings))], columns=[label, "coordinates"])

    return rows.groupBy(label).applyInPandas(build, f"{label} {kind}, coordinates array<array<array<array<double>>>>")
