"""Tables of cells on disk: tiles as partitions, nodata as a sentinel there and as NULL in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import finite

# Fixed sentinels.
FLOAT_NODATA, COUNT_NODATA, BYTE_NODATA = -9999.0, 65535, 255
TILE = 256


def decoded(value: Column, nodata: float | None = FLOAT_NODATA) -> Column:
    """NULL for the sentinel, NaN and infinities."""
    ok = finite(value)
    return F.when(ok if nodata is None else ok & (value != nodata), value)


def encoded(value: Column, nodata: float) -> Column:
    return F.coalesce(value, F.lit(nodata))


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    return cells.withColumns({"tile_r": F.floor(F.col("r") / tile).cast("int"), "tile_c": F.floor(F.col("c") / tile).cast("int")})


def write(cells: DataFrame, path: str, nodata: dict[str, float], by: Sequence[str] = ("year",), tile: int = TILE, mode: str = "errorifexists") -> None:
    """Cells by `by` and tile as Parquet, rows of a tile side by side.

    The shuffle is on by, tile and a row band, so that one year of few tiles is not one task's work.
    """
    kinds = dict(cells.dtypes)
    out = tiled(cells.withColumns({k: encoded(F.col(k), v).cast(kinds[k]) for k, v in nodata.items()}), tile)
    keys = [*by, "tile_r", "tile_c"]
    out.repartition(*keys, F.floor(F.col("r") % tile / 64)).sortWithinPartitions(*keys, "r", "c").write.mode(mode).partitionBy(*keys).parquet(path)


def read(spark: SparkSession, path: str, nodata: dict[str, float], box: tuple[int, int, int, int] | None = None, tile: int = TILE) -> DataFrame:
    """Cells of a folder by write(), sentinels as NULL; box (top, left, bottom, right; ends exclusive) prunes tiles, then rows."""
    cells = spark.read.parquet(path)
    if box is not None:
        top, left, bottom, right = box
        if top >= bottom or left >= right:
            raise ValueError("the window is empty")
        near = F.col("tile_r").between(top // tile, (bottom - 1) // tile) & F.col("tile_c").between(left // tile, (right - 1) // tile)
        cells = cells.filter(near & (F.col("r") >= top) & (F.col("r") < bottom) & (F.col("c") >= left) & (F.col("c") < right))
    return cells.withColumns({k: decoded(F.col(k), v) for k, v in nodata.items()})


def source_window(extent: tuple[float, float, float, float], left: float, top: float, size: float, width: int, height: int) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of the cells that an extent (west, south, east, north) needs: rounded outwards with one cell more, clipped; ValueError if there are none."""
    from math import ceil, floor

    west, south, east, north = extent
    box = max(floor((top - north) / size) - 1, 0), max(floor((west - left) / size) - 1, 0), min(ceil((top - south) / size) + 1, height), min(ceil((east - left) / size) + 1, width)
    if box[0] >= box[2] or box[1] >= box[3]:
        raise ValueError("the extent lies outside the raster")
    return box


def blocks(spark: SparkSession, width: int, height: int, tile: int = TILE) -> DataFrame:
    """(tile_r, tile_c, rows, cols) of a grid in row-major order, ragged at the edges."""
    across = -(-width // tile)
    b = spark.range(across * -(-height // tile)).select(F.floor(F.col("id") / across).alias("tile_r"), (F.col("id") % across).alias("tile_c"))
    return b.withColumns({"rows": F.least(F.lit(tile), height - F.col("tile_r") * tile), "cols": F.least(F.lit(tile), width - F.col("tile_c") * tile)})


def decimated(cells: DataFrame, width: int, height: int, most: int) -> DataFrame:
    """Nearest cells of an overview whose larger side is at most `most`; the cell under an overview cell's centre is its value."""
    f = max(1, -(-max(width, height) // most))
    pick = lambda x, n: (F.col(x) == F.least(F.floor(F.col(x) / f) * f + f // 2, F.lit(n - 1)))
    return cells.filter(pick("r", height) & pick("c", width)).withColumns({"r": F.floor(F.col("r") / f), "c": F.floor(F.col("c") / f)})


def require_same_grid(left: DataFrame, right: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """Rows of (key, differs) for grids given as one row a key: `tolerance` has the columns and how far they may be apart."""
    both = left.alias("a").join(right.alias("b"), "key", "full_outer")
    same = F.lit(True)
    for name, far in tolerance.items():
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        same = same & F.coalesce((a == b) if not far else (F.abs(a - b) <= far), F.lit(False))
    return both.select("key", (~same).alias("differs"))
