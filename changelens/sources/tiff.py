"""Rasters as tiled GeoTIFF files: written in bounded pieces by tasks, read by header and by the tiles of a window."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: tags, sizes of field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 277, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
SHORT, LONG, DOUBLE, ASCII = 3, 4, 12, 2
SIZES, CODES = {ASCII: 1, SHORT: 2, LONG: 4, DOUBLE: 8}, {SHORT: "H", LONG: "I", DOUBLE: "d"}
DEFLATE = 8
KINDS = {("f", 4): 3, ("i", 4): 2, ("u", 2): 1, ("u", 1): 1}


def encode(values: np.ndarray, left: float, top: float, size: float, epsg: int, nodata: float, tile: int = 256) -> bytes:
    """One band as a little-endian GeoTIFF of deflated tiles; the corner and the size of a cell are in the units of the projection."""
    height, width = values.shape
    kind = KINDS[values.dtype.kind, values.dtype.itemsize]
    tiles = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            block = np.full((tile, tile), nodata, values.dtype)
            part = values[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(block.astype(block.dtype.newbyteorder("<")).tobytes(), 4))
    starts = 8 + np.concatenate([[0], np.cumsum([len(t) for t in tiles])])
    fields = [
        (WIDTH, LONG, [width]), (HEIGHT, LONG, [height]), (BITS, SHORT, [8 * values.dtype.itemsize]), (COMPRESSION, SHORT, [DEFLATE]), (PHOTOMETRIC, SHORT, [1]), (SAMPLES, SHORT, [1]), (TILE_WIDTH, LONG, [tile]), (TILE_HEIGHT, LONG, [tile]),
        (TILE_OFFSETS, LONG, starts[:-1].tolist()), (TILE_SIZES, LONG, [len(t) for t in tiles]), (SAMPLE_FORMAT, SHORT, [kind]), (PIXEL_SCALE, DOUBLE, [size, size, 0.0]), (TIE_POINT, DOUBLE, [0.0, 0.0, 0.0, left, top, 0.0]),
        (GEO_KEYS, SHORT, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]), (NODATA, ASCII, f"{nodata:g}\0".encode()),
    ]
    at = int(starts[-1])
    directory, extra = b"", b""
    behind = at + 2 + 12 * len(fields) + 4
    for tag, code, held in fields:
        data = held if isinstance(held, bytes) else struct.pack(f"<{len(held)}{CODES[code]}", *held)
        n = len(data) // SIZES[code]
        if len(data) > 4:
            directory += struct.pack("<HHII", tag, code, n, behind + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            directory += struct.pack("<HHI", tag, code, n) + data.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + b"".join(tiles) + struct.pack("<H", len(fields)) + directory + b"\0\0\0\0" + extra


def fields(file) -> dict[int, list]:
    """The fields of the first directory of a seekable file; nothing but them is read."""
    file.seek(0)
    mark, at = struct.unpack("<4sI", file.read(8))
    if mark != b"II*\0":
        raise ValueError("no little-endian TIFF")
    file.seek(at)
    (n,) = struct.unpack("<H", file.read(2))
    rows = [struct.unpack("<HHI4s", x) for x in struct.iter_unpack("12s", file.read(12 * n)) for x in x]
    out: dict[int, list] = {}
    for tag, code, many, inline in rows:
        size = many * SIZES[code]
        data = inline[:size]
        if size > 4:
            file.seek(struct.unpack("<I", inline)[0])
            data = file.read(size)
        out[tag] = [data.rstrip(b"\0").decode()] if code == ASCII else list(struct.unpack(f"<{many}{CODES[code]}", data))
    return out


def problems(f: dict[int, list], tile: int, epsg: int, size: float) -> list[str]:
    """What is wrong with a raster's structure: one band, deflated tiles of a size, a projection, a cell size and a sentinel."""
    wanted = {
        "not one band": f.get(SAMPLES) == [1], "not deflated": f.get(COMPRESSION) == [DEFLATE], "not tiled": f.get(TILE_WIDTH) == f.get(TILE_HEIGHT) == [tile], "wrong projection": f.get(GEO_KEYS, [0])[-1] == epsg,
        "wrong cell size": f.get(PIXEL_SCALE, [0.0])[0] == size, "no sentinel": NODATA in f, "tiles missing": len(f.get(TILE_OFFSETS, [])) == -(-f.get(WIDTH, [0])[0] // tile) * -(-f.get(HEIGHT, [0])[0] // tile),
    }
    return [name for name, ok in wanted.items() if not ok]


def window(file, box: tuple[int, int, int, int]) -> np.ndarray:
    """Cells [top, bottom) x [left, right) of a raster; only the tiles that hold them are read."""
    f = fields(file)
    tile, across = f[TILE_WIDTH][0], -(-f[WIDTH][0] // f[TILE_WIDTH][0])
    kind = {v: k for k, v in reversed(KINDS.items()) if k[1] * 8 == f[BITS][0]}[f[SAMPLE_FORMAT][0]]
    dtype = np.dtype(f"<{kind[0]}{kind[1]}")
    top, left, bottom, right = max(box[0], 0), max(box[1], 0), min(box[2], f[HEIGHT][0]), min(box[3], f[WIDTH][0])
    out = np.empty((max(bottom - top, 0), max(right - left, 0)), dtype)
    for tr in range(top // tile, -(-bottom // tile) if out.size else 0):
        for tc in range(left // tile, -(-right // tile)):
            at = tr * across + tc
            file.seek(f[TILE_OFFSETS][at])
            block = np.frombuffer(zlib.decompress(file.read(f[TILE_SIZES][at])), dtype).reshape(tile, tile)
            a, b, c, d = max(top, tr * tile), min(bottom, (tr + 1) * tile), max(left, tc * tile), min(right, (tc + 1) * tile)
            out[a - top : b - top, c - left : d - left] = block[a - tr * tile : b - tr * tile, c - tc * tile : d - tc * tile]
    return out


def write(cells: DataFrame, path: str, value: str, by: str, origin: tuple[float, float], size: float, epsg: int, nodata: float = -9999.0, piece: int = 2048, tile: int = 256) -> DataFrame:
    """(file, by, top, left, height, width) of the rasters written below path: one of at most piece x piece cells for each `by` and place.

    A task holds one piece. It writes under a name of its own and renames, so a repeated task leaves one whole file. Null, NaN and infinite
    values are stored as the sentinel, as are cells that are absent; of repeated cells the greatest value counts.
    """
    v = F.col(value).cast("float")
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    rows = cells.groupBy(F.col(by).cast("long").alias("by"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).agg(F.coalesce(F.max(ok), F.lit(nodata).cast("float")).alias("v"))
    rows = rows.withColumns({"pr": F.floor(F.col("r") / piece), "pc": F.floor(F.col("c") / piece)})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, pr, pc = (int(x) for x in key)
        top, left = pr * piece, pc * piece
        r, c = pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left
        grid = np.full((int(r.max()) + 1, int(c.max()) + 1), nodata, np.float32)
        grid[r, c] = pdf["v"].to_numpy(np.float32)
        disk, folder = fs.FileSystem.from_uri(path)
        disk.create_dir(folder, recursive=True)
        name = f"{k}-{pr}-{pc}.tif"
        temporary = f"{folder}/.{name}-{np.random.default_rng().integers(1 << 62)}"
        with disk.open_output_stream(temporary) as out:
            out.write(encode(grid, origin[0] + left * size, origin[1] - top * size, size, epsg, nodata, tile))
        disk.move(temporary, f"{folder}/{name}")
        return pd.DataFrame([(name, k, top, left, *grid.shape)], columns=["file", "by", "top", "left", "height", "width"])

    return rows.groupBy("by", "pr", "pc").applyInPandas(run, "file string, by long, top long, left long, height long, width long")


def read(spark: SparkSession, path: str, listing: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(by, r, c, value) of the rasters in a listing by write(), the sentinel as null; of a box (top, left, bottom, right) only the pieces and tiles that it touches."""
    top, left, bottom, right = box or (0, 0, 1 << 40, 1 << 40)
    near = listing.filter((F.col("top") < bottom) & (F.col("left") < right) & (F.col("top") + F.col("height") > top) & (F.col("left") + F.col("width") > left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                a = (max(top - row["top"], 0), max(left - row["left"], 0))
                whole = (*a, min(bottom - row["top"], row["height"]), min(right - row["left"], row["width"]))
                with disk.open_input_file(f"{folder}/{row['file']}") as file:
                    f = fields(file)
                    for at in range(whole[0], whole[2], 256):
                        got = window(file, (at, whole[1], min(at + 256, whole[2]), whole[3]))
                        r, c = np.indices(got.shape)
                        values = pa.array(got.ravel(), pa.float32(), mask=got.ravel() == np.float32(f[NODATA][0]))
                        cols = [pa.array(np.full(got.size, row["by"])), pa.array(r.ravel() + at + row["top"]), pa.array(c.ravel() + whole[1] + row["left"]), values]
                        yield pa.RecordBatch.from_arrays(cols, ["by", "r", "c", "value"])

    return near.mapInArrow(run, "by long, r long, c long, value float")


def checked(spark: SparkSession, path: str, listing: DataFrame, tile: int, epsg: int, size: float) -> DataFrame:
    """(file, by, width, height, problems) by the headers of the rasters in a listing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            rows = []
            for row in b.to_pylist():
                with disk.open_input_file(f"{folder}/{row['file']}") as file:
                    f = fields(file)
                rows.append((row["file"], row["by"], f[WIDTH][0], f[HEIGHT][0], problems(f, tile, epsg, size)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["file", "by", "width", "height", "problems"])

    return listing.mapInArrow(run, "file string, by long, width long, height long, problems array<string>")
