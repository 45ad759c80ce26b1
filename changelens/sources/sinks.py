"""Documents for delivery: compact JSON, GeoJSON, published in one step."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """Indented JSON with sorted keys and a closing newline; NaN and infinities are errors."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"


def compact(value: object) -> bytes:
    """JSON without spaces as UTF-8; NaN and infinities are errors."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def feature(geometry: Column, properties: Column) -> Column:
    return F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))


def feature_lines(rows: DataFrame, key: str, geometry: Column, properties: list[str]) -> DataFrame:
    """(key, json): one GeoJSON feature a row. Distributed; a collection is these texts in order of key."""
    return rows.select(key, F.to_json(feature(geometry, F.struct(*properties))).alias("json"))


def publish(files: dict[str, bytes]) -> None:
    """Write all files beside their places first, then move each there; if a write fails, none has moved."""
    staged: list[tuple[str, str]] = []
    try:
        for path, data in files.items():
            folder = Path(path).parent
            folder.mkdir(parents=True, exist_ok=True)
            handle, temp = tempfile.mkstemp(dir=folder, prefix=".staged-")
            staged.append((temp, path))
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        while staged:
            temp, path = staged[0]
            os.replace(temp, path)
            staged.pop(0)
    finally:
        for temp, _ in staged:
            Path(temp).unlink(missing_ok=True)


def publish_shared(spark: SparkSession, files: dict[str, bytes]) -> None:
    """As publish(), by Spark's own file systems: a path may be of any scheme or none, as its readers take it, and need not be mounted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    replace = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    staged = []
    try:
        for path, data in files.items():
            data = bytes(memoryview(data))
            place = hadoop.Path(path)
            disk = place.getFileSystem(conf)
            place = disk.makeQualified(place)
            temp = hadoop.Path(place.getParent(), f".staged-{uuid.uuid4().hex}")
            staged.append((disk, temp, place))
            out = disk.create(temp)
            try:
                out.write(data)
                out.hsync()
            finally:
                out.close()
        while staged:
            _, temp, place = staged[0]
            hadoop.FileContext.getFileContext(place.toUri(), conf).rename(temp, place, replace)
            staged.pop(0)
    finally:
        for disk, temp, _ in staged:
            disk.delete(temp, False)
