"""Scene catalogs: inventories as JSON, search, assets in rows, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M

#: An item of a catalog: what a search needs, its properties as text, its assets by key.
ASSET = "struct<href:string,type:string,title:string,description:string,roles:array<string>,`eo:bands`:array<struct<name:string,common_name:string>>,gsd:double,`raster:bands`:array<struct<scale:double,offset:double>>>"
ITEM = f"struct<id:string,collection:string,bbox:array<double>,properties:map<string,string>,assets:map<string,{ASSET}>>"


def json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file with a given schema; a malformed file fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The items of inventories {"items": [...]}; a document without the list fails the query."""
    docs = json_strict(spark, path, f"items array<{ITEM}>")
    items = F.when(F.col("items").isNull(), F.raise_error(F.lit("the inventory has no items"))).otherwise(F.col("items"))
    return docs.select(F.explode(items).alias("item")).select("item.*")


def items_of(texts: DataFrame, column: str = "json") -> DataFrame:
    """Items from a column of JSON texts."""
    return texts.select(F.from_json(column, ITEM).alias("item")).filter("item.id is not null").select("item.*")


def datetime_of(properties: Column) -> Column:
    """The acquisition time as text; the start of an interval stands in."""
    return F.coalesce(F.try_element_at(properties, F.lit("datetime")), F.try_element_at(properties, F.lit("start_datetime")))


def search(items: DataFrame, collection: str, bbox: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """Items of a collection that meet a box within [start, end), with `at` and `date`; order by at, id to list them."""
    west, south, east, north = bbox
    b = F.col("bbox")
    at = F.to_timestamp(datetime_of(F.col("properties")))
    hit = (b[0] <= east) & (b[2] >= west) & (b[1] <= north) & (b[3] >= south)
    out = items.filter((F.col("collection") == collection) & hit).withColumn("at", at)
    return out.filter((F.col("at") >= F.lit(start).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp"))).withColumn("date", F.to_date("at"))


def assets(items: DataFrame) -> DataFrame:
    """(id, band, key, href, cog_likely, scale, offset): the assets that match a required band, keys in order within a band."""
    a = items.select("id", F.explode("assets").alias("key", "asset"))
    bands = F.flatten(F.transform(F.coalesce("asset.`eo:bands`", F.array()), lambda x: F.array(x["name"], x["common_name"])))
    texts = F.concat(F.array("asset.title", "asset.description"), bands)
    first = F.try_element_at("asset.`raster:bands`", F.lit(1))
    out = a.select("id", M.band_of(F.col("key"), texts).alias("band"), "key", "asset.href", M.cog_likely(F.col("asset.type"), F.col("asset.href")).alias("cog_likely"), first["scale"].alias("scale"), first["offset"].alias("offset"))
    return out.filter("band is not null")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, suffix) of all files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))


def hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"))
