"""Operator 8: packing of token sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices, written
from .tokens import CACHE_WORDS, default_tokenizer, word_cache

END = (1).to_bytes(4, "little")


def pieces(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the closing id 1, cut after every `most` ids.

    words bounds the words that a Python worker remembers, from task to task, and with that its memory; ids don't depend on it.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path, words)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), cache.ids(byte_texts(part.column(1))), strict=True):
                    ids += END
                    n = len(ids) // 4
                    rows += [(doc, s, min(most, n - s), zlib.crc32(ids[4 * s : 4 * (s + most)]), n) for s in range(0, n, most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        cache.settle()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each packing pattern.

    Lengths go from longest to shortest, each to the shortest packs that have room: the patterns with the most space
    left. Counts move as a whole, and a pattern is split only where a length runs out, so there are at most twice as
    many patterns as lengths, whatever the number of documents.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max(room, default=-1)
            if space < length:
                room.setdefault(most - length, []).append((left, [length]))
                break
            count, lengths = room[space].pop()
            if not room[space]:
                del room[space]
            take = min(count, left)
            if take < count:
                room.setdefault(space, []).append((count - take, lengths))
            room.setdefault(space - length, []).append((take, [*lengths, length]))
            left -= take
    return [p for space in sorted(room) for p in room[space]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): pieces of that length with rank low <= r < high go to sequence + r - low."""
    out, rank, base = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            low = rank.get(n, 0)
            out.append((n, low, low + count, base, offset))
            rank[n] = low + count
            offset += n
        base += count
    return out


def pack(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, words: int = CACHE_WORDS) -> DataFrame:
    """The pieces of docs with sequence_id and offset.

    Null and empty texts are one piece, the id 1. Rows that share a doc_id are packed one by one. Ranks within a length
    come from one range partitioning by length, document and start, and from the counts by partition and length, which
    number at most the partitions plus the lengths; a frequent length spreads over many partitions.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, most, tokenizer, words), "pack-pieces")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = cut.repartitionByRange(parts, "length", "doc_id", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "start", "ids_crc32")
    ranged = written(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "pack-ranged")
    runs = ranged.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).collect()
    histogram: dict[int, int] = {}
    firsts = []
    for r in sorted(runs, key=lambda r: (r["length"], r["_part"])):
        firsts.append((r["length"], r["_part"], r["_first"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    places: dict[int, list] = {}
    for n, *slot in slots(shortest_pack_first(histogram, most)):
        places.setdefault(n, []).append(tuple(slot))
    # One row a length, at most `most` of them; the join key alone decides, and a rank meets one interval of its length.
    first = spark.createDataFrame(firsts, "length long, _part int, _first long, _before long")
    place = spark.createDataFrame([(n, p) for n, p in places.items()], "length long, _places array<struct<low:long,high:long,seq:long,offset:long>>")
    ranked = ranged.join(F.broadcast(first), ["length", "_part"]).withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before"))
    spot = F.filter("_places", lambda p: (p["low"] <= F.col("_rank")) & (F.col("_rank") < p["high"]))[0]
    out = ranked.join(F.broadcast(place), "length").withColumn("_s", spot)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_s.seq") + F.col("_rank") - F.col("_s.low")).alias("sequence_id"), F.col("_s.offset").alias("offset"))
