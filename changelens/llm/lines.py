"""Operator 10: line de-duplication across documents, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import partitions, remove
from .common import SPACE, ascii_lower, boxed, kept_at, let, unboxed, written

#: Lines to a word of the bitmap; 62 keeps a word inside a signed long.
WORD = 62
FULL = (1 << WORD) - 1
#: Sampled lines to a partition, and how many of them make a line frequent enough to be dealt over bands.
SAMPLE, HOT = 200, 50


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _banded(lines: DataFrame, parts: int) -> DataFrame:
    """lines with _hot and _band: a hash with more than about a quarter of a partition's share lies in as many bands as there are partitions.

    A sample of about SAMPLE lines a partition, picked by the hash of their place, shows those; as each has HOT of the sample,
    there are at most SAMPLE / HOT for each partition, which bounds the broadcast. A hash that the sample misses costs balance only.
    """
    rate = max(1, lines.count() // (SAMPLE * parts))
    sample = lines.filter(F.pmod(F.xxhash64("_id", "_th", "_pos"), F.lit(rate)) == 0)
    hot = sample.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT).select("_h1", "_h2", F.lit(True).alias("_hot"))
    out = lines.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn("_hot", F.col("_hot").isNotNull())
    return out.withColumn("_band", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(parts))).otherwise(F.lit(0).cast("long")))


def keep_bitmaps(docs: DataFrame, mode: str = "frequent", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Sparse per-document bitmaps of the lines to keep.

    Each line with a key of min_chars code points or more becomes a 128-bit hash. The hashes are range-partitioned with document
    and position as secondary sort keys, once; what is asked of them streams over that order by windows within the
    partitions, with no further exchange by hash. The ranges cut frequent hashes by bands of documents. What the bands of
    such a hash hand over, one row each, is merged and broadcast: their number is bounded, see _banded.

    mode "frequent": every line whose key stands in min_docs documents or more is dropped everywhere.
    mode "first": all occurrences but the first, by doc_id and position, are dropped.

    Returns _id, _th (hash of the text, so that rows sharing a doc_id stay apart), keeps: array of (word, bits), where bit
    b of word w tells that line 62 w + b stays. Words that aren't listed keep all lines, and documents that keep all have no row.
    """
    if mode not in ("frequent", "first"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = partitions(docs.sparkSession)
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.posexplode(_split(F.col("text"))).alias("_pos", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.char_length("_key") >= min_chars)
    lines, path = kept_at(lines.select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")), "lines")
    ranged = _banded(lines, parts).repartitionByRange(parts, "_h1", "_h2", "_band")
    run = Window.partitionBy("_h1", "_h2", "_band")
    stream = run.orderBy("_id", "_pos", "_th")
    hash_ = ["_h1", "_h2"]
    if mode == "frequent":
        new = (F.row_number().over(stream) == 1) | ~F.lag("_id").over(stream).eqNullSafe(F.col("_id"))
        held = ranged.withColumn("_new", new.cast("int")).withColumn("_docs", F.sum("_new").over(run))
        held = written(held.filter(F.col("_hot") | (F.col("_docs") >= min_docs)).select("_id", "_th", "_pos", *hash_, "_hot", "_band", "_docs"), "lines-held")
        total = held.filter("_hot").groupBy(*hash_, "_band").agg(F.max("_docs").alias("_docs")).groupBy(*hash_).agg(F.sum("_docs").alias("_docs"))
        hot = held.filter("_hot").join(F.broadcast(total.filter(F.col("_docs") >= min_docs).select(*hash_)), hash_, "left_semi")
        gone = held.filter("not _hot").unionByName(hot)
    else:
        place = F.struct("_id", "_pos", "_th")
        held = ranged.withColumn("_first", F.first(place).over(stream))
        held = written(held.filter(F.col("_hot") | (F.col("_first") != place)).select("_id", "_th", "_pos", *hash_, "_hot", "_first"), "lines-held")
        least = held.filter("_hot").groupBy(*hash_).agg(F.min("_first").alias("_least"))
        hot = held.filter("_hot").join(F.broadcast(least), hash_).filter(F.col("_least") != place).select(*held.columns)
        gone = held.filter("not _hot").unionByName(hot)
    remove(docs.sparkSession, path)
    bits = F.bit_or(F.expr(f"shiftleft(1L, _pos % {WORD})")).bitwiseXOR(F.lit(FULL).cast("long"))
    words = gone.groupBy("_id", "_th", F.expr(f"_pos div {WORD}").cast("int").alias("_w")).agg(bits.alias("_bits"))
    return words.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("_w", "_bits"))).alias("keeps"))


def _applied(docs: DataFrame, mode: str, min_docs: int, min_chars: int) -> tuple[DataFrame, dict[str, Column]]:
    """Boxed docs beside their bitmaps, and the results of line_dedup on them."""
    maps = keep_bitmaps(docs.select("doc_id", "text"), mode, min_docs, min_chars).withColumnsRenamed({"_id": "m_id", "_th": "m_th"})
    rows = boxed(docs, F.col("doc_id").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("th"))
    joined = rows.join(maps, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    lines = _split(F.col("text"))
    every = F.lit(-1).cast("long")
    stays = lambda m, i: F.getbit(F.coalesce(F.try_element_at(m, F.floor(i / WORD).cast("int")), every), (i % WORD).cast("int")) == 1
    kept = let(F.struct(lines.alias("ls"), F.map_from_entries("keeps").alias("m")), lambda x: F.filter(x["ls"], lambda line, i: stays(x["m"], i)))
    kept_text = F.when(F.col("keeps").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.coalesce(F.aggregate("keeps", F.lit(0), lambda a, x: a + WORD - F.bit_count(x["_bits"])), F.lit(0)).cast("long")
    return joined, {"n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped, "keeps": F.col("keeps"), "kept_text": kept_text}


def line_dedup(docs: DataFrame, mode: str = "frequent", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Apply keep_bitmaps: docs with n_lines, n_dropped, keeps and kept_text added.

    Null and empty texts are one empty line, which has no key and stays. Rows that share a doc_id count as one document;
    identical rows get identical results; a null doc_id is a document like any other. Other columns pass through, whatever
    their names; those of the names of the four results are replaced. An empty table gives an empty table.
    """
    joined, results = _applied(docs, mode, min_docs, min_chars)
    return unboxed(joined, docs.columns, **results)


def without_lines(docs: DataFrame, mode: str = "frequent", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with what line_dedup keeps for text; all other columns stay as they are."""
    joined, results = _applied(docs, mode, min_docs, min_chars)
    text = results["kept_text"].alias("text")
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, **how) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), **how)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
