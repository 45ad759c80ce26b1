"""Operator 3: benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, byte_texts, fresh_path, give_back, slices, store, unboxed

#: Words of the contract after lower-casing A-Z: every other ASCII byte becomes a space, bytes from 0x80 stay.
WORD_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text that one shard's index holds, and benchmark text that is searched at once; a larger benchmark goes in blocks. A block
#: takes about 13 words of four bytes for each of its words, three times over while it is built.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
SAMPLE_EVERY = 8


class WaveletMatrix:
    """Ranks of symbols over a sequence, by one bit level at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.levels = len(values), []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((b, ones, self.n - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low


class FMIndex:
    """Index of a sequence of symbols from 1 to `symbols`, cut into runs by zeros; no match spans a zero.

    Each zero sorts as a symbol of its own, by place, so suffixes compare to the end of their run and prefix doubling
    ends after log2 of the longest run. Positions are sampled every few places and at the starts of runs, which a walk
    backwards therefore never leaves.
    """

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        text = np.concatenate([text, [0]]).astype(np.int64)
        n = len(text)
        zero = text == 0
        rank = text + zero.sum()
        rank[zero] = np.arange(zero.sum())
        k = 1
        while True:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - k] = rank[k:] if k < n else nxt[: n - k]
            order = np.argsort(rank * (n + symbols + 2) + nxt + 1, kind="stable")
            key = rank * (n + symbols + 2) + nxt + 1
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if n == 0 or new[-1] == n - 1:
                break
            k *= 2
        self.sa = order
        before = text[order - 1]
        before[order == 0] = 0
        self.bwt = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        self.sampled = (order % every == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern, by backward search; patterns is a matrix with `lengths` symbols used in each row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] if len(patterns) else 0):
            live = live[(low[live] < high[live]) & (lengths[live] > j)]
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - j]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a sampled one."""
        rows, steps, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left := left[~self.sampled[rows[left]]]):
            c = self.bwt[rows[left]]
            rows[left] = self.first[c] + self.wavelet.rank(c, rows[left])
            steps[left] += 1
        return self.position[rows] + steps


class Phrases:
    """The windows of a block of benchmark items, over the vocabulary of the block: one row of word numbers each, zeros behind short ones."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, parts, owners = [], [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = text.translate(WORD_TABLE).split()
            if not words:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            part = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (0, window - len(ids)))[None]
            parts.append(part)
            owners.append(np.full(len(part), len(self.items), np.int32))
            self.items.append(item)
        rows, owner = np.ascontiguousarray(np.concatenate(parts)), np.concatenate(owners)
        key = rows.view(f"V{4 * window}").ravel()
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
        self.patterns = rows[order[new]]
        self.lengths = (self.patterns != 0).sum(1)
        self.least = int(self.lengths.min(initial=window))
        self.owner, self.bounds = owner[order], np.concatenate([new, [len(key)]])  # items of pattern p: owner[bounds[p] : bounds[p + 1]]

    def named(self, patterns: np.ndarray) -> set[str]:
        """The items that have any of the patterns."""
        return {self.items[i] for p in np.unique(patterns) for i in self.owner[self.bounds[p] : self.bounds[p + 1]]}

    def hits(self, words: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """(merged [start, end) word spans, items) of each document of a shard, by one FM-index over the shard.

        The index keeps the words of the vocabulary; all others cut runs, and runs shorter than the shortest window,
        which hold none, are left out.
        """
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        out: list[tuple[np.ndarray, set[str]]] = [(np.zeros((0, 2), np.int64), set())] * len(words)
        if not len(self.patterns) or not starts[-1]:
            return out
        ids = np.zeros(starts[-1] + len(words), np.int32)  # a zero behind each document
        get, at = self.vocabulary.get, 0
        for w in words:
            ids[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
            at += len(w) + 1
        edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= self.least
        begin, size = begin[long], (end - begin)[long] + 1  # with the zero behind
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(begin) else np.zeros(0, np.int64)
        if not len(place):
            return out
        index = FMIndex(ids[np.minimum(place, len(ids) - 1)], len(self.vocabulary))
        low, high = index.search(self.patterns, self.lengths)
        many = high - low
        pattern = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        where = place[index.locate(rows)]
        shifted = starts + np.arange(len(starts))  # of documents, with the zeros between them
        doc = np.searchsorted(shifted, where, "right") - 1
        order = np.lexsort((where, doc))
        doc, where, pattern = doc[order], where[order] - shifted[doc[order]], pattern[order]
        for d, s, e in zip(*_groups(doc), strict=True):
            a, b = where[s:e], where[s:e] + self.lengths[pattern[s:e]]
            top = np.maximum.accumulate(b)
            new = np.concatenate([[True], a[1:] > top[:-1]])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
            out[d] = (np.stack([a[new], top[last]], 1), self.named(pattern[s:e]))
        return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], start, np.concatenate([start[1:], [len(keys)]]) if len(keys) else start


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size; the whole of it is read at once only where its size allows that."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("i is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.length("i")).alias("n")).first()["n"] or 0
    n = -(-size // most_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "text"), F.lit(n)) == k)
        yield [(r["i"], r["text"].encode()) for r in part.toLocalIterator()]


def _stored(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Paths of the benchmark's blocks, each as its Phrases, in the shared folder. The driver holds one block at a time."""
    folder = fresh_path(benchmark.sparkSession, "decontaminate")
    paths = []
    for items in _blocks(benchmark, block_bytes):
        disk, name = store(folder)
        disk.create_dir(name, recursive=True)
        paths.append(f"{folder}/block-{len(paths)}")
        with disk.open_output_stream(f"{name}/block-{len(paths) - 1}") as out:
            out.write(pickle.dumps(Phrases(items, window), 5))
    return paths


@lru_cache(maxsize=1)
def _phrases(path: str) -> Phrases:
    """A block, read once by a worker where it is the only one."""
    disk, name = store(path)
    with disk.open_input_stream(name) as file:
        return pickle.loads(file.read())


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, block_bytes: int) -> DataFrame:
    """(row, n_words, hit_spans, hit_items), row being docs' columns: one pass over docs, whatever the number of blocks."""
    paths = _stored(benchmark, window, block_bytes)
    boxes = boxed(docs)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans), T.StructField("hit_items", T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
        for batch in batches:
            for part in slices(batch, batch.column(0).field("text"), shard_bytes):
                words = [t.translate(WORD_TABLE).split() for t in byte_texts(part.column(0).field("text"))]
                spans: list[list[tuple[int, int]]] = [[] for _ in words]
                names: list[set[str]] = [set() for _ in words]
                for path in paths:
                    for d, (found, items) in enumerate(_phrases(path).hits(words)):
                        if items:
                            spans[d] = _merged(spans[d] + [(int(a), int(b)) for a, b in found])
                            names[d] |= items
                cols = [list(map(len, words)), [[{"start": a, "end": b} for a, b in x] for x in spans], [sorted(x) for x in names]]
                del words, spans, names
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["row", "n_words", "hit_spans", "hit_items"])
            give_back()

    return boxes.mapInArrow(run, T.StructType([*boxes.schema.fields, *added]))


def _judged(found: DataFrame, share: int = 20) -> DataFrame:
    """_searched with n_hit, n_items and contaminated: hit, and a 20th of the words or more."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("hit_items").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, share: int = 20) -> DataFrame:
    """docs with n_words, hit_spans (merged word spans of benchmark windows), hit_items, n_hit, n_items and contaminated added.

    Null texts have no words; null items and null item ids count as none; items of equal text each count. Repeated rows each
    get the same result, long texts are searched whole, and an empty table gives an empty table. Other columns pass through, whatever their names;
    those of the names of the results are replaced. A benchmark of over block_bytes is searched block by block within the one
    pass over docs; blocks lie in the shared folder, and a task holds one at a time.
    """
    out = _judged(_searched(docs, benchmark, window, shard_bytes, block_bytes), share)
    return unboxed(out, docs.columns, **{c: F.col(c) for c in ("n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated")})


def digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    out = find_passages(docs.select("doc_id", "text"), benchmark, **how)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, from a span's first word to the end of its last."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones, and without the hit spans in those that stay. Only texts with spans are rewritten; all other columns stay."""
    kept = _judged(_searched(docs, benchmark, window, shard_bytes, block_bytes)).filter(~F.col("contaminated"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: cut_spans(t, [(x["start"], x["end"]) for x in s]) if t and len(s) else t)

    out = kept.withColumn("text", cut("row.text", "hit_spans"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
