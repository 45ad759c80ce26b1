"""Operator 7: near-duplicates by SimHash with a generalised pigeonhole index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, join_spread, partitions
from .common import LOWER_BYTES, boxed, byte_texts, give_back, slices, unboxed, written

#: A bin over this size is dealt again by its other bits before pairs are compared, and this often at most.
BIN_ROWS, ROUNDS = 4096, 3
#: What sending a probe costs in comparisons of a candidate, and probes of a partition that are worth considering.
PROBE_COST, MOST_PROBES = 200.0, 600
#: Fingerprints, at most, that the driver looks at to choose partitions and thresholds.
PLAN_SAMPLE = 2048


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; repeats count. Below `words` words the whole sequence is the shingle; none: 0."""
    import xxhash

    w = text.translate(LOWER_BYTES).split()
    if not w:
        return 0
    hash64 = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = w[at : at + 65536 + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(hash64, shingles), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64) if len(h) > 255 else np.add.reduce(bits, axis=0, dtype=np.uint8)
    on = np.flatnonzero(2 * ones > n)
    return int(sum(1 << int(b) for b in on))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns named in also: fp is the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                fps = np.array([fingerprint(t, words, seed) for t in byte_texts(b.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *also])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in also)]))


def choose_partitions(sample: np.ndarray, n: int, tau: int) -> list[tuple[tuple[int, ...], int]]:
    """(bits, threshold) of each partition with a threshold of 0 or more.

    For m partitions, thresholds t_i >= -1 that sum to tau - m + 1 leave no pair within tau bits out. Bits that are
    correlated in the sample share a partition, so that the partitions differ in what they tell. A dynamic programme
    over the partitions allocates the thresholds by estimated cost: probes that a row sends, and candidates that pairs
    of the sample predict for n rows. The m of the lowest cost wins.
    """
    bits = ((sample[:, None].view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    dev = bits - bits.mean(0) if len(bits) else np.zeros((1, 64))
    norm = np.sqrt((dev**2).sum(0))
    norm[norm == 0] = 1
    corr = np.abs(dev.T @ dev / norm[:, None] / norm)
    half = len(sample) // 2
    x = sample[:half].view(np.uint64)[:, None] ^ sample[half : 2 * half].view(np.uint64)[None, :512] if half else np.zeros((1, 0), np.uint64)
    best = (float("inf"), None)
    for m in range(2, tau + 2):
        groups, free = [], set(range(64))
        for g in range(m):
            want = 64 // m + (g < 64 % m)
            group = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
            free.discard(group[0])
            while len(group) < want:
                nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
                group.append(nxt)
                free.discard(nxt)
            groups.append(tuple(sorted(group)))
        cost = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.bitwise_count(x & mask)
            row = [0.0]
            for t in range(tau + 1):
                probes = sum(comb(len(g), k) for k in range(t + 1))
                seen = float((near <= t).mean()) if near.size else 0.0
                random = probes / 2.0 ** len(g)
                row.append(n * probes * PROBE_COST + n * n / 2 * max(seen, random) if probes <= MOST_PROBES else float("inf"))
            cost.append(row)
        table = {0: (0.0, ())}
        for row in cost:
            nxt: dict = {}
            for used, (c, ts) in table.items():
                for t in range(-1, tau + 1):
                    k = used + t + 1
                    if k <= tau + 1 and (c + row[t + 1], (*ts, t)) < nxt.get(k, (float("inf"), ())):
                        nxt[k] = (c + row[t + 1], (*ts, t))
            table = nxt
        c, ts = table[tau + 1]
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _value(bits: tuple[int, ...]):
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def _flips(bits: tuple[int, ...], t: int) -> tuple[int, ...]:
    return tuple(_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k))


def bins(fps: DataFrame, plan: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(key, used, fp): each row in the bins of its own values and of the values that its flips probe."""

    def entry(i: int, bits: tuple[int, ...], t: int):
        used = F.lit(_signed(sum(1 << b for b in bits)))
        flips = F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)])
        return F.transform(flips, lambda x: F.struct(F.xxhash64(F.lit(i), _value(bits).bitwiseXOR(x)).alias("key"), used.alias("used")))

    entries = [entry(i, bits, t) for i, (bits, t) in enumerate(plan)]
    return fps.select("fp", F.explode(F.flatten(F.array(*entries))).alias("e")).select("e.key", "e.used", "fp")


def refined(rows: DataFrame, tau: int, most: int = BIN_ROWS) -> DataFrame:
    """Deal bins of over `most` rows again: of tau + 1 groups of their other bits two links share one, so no link is lost.

    What still shares a bin after ROUNDS agrees in over half of the bits: groups of near copies, mostly linked. They are compared
    as they are, and a bin leaves the comparison once all its rows are connected.
    """
    done: DataFrame | None = None
    for depth in range(1, ROUNDS + 1):
        rows = written(rows, "simhash-bins")
        hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        hot = written(hot, "simhash-hot")
        cold = rows.join(hot, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        parts = []
        for j in range(tau + 1):
            # bit b of the 64 belongs to group (b + depth) mod (tau + 1) of this round
            mask = sum(1 << b for b in range(64) if (b * (2 * depth + 1) // 3 + depth) % (tau + 1) == j)
            take = F.lit(_signed(mask)).bitwiseAND(F.bitwise_not("used"))
            parts.append(F.struct(F.xxhash64(F.lit(depth), F.lit(j), "key", F.col("fp").bitwiseAND(take)).alias("k"), F.col("used").bitwiseOR(take).alias("u")))
        rows = rows.join(hot, "key", "left_semi").select("fp", F.explode(F.array(*parts)).alias("e")).select(F.col("e.k").alias("key"), F.col("e.u").alias("used"), "fp").distinct()
    return done.unionByName(rows)


def _forest(keys: np.ndarray, fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links within each run of equal keys, as pairs of fingerprints."""
    root = np.arange(len(keys))
    at = np.arange(len(keys) - 1) if len(keys) > 1 else np.zeros(0, np.int64)
    d = 1
    while len(at):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if d & (d - 1) == 0 and d > 8 and len(at):
            # rows of bins that are one component by now need no more comparisons
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            whole = np.minimum.reduceat(root, start) == np.maximum.reduceat(root, start)
            at = at[~whole[np.searchsorted(start, at, "right") - 1]]
        a, b = at, at + d
        near = (root[a] != root[b]) & (fps[a] != fps[b]) & (np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= tau)
        a, b = a[near], b[near]
        while len(a):
            lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, hi, lo)
            while not np.array_equal(up := root[root], root):
                root = up
            left = root[a] != root[b]
            a, b = a[left], b[left]
        d += 1
    own = np.flatnonzero(root != np.arange(len(keys)))
    return fps[own], fps[root[own]]


def links(rows: DataFrame, tau: int, parts: int) -> DataFrame:
    """(a, b): links within tau bits, for each bin a spanning forest; what they connect is what all links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.zeros(0, np.int64)

        def out(n):
            a, b = _forest(keys[:n], fps[:n], tau)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            n = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if n:
                yield out(n)
                keys, fps = keys[n:], fps[n:]
        yield out(len(keys))
        give_back()

    dealt = rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").filter("a != b").distinct()


def components(docs: DataFrame, tau: int = 3, words: int = 3, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root) of each row of docs, with the long columns named in also.

    root, the smallest fingerprint of a component, tells components apart where component_id is null or stands in several.
    """
    spark = docs.sparkSession
    own = written(fingerprints(docs, words, seed, also), "simhash-fp")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n")), "simhash-classes")
    n = classes.count()
    share = min(1.0, PLAN_SAMPLE / max(1, n))
    picked = classes.filter(F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").limit(2 * PLAN_SAMPLE).collect()
    plan = choose_partitions(np.array(sorted(r["fp"] for r in picked), np.int64), n, tau)
    parts = partitions(spark)
    edges = written(links(refined(bins(classes.select("fp"), plan), tau), tau, parts), "simhash-links")
    roots = connected_components(edges, "a", "b")
    merged = roots.join(classes, roots["node"] == classes["fp"]).groupBy("component").agg(F.min("cid").alias("low"), F.count("*").alias("size"))
    moved = join_spread(roots, merged, "component", "size", n, [F.col("node")]).select(F.col("node").alias("fp"), "low", "component")
    final = classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("low", "cid").alias("component_id"), F.coalesce("component", "fp").alias("root"))
    return join_spread(own, final, "fp", "n", own.count(), [F.col("doc_id"), *map(F.col, also)])


def near_duplicates(docs: DataFrame, tau: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs.

    component_id is the smallest doc_id that links of tau bits or fewer reach; rows with a null doc_id take part and
    give no id, so a component of them alone has null. Exact copies and equal fingerprints collapse before any join.
    Repeated rows come back as often as they stand in docs.
    """
    out = components(docs, tau, words, seed)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, tau: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each component.

    It is the row of the smallest doc_id, where null comes after all others. Of rows that share this doc_id the least hash
    of the text and then of all columns decides; of rows equal in all columns one stays. A row is known by two 64-bit
    hashes of its columns, so rows that share a doc_id with that of another component are not mistaken for it. All columns
    come back, whatever their names; an empty table gives an empty table.
    """
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = [F.xxhash64("text").alias("_th"), F.xxhash64(F.lit(1), *cells).alias("_h1"), F.xxhash64(F.lit(2), *cells).alias("_h2")]
    keyed = boxed(docs, *hashes)
    rows = components(docs.select("doc_id", "text", *hashes), tau, words, seed, ("_th", "_h1", "_h2")).groupBy("root", "doc_id", "_th", "_h1", "_h2").agg(F.count("*").alias("_n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th", "_h1", "_h2", "_n")).alias("k"))
    chosen = written(least.select(F.col("k._h1").alias("_k1"), F.col("k._h2").alias("_k2"), F.col("k._n").alias("_n")), "simhash-chosen")

    def picked(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left_semi")

    out = picked(chosen.filter("_n = 1"))
    again = chosen.filter("_n > 1")
    if not again.isEmpty():
        out = out.unionByName(picked(again).dropDuplicates(["_h1", "_h2"]))
    return unboxed(out, docs.columns)
