"""Operator 6: removal of repeated byte strings with range-partitioned, locally sorted suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import partitions, remove
from .common import byte_texts, kept_at, slices, written

#: Leading bytes by which suffixes are grouped. Of the windows of LENGTH bytes each names one suffix of LEAD bytes in it.
LEAD = 24
#: Text to a shard and text whose suffixes are looked at together, about.
SHARD_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20
#: Text to a range of suffixes, ranges at most, and sampled suffixes to a range; the driver holds the sample, 24 bytes each.
RANGE_BYTES, MOST_RANGES, SAMPLED = 4 << 20, 200_000, 8
#: Suffixes, about, above which a lead is divided by what stands around it.
HEAVY = 50_000
#: Rows that the quicksort leaves to a sort of all words at once.
SMALL = 2048
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P = 0x9E3779B97F4A7C15
POWERS = {k: np.uint64(pow(P, k, 1 << 64)) for k in (1, 2, 4, 8)}


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the LEAD bytes from each place; the last LEAD - 1 places have none."""
    h = {1: BYTE[data]}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][: len(h[k]) - k] * POWERS[k] + h[k][k:]
        if k < 4:
            del h[k]
    x = h[16][: len(data) - LEAD + 1] * POWERS[8] + h[8][16:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _hashes_of(leads: np.ndarray) -> np.ndarray:
    """The same hash for each row of LEAD bytes."""
    parts = [_hashes(np.ascontiguousarray(leads[a : a + 20_000]).ravel())[::LEAD] for a in range(0, len(leads), 20_000)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Evenly spread keys of `bits` bits: the hashes that windows name are least ones, most of them small."""
    x = hashes * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(P)
    return x >> np.uint64(64 - bits)


def windows(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that name the same suffix: (first, last) window start, place of the suffix, its hash.

    text is documents end to end, `ends` where each ends. A window of `length` bytes names the suffix whose lead has the
    least hash in it, leftmost of equals. That depends on the window's bytes alone, so equal windows name suffixes of equal lead
    at equal distance.
    """
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = _hashes(text)
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    w, k = length - LEAD + 1, 1
    while 2 * k <= w:
        v = np.minimum(v[: len(v) - k], v[k:])
        k *= 2
    if k < w:
        v = np.minimum(v[: len(v) - (w - k)], v[w - k :])
    at = (v & low).astype(np.int64)
    n = len(at)
    valid = np.ones(n, bool)
    for e in ends[:-1]:
        valid[max(0, int(e) - length + 1) : int(e)] = False
    change = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [n - 1]])
    ok = valid[first]
    first, last = first[ok], last[ok]
    place = at[first]
    return first, last, place, h[place]


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, document of each part, its start in the document, ends): parts of about CHUNK_BYTES; parts of one document overlap by length - 1."""
    held, size = [], 0
    step = CHUNK_BYTES

    def out():
        ends = np.cumsum([len(x[2]) for x in held])
        return np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.array([x[0] for x in held]), np.array([x[1] for x in held]), ends

    for d, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), step):
            part = t[s : s + step + length - 1]
            if len(part) < length:
                continue
            if held and size + len(part) > 2 * step:
                yield out()
                held, size = [], 0
            held.append((d, s, part))
            size += len(part)
    if held:
        yield out()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, in byte planes, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_keys(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _batches(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words: three-way quicksort on one word at a time, the next among equals only."""
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        a, b, w = todo.pop()
        if b - a < 2 or w == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= SMALL:
            order[a:b] = part[np.lexsort(words[part, w:].T[::-1])]
            continue
        x = words[part, w]
        some = np.sort(x[:: max(1, len(x) // 63)])
        pivot = some[len(some) // 2]
        low, high = x < pivot, x > pivot
        i, j = a + int(low.sum()), b - int(high.sum())
        order[a:b] = np.concatenate([part[low], part[~(low | high)], part[high]])
        todo += [(a, i, w), (i, j, w + 1), (j, b, w)]
    return order


def _words(m: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Rows of bytes as words that sort as the bytes do, and signed longs behind them."""
    k = -(-m.shape[1] // 8)
    out = np.zeros((len(m), k + len(more)), np.uint64)
    wide = np.zeros((len(m), 8 * k), np.uint8)
    wide[:, : m.shape[1]] = m
    out[:, :k] = wide.view(">u8")
    for i, x in enumerate(more):
        out[:, k + i] = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out


def _mixed(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of words."""
    h = np.zeros(len(words), np.uint64)
    for w in range(words.shape[1]):
        h = (h ^ words[:, w]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _variants(ids: list[int], texts: list[bytes]) -> np.ndarray:
    """Of each row of a shard the rank of its text among the texts of its doc_id, 0 where there is one. A shard has all rows of a doc_id."""
    of: dict[int, set[bytes]] = {}
    for i, t in zip(ids, texts, strict=True):
        of.setdefault(i, set()).add(t)
    rank = {i: {t: k for k, t in enumerate(sorted(ts))} for i, ts in of.items() if len(ts) > 1}
    return np.array([rank[i][t] if i in rank else 0 for i, t in zip(ids, texts, strict=True)], "<i4")


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(keys):
        return iter(())
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return zip(start.tolist(), [*start[1:].tolist(), len(keys)], strict=True)


def leads(docs: DataFrame, length: int, buckets: int, bits: int, share: float) -> DataFrame:
    """(bucket, blob, owners): leads of the suffixes by ranges of their hash, each key once for each shard of a batch.

    owners: shard * 64, plus twice the binary logarithm of how often the shard has the key, plus 1 where more than one document of it
    does. Bucket -1 holds a sample of the leads, `share` of them, by place, so that a frequent lead is as frequent in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "blob", "owners"], [pa.int32(), pa.binary(), pa.binary()]
        import zstandard

        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                shard_of = part.column(0).to_numpy(zero_copy_only=False)
                found, sample = [], []
                for text, doc, _, ends in _chunks(byte_texts(part.column(1)), length):
                    _, _, place, h = windows(text, ends, length)
                    dice = np.random.default_rng([len(text), int(h[0]) if len(h) else 0]).random(len(place))
                    sample += [text[p : p + LEAD].tobytes() for p in place[dice < share]]
                    d = doc[np.searchsorted(ends, place, "right")]
                    found.append(np.stack([_keys(h, bits), d.astype(np.uint64)]))
                rows = []
                if sample:
                    rows.append((-1, b"".join(sample), b""))
                if found:
                    key, doc = np.concatenate(found, 1)
                    shard = shard_of[doc.astype(np.int64)].astype(np.uint64)
                    order = np.lexsort((doc, shard, key))
                    key, doc, shard = key[order], doc[order], shard[order]
                    new = np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
                    at = np.flatnonzero(new)
                    more = doc[np.concatenate([at[1:], [len(doc)]]) - 1] != doc[at]
                    often = np.log2(np.diff(at, append=len(key))).astype(np.uint64)
                    key, owner = key[at], (shard[at] * np.uint64(64) + np.uint64(2) * often + more).astype("<u4")
                    bucket = (key // np.uint64(-(-(1 << bits) // buckets))).astype(np.int64)
                    for a, b in _bounds(bucket):
                        rows.append((int(bucket[a]), _pack_keys(key[a:b]), zstandard.compress(np.ascontiguousarray(owner[a:b].view(np.uint8).reshape(-1, 4).T).tobytes(), 1)))
                yield _batches(rows, kinds, names)

    return docs.select("shard", "text").mapInArrow(run, "bucket int, blob binary, owners binary")


def repeated(found: DataFrame, parts: int) -> DataFrame:
    """(shard, keys, heavy): the keys of each bucket that stand in two documents or more, for the shards that have them; heavy: those of over HEAVY suffixes."""
    limit = HEAVY

    def merge(t: pa.Table) -> pa.Table:
        import zstandard

        keys, owners = [], []
        for blob, own in zip(t.column("blob").to_pylist(), t.column("owners").to_pylist(), strict=True):
            keys.append(_unpack_keys(blob))
            owners.append(np.ascontiguousarray(np.frombuffer(zstandard.decompress(own), np.uint8).reshape(4, -1).T).view("<u4").ravel())
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = key[1:] == key[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        at, of = np.flatnonzero(first), np.cumsum(first) - 1
        multi = np.bitwise_or.reduceat(owner & 1, at).astype(bool)[of]
        heavy = (np.add.reduceat(1 << ((owner >> 1) & 31).astype(np.int64), at) > limit)[of]
        hit = twice | multi
        key, shard, heavy = key[hit], owner[hit] >> 6, heavy[hit]
        order = np.lexsort((key, shard))
        key, shard, heavy = key[order], shard[order], heavy[order]
        rows = [(int(shard[a]), _pack_keys(np.unique(key[a:b])), _pack_keys(np.unique(key[a:b][heavy[a:b]]))) for a, b in _bounds(shard)]
        return pa.Table.from_batches([_batches(rows, [pa.int32(), pa.binary(), pa.binary()], ["shard", "keys", "heavy"])])

    return found.filter("bucket >= 0").repartition(parts, "bucket").groupBy("bucket").applyInArrow(merge, "shard int, keys binary, heavy binary")


def _as_rows(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"V{matrix.shape[1]}").ravel()


def _least(m: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray, length: int):
    """Sorted rows of the smallest document that has each, a document's own repeats included; and (documents, variants, windows) of the others."""
    order = multikey_order(_words(m, doc, place))
    m, doc, variant, place = m[order], doc[order], variant[order], place[order]
    row = _as_rows(m)
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    later = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    before, behind = m[later, -1].astype(np.int64), m[later, -2].astype(np.int64)
    gone = doc[later], variant[later], np.stack([place[later] - before, place[later] + behind - length], 1)
    return (m[~later], doc[~later], variant[~later], place[~later]), gone


def _by_window(m: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray, length: int):
    """The same rows cut into one for each window, which then is the suffix: its bytes and nothing before it."""
    left = length - LEAD
    line = np.concatenate([m[:, length : length + left][:, ::-1], m[:, :length]], 1)
    before, size = m[:, -1].astype(np.int64), m[:, -1].astype(np.int64) + m[:, -2] - length + 1
    r = np.repeat(np.arange(len(m)), size)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(r), m.shape[1]), np.uint8)
    out[:, :length] = np.lib.stride_tricks.sliding_window_view(line, length, axis=1)[r, left - before[r] + shift]
    out[:, -2] = length
    return out, doc[r], variant[r], place[r] - before[r] + shift


def contexts(docs: DataFrame, keys: DataFrame, length: int, bits: int, splitters: np.ndarray, ranges: int, parts: int) -> DataFrame:
    """Suffixes whose lead repeats, with the bytes of their windows, by ranges of the lead; and what a shard finds by itself.

    Range r >= 0: rows, a matrix of [suffix][bytes before it, reversed][bytes used behind, before], and of each the
    smallest document that has it in the shard, with each place of the suffix in that document. The windows around a heavy lead go as suffixes of
    their own, to ranges by the hash of all their bytes: equal ones meet, and no range gets a heavy lead whole. Range -1: documents of the shard and the
    first and last windows that an equal row of a smaller document covers. variants tell the texts of one doc_id apart.
    """
    left = length - LEAD
    width = length + left + 2
    out = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("rows", pa.binary()), ("docs", pa.binary()), ("variants", pa.binary()), ("places", pa.binary())])

    def run(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        import zstandard

        if not reply.num_rows or not t.num_rows:
            return out.empty_table()
        shard = t.column("shard")[0].as_py()
        known, heavy = (np.unique(np.concatenate([_unpack_keys(x) for x in reply.column(c).to_pylist()])) for c in ("keys", "heavy"))
        ids = t.column("doc_id").to_numpy()
        texts = byte_texts(t.column("text"))
        kinds = _variants(ids.tolist(), texts)
        mats, docs_, variants, places = [], [], [], []
        for text, doc, start, ends in _chunks(texts, length):
            first, last, place, h = windows(text, ends, length)
            k = _keys(h, bits)
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[at] == k
            first, last, place = first[hit], last[hit], place[hit]
            part = np.searchsorted(ends, place, "right")
            before, behind = place - first, last + length - place
            padded = np.concatenate([np.zeros(left, np.uint8), text, np.zeros(length, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, left + length)
            m = np.empty((len(place), width), np.uint8)
            body = view[place]
            m[:, :length] = body[:, left:]
            m[:, length : length + left] = body[:, left - 1 :: -1][:, :left]
            m[:, :length][np.arange(length) >= behind[:, None]] = 0
            m[:, length : length + left][np.arange(left) >= before[:, None]] = 0
            m[:, -2], m[:, -1] = behind, before
            mats.append(m)
            docs_.append(ids[doc[part]])
            variants.append(kinds[doc[part]])
            places.append(place - np.concatenate([[0], ends[:-1]])[part] + start[part])
        if not mats or not sum(map(len, mats)):
            return out.empty_table()
        m, doc, variant, place = np.concatenate(mats), np.concatenate(docs_), np.concatenate(variants), np.concatenate(places)
        del mats, docs_, variants, places
        (m, doc, variant, place), gone = _least(m, doc, variant, place, length)
        gone = [gone]
        weighty = np.isin(_keys(_hashes_of(m[:, :LEAD]), bits), heavy)
        light, weighty = np.flatnonzero(~weighty), np.flatnonzero(weighty)
        parts_ = [(m[light], doc[light], variant[light], place[light])]
        spots = [np.searchsorted(splitters, np.ascontiguousarray(m[light, :LEAD]).view(f"S{LEAD}").ravel(), "right")]
        for at in np.split(weighty, range(8192, len(weighty), 8192)):
            own, more = _least(*_by_window(m[at], doc[at], variant[at], place[at], length), length)
            parts_.append(own)
            gone.append(more)
            spots.append((_mixed(_words(own[0][:, :length])) % np.uint64(ranges)).astype(np.int64))
        m, doc, variant, place = (np.concatenate(x) for x in zip(*parts_, strict=True))
        spot = np.concatenate(spots)
        rows = []
        late = [np.concatenate(x) for x in zip(*gone, strict=True)]
        if len(late[0]):
            rows.append((-1, shard, b"", late[0].astype("<i8").tobytes(), late[1].tobytes(), late[2].astype("<i8").tobytes()))
        order = np.argsort(spot, kind="stable")
        spot, m, doc, variant, place = spot[order], m[order], doc[order], variant[order], place[order]
        for a, b in _bounds(spot):
            rows.append((int(spot[a]), shard, zstandard.compress(m[a:b].tobytes(), 1), doc[a:b].astype("<i8").tobytes(), variant[a:b].tobytes(), place[a:b].astype("<i8").tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    texts = docs.select("shard", "doc_id", "text").repartition(parts, "shard").groupBy("shard")
    return texts.cogroup(keys.repartition(parts, "shard").groupBy("shard")).applyInArrow(run, "range int, shard int, rows binary, docs binary, variants binary, places binary")


def _runs(sorted_rows: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], (sorted_rows[1:] != sorted_rows[:-1]).astype(np.int64)])) if len(sorted_rows) else np.zeros(0, np.int64)


def compared(found: DataFrame, length: int, parts: int) -> DataFrame:
    """(shard, docs, variants, places): windows of each range's rows that a smaller document has too, as first and last window start.

    A range sorts its rows by suffix and then by what stands before it, by multikey quicksort. Rows of one lead are neighbours; within them each window
    of a row is ranked with its equals, and those of documents beyond the smallest are reported. Ranges are cut between leads, and a heavy lead
    between windows, so nothing that is equal stands on both sides of a boundary.
    """
    left = length - LEAD

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        width = length + left + 2
        m = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, width) for x in t.column("rows").to_pylist()])
        n = [len(x) // 8 for x in t.column("docs").to_pylist()]
        doc = np.frombuffer(b"".join(t.column("docs").to_pylist()), "<i8")
        variant = np.frombuffer(b"".join(t.column("variants").to_pylist()), "<i4")
        place = np.frombuffer(b"".join(t.column("places").to_pylist()), "<i8")
        shard = np.repeat(t.column("shard").to_numpy(), n)
        order = multikey_order(_words(m, doc))
        m, doc, variant, place, shard = m[order], doc[order], variant[order], place[order], shard[order]
        kind = _runs(_as_rows(m))
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        least = doc[first][kind]
        before, behind = m[:, -1].astype(np.int64), m[:, -2].astype(np.int64)
        whole = doc > least
        gone = [np.stack([np.flatnonzero(whole), (place - before)[whole], (place + behind - length)[whole]])]
        # Rows of one lead that differ may share some windows: compare those window by window.
        um, udoc = m[first], doc[first]
        times = np.add.reduceat(~whole, first, dtype=np.int64) if len(first) else first
        lead = _runs(_as_rows(um[:, :LEAD]))
        alone = np.bincount(lead)[lead] == 1
        pick = np.flatnonzero(~alone)
        start = 0
        while start < len(pick):
            stop = min(start + 5_000, len(pick))
            while stop < len(pick) and lead[pick[stop]] == lead[pick[stop - 1]]:
                stop += 1
            part = pick[start:stop]
            u, shift = _window_ranks(um[part], udoc[part], lead[part], length)
            u = part[u]
            row = np.repeat(first[u] - np.concatenate([[0], np.cumsum(times[u])[:-1]]), times[u]) + np.arange(times[u].sum())
            at = place[row] + np.repeat(shift, times[u])
            gone.append(np.stack([row, at, at]))
            start = stop
        at, lo, hi = np.concatenate(gone, 1).astype(np.int64)
        order = np.argsort(shard[at], kind="stable")
        at, lo, hi = at[order], lo[order], hi[order]
        s = shard[at]
        rows = [(int(s[a]), doc[at[a:b]].astype("<i8").tobytes(), variant[at[a:b]].tobytes(), np.stack([lo[a:b], hi[a:b]], 1).astype("<i8").tobytes()) for a, b in _bounds(s)]
        return pa.Table.from_batches([_batches(rows, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["shard", "docs", "variants", "places"])])

    return found.filter("range >= 0").repartition(parts, "range").groupBy("range").applyInArrow(run, "shard int, docs binary, variants binary, places binary")


def _window_ranks(m: np.ndarray, doc: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of different rows of equal lead, ranked by distance to the suffix and bytes: (row, distance) of those that a smaller document has."""
    left = length - LEAD
    line = np.concatenate([m[:, length : length + left][:, ::-1], m[:, :length]], 1)  # bytes in text order; the suffix starts at `left`
    pre, post = m[:, -1].astype(np.int64), m[:, -2].astype(np.int64)
    size = pre + post - length + 1
    r = np.repeat(np.arange(len(m)), size)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = left - pre[r] + shift
    view = np.lib.stride_tricks.sliding_window_view(line, length, axis=1)
    body = np.zeros((len(r), 56), np.uint8)
    body[:, :length] = view[r, at]
    words = body.view(">u8").astype(np.uint64)
    rank = _ties(lead[r].astype(np.int64) * (left + 1) + at, words)
    order = np.lexsort((doc[r], rank))
    rank, r, at = rank[order], r[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    least = doc[r[head]][np.cumsum(np.concatenate([[0], rank[1:] != rank[:-1]]))] if len(rank) else doc[:0]
    late = doc[r] > least
    return r[late], at[late] - left


def _ties(rank: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ranks that rows share where they share rank and all words. Multikey: a word at a time among the rows still tied."""
    rank, tied = rank.copy(), np.arange(len(rank))
    top = int(rank.max(initial=0)) + 1
    for w in range(words.shape[1]):
        if not len(tied):
            break
        order = tied[np.lexsort((words[tied, w], rank[tied]))]
        k, x = rank[order], words[order, w]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
        rank[order] = top + np.cumsum(new)
        top += int(new.sum()) + 1
        tied = order[~(new & np.concatenate([new[1:], [True]]))]
    return rank


def removal(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    Each byte goes that a string of `length` bytes covers which also starts in a document of smaller doc_id. Texts are
    UTF-8 bytes and judged as they came; null is empty, a null doc_id is smaller than all others, and rows of one doc_id don't
    remove each other's bytes; those that differ in text are each judged by their own. Steps: every window of `length` bytes names one suffix by its least lead; hashes of the leads meet by hash
    range, and those in one document alone are done with; the others go, with the bytes of their windows, to ranges between
    splitters sampled from the leads, where they are sorted and compared. A shard sends equal rows once, so a passage that a third
    of the documents hold costs a range one row for each shard, and the windows around a lead of over HEAVY suffixes are dealt to all ranges.
    Other columns are ignored; an empty table gives an empty table.
    """
    if length < LEAD + 8 or length > 56:
        raise ValueError("length must be from 32 to 56 bytes")
    spark = docs.sparkSession
    null = -(1 << 63)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    if shards >= 1 << 26:
        raise ValueError(f"{shards} shards don't fit: raise SHARD_BYTES")
    buckets = max(16, -(-total // (8 << 20)))
    ranges = min(MOST_RANGES, max(16, -(-total // RANGE_BYTES)))
    parts = max(partitions(spark), -(-total // (32 << 20)))  # for what is dealt by shard, bucket or range
    leads_about = max(1, int(total / ((length - LEAD + 2) / 2)))
    bits = min(64, max(32, leads_about.bit_length() + 10))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("doc_id"), "text")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    found, leads_at = kept_at(leads(rows, length, buckets, bits, SAMPLED * ranges / leads_about), "suffix-leads")
    sample = b"".join(r["blob"] for r in found.filter("bucket = -1").select("blob").toLocalIterator())
    sample = np.sort(np.frombuffer(sample, f"S{LEAD}"))
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    keys, keys_at = kept_at(repeated(found, parts), "suffix-repeated")
    remove(spark, leads_at)
    rest, rest_at = kept_at(contexts(rows, keys, length, bits, splitters, ranges, parts), "suffix-contexts")
    remove(spark, keys_at)
    spans = compared(rest, length, parts).unionByName(rest.filter("range = -1").select("shard", "docs", "variants", "places"))
    spans = written(spans, "suffix-spans")
    remove(spark, rest_at)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def apply(t: pa.Table, s: pa.Table) -> pa.Table:
        doc = np.frombuffer(b"".join(s.column("docs").to_pylist()), "<i8")
        variant = np.frombuffer(b"".join(s.column("variants").to_pylist()), "<i4")
        span = np.frombuffer(b"".join(s.column("places").to_pylist()), "<i8").reshape(-1, 2)
        order = np.lexsort((span[:, 0], variant, doc))
        doc, variant, span = doc[order], variant[order], span[order]
        rows = []
        ids, texts = t.column("doc_id").to_pylist(), byte_texts(t.column("text"))
        for i, kind, text in zip(ids, _variants(ids, texts), texts, strict=True):
            a, b = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
            a, b = a + np.searchsorted(variant[a:b], kind, "left"), a + np.searchsorted(variant[a:b], kind, "right")
            kept, removed, runs = text, 0, 0
            if b > a:
                lo, hi = span[a:b, 0], np.maximum.accumulate(span[a:b, 1] + length)
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                begin, end = lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]
                if begin[0] < 0 or end[-1] > len(text):
                    keep = [(x, min(y, len(text))) for x, y in zip(begin.tolist(), end.tolist(), strict=True) if x < len(text)]
                else:
                    keep = list(zip(begin.tolist(), end.tolist(), strict=True))
                parts, at = [], 0
                for x, y in keep:
                    parts.append(text[at:x])
                    removed, at = removed + y - x, y
                kept, runs = b"".join(parts) + text[at:], len(keep)
            rows.append((None if i == null else i, len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else out.empty_table()

    return rows.repartition(parts, "shard").groupBy("shard").cogroup(spans.repartition(parts, "shard").groupBy("shard")).applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
