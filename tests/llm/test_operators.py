"""The corpus operators against brute force on small tables and on odd ones."""

import base64
import hashlib
import io
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changelens.llm import chat, decontaminate, lines, packing, pii, quality, rollups, simhash, suffixes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(found, wanted):
    assert Counter(map(repr, found)) == Counter(map(repr, wanted))


# 1 ---------------------------------------------------------------------------------------------------------------


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_base(odd, documents):
    for df in (odd, documents):
        got = quality.apply_rules(df.select("doc_id", "text"), quality.DecisionList()).collect()
        same([(r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got], [(i, *base_counts(t)) for i, t in rows_of(df)])
        assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_quality_rules_hold_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    assert rules.rules and all(1 <= len(r) <= 3 for r in rules.rules)
    held = quality.apply_rules(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").selectExpr("quality", "rule is not null as bad").groupBy("quality", "bad").count().collect()
    n = {(r["quality"], r["bad"]): r["count"] for r in held}
    assert n.get((0, True), 0) >= 0.8 * sum(v for (q, _), v in n.items() if q == 0)
    assert n.get((1, True), 0) <= 0.01 * sum(v for (q, _), v in n.items() if q == 1)


def slow_covering(rows, prune, max_rules=8, max_conditions=3, min_precision=0.9, min_covered=8):
    """Sequential covering over the rows themselves: {feature: value} with y; prune tells which third each row is in."""
    n = len(rows)
    edges = {f: sorted({sorted(r[f] for r in rows)[max(math.ceil(q * n) - 1, 0)] for q in quality.QUANTILES}) for f in quality.FEATURES}
    count = lambda held: {(y, p): sum(rows[i]["y"] == y and prune[i] == p for i in held) for y in (0, 1) for p in (False, True)}
    holds = lambda i, c: (rows[i][c[0]] > c[2]) == c[1]
    left, done = list(range(n)), []
    while len(done) < max_rules:
        rule, steps, held = [], [], left
        while len(rule) < max_conditions:
            whole, best, most = count(held), None, 1e-9
            for f in quality.FEATURES:
                for e in edges[f]:
                    for above in (False, True):
                        got = count([i for i in held if holds(i, (f, above, e))])
                        p, q = got[1, False], got[0, False]
                        gain = p * (math.log2(p / (p + q)) - math.log2(whole[1, False] / (whole[1, False] + whole[0, False]))) if p else 0.0
                        if gain > most:
                            best, most = (f, above, e), gain + 1e-9
            if best is None:
                break
            rule.append(best)
            held = [i for i in held if holds(i, best)]
            steps.append((count(held), held))
            if steps[-1][0][0, False] == 0:
                break
        if not rule:
            break
        k = max(range(len(rule)), key=lambda k: ((steps[k][0][1, True] - steps[k][0][0, True]) / max(1, steps[k][0][1, True] + steps[k][0][0, True]), -k))
        got, held = steps[k]
        p, q, a, b = got[1, True], got[0, True], got[1, False], got[0, False]
        if a + p < min_covered or p < min_precision * (p + q) or a < min_precision * (a + b):
            break
        done.append(rule[: k + 1])
        left = [i for i in left if i not in set(held)]
    return done


def test_quality_covering_by_brute_force(spark):
    """The rules that covering the rows one by one gives, and the verdict on each document."""
    rng = np.random.default_rng(33)
    words = lambda n, m=3000: [f"w{x}" for x in rng.integers(0, m, n)]
    texts = [(i, " ".join(words(60 + i % 40)), 1) for i in range(150)]
    texts += [(200 + i, " ".join(w + "$" if j % 6 == 0 else w for j, w in enumerate(words(70))), 0) for i in range(40)]
    texts += [(300 + i, " ".join(words(80, 25)), 0) for i in range(40)]
    texts += [(400 + i, " ".join(words(70)).upper(), 0) for i in range(30)] + [(500 + i, " ".join(words(70)), 0) for i in range(6)]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    held = quality.features(docs).select("row.doc_id", "row.text", *[F.col(f).cast("double").alias(f) for f in quality.FEATURES], (F.pmod(F.xxhash64(F.lit(7), "row.doc_id"), F.lit(3)) == 0).alias("prune")).collect()
    good = {i: y for i, _, y in texts}
    rows = [{f: r[f] for f in quality.FEATURES} | {"y": 1 - good[r["doc_id"]]} for r in held]
    want = slow_covering(rows, [r["prune"] for r in held])
    rules = quality.learn(docs, labels)
    assert [[(c.feature, c.above, c.threshold) for c in r] for r in rules.rules] == want and len(want) >= 2
    verdict = {r["doc_id"]: (r["rule"], r["kept"]) for r in quality.apply_rules(docs, rules).collect()}
    for r, row in zip(held, rows, strict=True):
        first = next((k for k, rule in enumerate(want, 1) if all((row[f] > e) == above for f, above, e in rule)), None)
        assert verdict[r["doc_id"]] == (first, first is None and not base_counts(r["text"])[-1])


def test_quality_without_labels(odd, none, labels):
    assert not quality.learn(odd, labels.filter("false")).rules
    assert not quality.learn(none, labels).rules
    assert quality.apply_rules(none, quality.DecisionList()).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = {}
    for k, pattern in BASE.items():
        out[k] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(digits) <= 19 and luhn(digits) or k == "phone" and 10 <= len(digits) <= 15:
                out[k].append(m.span())
    return out


def listed(found):
    order = list(BASE)
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, order.index(k), k, e) for k, v in found.items() for s, e in v))


HARD = [
    "a@b.c@d.e x@y @z.w a..b@-.- q@r.s.t. u@v", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.2.3.255 1..2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111", "+1 (487) 555-7209 +12 +1-- +123456789012345678 +1234567890. ++49 30 1234567 +4930 1234567+1 222 333 4444",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3\" IBAN DE89 3704 0044 0532 0130 00, account no: 12345678 see https://x.example.com/a?b=c).", "\U0001f600 a@b.co \U0001f600 1.1.1.1",
]


def test_pii(spark, odd, documents):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for df in (hard, odd, documents):
        got = pii.detect(df).collect()
        want = []
        for i, t in rows_of(df):
            f = base_spans(t or "")
            want.append((i, *(len(f[k]) for k in BASE), hashlib.sha256(listed(f).encode()).hexdigest()))
        same([tuple(r)[:6] for r in got], want)
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(hard).collect()}
    shown = {x.split(":")[0]: HARD[4][int(x.split(":")[1]) : int(x.split(":")[2])] for x in spans[4].split(",")}
    assert shown["secret"] == "24be64439e3e49cf46b2d7c90f3602a3" and shown["url"] == "https://x.example.com/a?b=c"
    assert [HARD[4][int(a) : int(b)] for k, a, b in (x.split(":") for x in spans[4].split(",")) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_pii_fuzz():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1 23.+@-()0945"), 40))
        found = pii.find(text)
        assert {k: found[k] for k in BASE} == base_spans(text), text


@pytest.mark.parametrize("unit", ["://", "a://", "token=", "secret: ", "account ", "iban", "@", "a@", "+1 ", "+", "1.", "1 ", "1.2.3.", "a.", "no "])
def test_pii_takes_linear_time(unit):
    """A million characters of an anchor; the same a tenth as long tells how long that may take."""
    automaton, took = pii._automaton(), []
    for n in (100_000, 1_000_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.find(text, automaton)
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.05)


# 3 ---------------------------------------------------------------------------------------------------------------


def op3_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def passages(docs, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = op3_words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(i)
    out = []
    for d, t in docs:
        w, hit, got = op3_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    got |= wins[key]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, odd, none, block):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(["a", "b", "C", "dé"], 300))) for i in range(12)] + [(99, "x a b. " + "The quick brown fox"), (98, "aa bb")]
    items = [("1", " ".join(rng.choice(["a", "b", "c"], 16))), ("2", "the Quick brown fox"), ("10", "the quick-brown fox"), ("3", ""), ("4", None), (None, "aa bb"), ("5", " ".join(docs[0][1].split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = passages(docs, [x for x in items if x[0] is not None])
    got = decontaminate.digest(df, bench, shard_bytes=2000, block_bytes=block).collect()
    same([tuple(r) for r in got], want)
    same([tuple(r) for r in decontaminate.digest(odd, bench, block_bytes=block).collect()], passages(rows_of(odd), [x for x in items if x[0] is not None]))
    assert decontaminate.digest(none, bench).count() == 0
    assert decontaminate.digest(df, bench.filter("false")).filter("n_hit > 0").count() == 0
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert 99 not in kept and kept[98] == "aa bb"


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 2000)
    index = decontaminate.FMIndex(text, 3)
    patterns = rng.integers(1, 4, (50, 6))
    lengths = rng.integers(1, 7, 50)
    low, high = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_cut_spans():
    assert decontaminate.cut_spans("One two, three four!", [(1, 3)]) == "One  four!"


# 4 ---------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "bob", "Yo <|im_end|>"), (1, 1, "bob", "Yo <|im_end|>"), (1, None, "assistant", None), (2, 5, None, ""), (None, 1, "x", "y")] + [(3, i, "ab"[i % 2], str(i)) for i in range(150)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["speaker"], r["part"]): r for r in got}
    assert len(by) == len(got) == 3 + 1 + 1 + 6
    r = by[1, "bob", 0]
    assert r["rendered"] == "<|im_start|>user name=assistant\n<|im_end|>\n<|im_start|>user name=user\nHi<|im_end|>\n" + "<|im_start|>assistant\nYo <| im_end|><|im_end|>\n" * 2
    assert [r["rendered"][int(a) : int(b)] for a, b in (x.split(":") for x in r["mask_spans"].split(","))] == ["Yo <| im_end|><|im_end|>"] * 2
    assert [by[3, "a", p]["n_turns"] for p in range(3)] == [64, 64, 22] and by[3, "b", 2]["n_target"] == 11
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_warc_round_trip(spark, split):
    noise = np.random.default_rng(2).bytes(3000).decode("latin-1")
    rows = [(1, "u1", "same"), (7, "u7", "same"), (3, "u3", "same"), (4, None, None), (5, "u\r\n5", ""), (6, "u6", "WARC/1.1\r\n\x1f\x8b\x08 nested" + noise), (8, "u8", "é\U0001f600" * 2000)]
    got = warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), split).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(j for j, _, x in rows if (x or "") == (h or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top == i else "revisit", None if top == i else top))
    same([tuple(r) for r in got], want)


def test_warc_empty(spark):
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_owned_records_false_magic():
    record = warc.record(1, "u", b"x" * 50, None)
    junk = warc.MAGIC + b"\x00" * 20
    data = junk + warc._gzip(record) + warc._gzip(record)
    for cut in range(0, len(data), 7):
        both = [*warc.owned_records(io.BytesIO(data), len(data), 0, cut), *warc.owned_records(io.BytesIO(data), len(data), cut, len(data))]
        assert both == [record, record]


def test_owned_records_long_header():
    noise = base64.b64encode(np.random.default_rng(11).bytes(3 << 20)).decode()
    urls = ["u", "data:," + "x" * (65 << 10), "data:;base64," + noise, "v"]
    records = [warc.record(i, u, b"page %d" % i, None) for i, u in enumerate(urls)]
    data = b"".join(map(warc._gzip, records))
    for cut in (0, 1, 300, len(data) // 2, len(data) - 1):
        both = [*warc.owned_records(io.BytesIO(data), len(data), 0, cut), *warc.owned_records(io.BytesIO(data), len(data), cut, len(data))]
        assert both == records


def test_warc_long_urls(spark):
    long = "data:text/html," + "0123456789" * 20_000
    rows = [(1, "u1", "same"), (9, long + "9", "same"), (2, long, "other"), (3, None, "third")]
    got = warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), 500).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "revisit", 9), (9, "response", None), (2, "response", None), (3, "response", None)}
    assert len(got) == len(rows)


def test_warc_manifest_counts(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark.createDataFrame([(i, "u", str(i)) for i in range(20)], "page_id long, url string, html string").repartition(2), path)
    assert warc.read_archives(spark, path, manifest, 300).count() == 20
    for by in (-1, 1):
        with pytest.raises(ValueError, match="manifest"):
            warc.read_archives(spark, path, manifest.selectExpr("file", "n_bytes", f"n_records + {by} AS n_records"), 300).count()


# 6 ---------------------------------------------------------------------------------------------------------------


def removal(docs, length=50):
    low = {}
    texts = [((-1 << 63) if i is None else i, i, (t or "").encode()) for i, t in docs]
    for k, _, b in texts:
        for s in range(len(b) - length + 1):
            low[b[s : s + length]] = min(k, low.get(b[s : s + length], k))
    out = []
    for k, i, b in texts:
        cut = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if low[b[s : s + length]] < k:
                cut[s : s + length] = True
        runs = int((cut[1:] & ~cut[:-1]).sum() + cut[0])
        out.append((i, len(b), int(cut.sum()), runs, hashlib.sha256(bytes(c for c, x in zip(b, cut, strict=False) if not x)).hexdigest()))
    return out


def test_suffixes(spark, odd, none, documents, monkeypatch):
    rng = np.random.default_rng(4)
    alphabet = list("ab")
    shared = "".join(rng.choice(alphabet, 400))
    docs = [(i, "".join(rng.choice(alphabet, 200)) + shared[rng.integers(0, 200) :][: rng.integers(0, 300)] + "z" * int(rng.integers(0, 80))) for i in range(60)] + [(100, shared), (101, shared), (102, shared * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same([tuple(r) for r in suffixes.removal(df).collect()], removal(docs))
    same([tuple(r) for r in suffixes.removal(odd).collect()], removal(rows_of(odd)))
    same([tuple(r) for r in suffixes.removal(documents).collect()], removal(rows_of(documents)))
    assert suffixes.removal(none).count() == 0


def test_suffixes_of_shared_ids(spark, monkeypatch):
    rng = np.random.default_rng(14)
    some = ["".join(rng.choice(list("abc"), 120)) for _ in range(8)]
    docs = [(1, some[0] + some[1]), (5, "x" * 90 + some[0]), (5, some[2] + some[0] + "y" * 30), (5, some[2] + some[0] + "y" * 30), (5, some[3]), (5, None), (6, some[3] + some[2])]
    docs += [(None, some[4]), (None, some[4] + some[5]), (7, some[5] + some[4]), (7, some[6]), (7, some[7] + some[4] + some[6]), (8, some[7] + some[6])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in suffixes.removal(df).collect()], removal(docs))
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 300)
    same([tuple(r) for r in suffixes.removal(df).collect()], removal(docs))


@pytest.mark.parametrize("heavy", [0, 3, 40])
def test_suffixes_of_a_heavy_lead(spark, monkeypatch, heavy):
    """One lead of 24 bytes in all documents with different bytes around it, and some passages around it that repeat."""
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 500)
    rng = np.random.default_rng(22)
    some = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    lead = some(24)
    passages_ = [some(30) + lead + some(30) for _ in range(5)]
    docs = [(i, some(int(rng.integers(0, 60))) + (passages_[i % 25 // 5] if i % 5 == 0 else some(20) + lead + some(20)) + some(int(rng.integers(0, 40))) + lead) for i in range(120)]
    docs += [(200, lead * 6), (201, lead * 6), (202, "q" * 300), (203, "q" * 120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = removal(docs)
    assert sum(r[2] > 0 for r in want) > 15
    same([tuple(r) for r in suffixes.removal(df).collect()], want)


@pytest.mark.parametrize("small", [1, 16, 4096])
def test_multikey_order(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(23)
    for high, shape in ((2, (700, 5)), (1 << 40, (700, 3)), (1, (50, 2)), (3, (0, 4))):
        words = rng.integers(0, high, shape).astype(np.uint64)
        got = words[suffixes.multikey_order(words)].tolist()
        assert got == sorted(words.tolist())
    m = rng.integers(0, 256, (400, 11)).astype(np.uint8)
    more = rng.integers(-5, 5, 400)
    order = suffixes.multikey_order(suffixes._words(m[:, :1] // 64, more))
    assert [(int(a), int(b)) for a, b in zip(m[order, 0] // 64, more[order], strict=True)] == sorted((int(a) // 64, int(b)) for a, b in zip(m[:, 0], more, strict=True))


def test_ties_of_words():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            Counted.read += len(key[0])
            return np.asarray(super().__getitem__(key))

    rng = np.random.default_rng(15)
    words = rng.integers(0, 3, (3000, 7)).astype(np.uint64)
    words[:1000, 0] = np.arange(1000) + 10
    rank = rng.integers(0, 4, 3000)
    got = suffixes._ties(rank, words.view(Counted))
    keys = [(int(k), *w.tolist()) for k, w in zip(rank, words, strict=True)]
    assert len(set(zip(keys, got.tolist(), strict=True))) == len(set(keys)) == len(set(got.tolist()))
    assert Counted.read < 2 * 7 * 3000 - 2 * 6 * 1000 + 1  # rows that the first word settles are not read again
    assert len(suffixes._ties(rank[:0], words[:0])) == 0


def test_windows_of_cut_documents(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 100)
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 99, 1000).astype(np.uint8))
    seen = set()
    for data, _, start, ends in suffixes._chunks([text], 50):
        first, last, place, _ = suffixes.windows(data, ends, 50)
        for a, b, p in zip(first, last, place, strict=True):
            part = int(np.searchsorted(ends, p, "right"))
            base = (ends[part - 1] if part else 0) - start[part]
            seen |= {int(s - base) for s in range(a, b + 1)}
    assert seen == set(range(951))


# 7 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, tau=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(ids[i], low.get(find(i), ids[i]))
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash(spark, odd, none, documents):
    rng = np.random.default_rng(9)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, 800)] for _ in range(6)]
    near = [(100 - 7 * k - i, " ".join(w if j != 31 * k else "other" for j, w in enumerate(t))) for i, t in enumerate(texts) for k in range(5)]
    for df in (spark.createDataFrame(near, "doc_id long, text string"), odd, documents):
        docs = rows_of(df)
        fps = [slow_fingerprint(t) for _, t in docs]
        want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, components([i for i, _ in docs], fps), strict=True)]
        same([tuple(r) for r in simhash.near_duplicates(df).collect()], want)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [25, 4096])
def test_links(spark, most):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), False)) for b in base for _ in range(30)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for n in (1000, 10**9):
        plan = simhash.choose_partitions(np.array([simhash._signed(f) for f in fps], np.int64), n, 3)
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
        edges = simhash.links(simhash.refined(simhash.bins(df, plan), 3, most), 3, 4).collect()
        ids = list(range(len(fps)))
        at = {simhash._signed(f): i for i, f in enumerate(fps)}
        pairs, root = [(at[e["a"]], at[e["b"]]) for e in edges], list(ids)
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        assert root == components(ids, fps)


# 8 ---------------------------------------------------------------------------------------------------------------


def check_packing(got, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    want = Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for s in range(0, len(ids) // 4, 2048):
            part = ids[4 * s : 4 * (s + 2048)]
            want[i, s, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert sorted(seqs) == list(range(len(seqs)))
    return used / (2048 * max(1, len(seqs)))


def test_packing(odd, none, documents):
    check_packing(packing.pack(odd).collect(), rows_of(odd))
    assert check_packing(packing.pack(documents).collect(), rows_of(documents)) > 0.9
    assert packing.pack(none).count() == 0


def test_shortest_pack_first():
    rng = np.random.default_rng(8)
    histogram = Counter(rng.integers(1, 2049, 20_000).tolist())
    patterns = packing.shortest_pack_first(dict(histogram), 2048)
    back = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            back[x] += n
    assert back == histogram and len(patterns) <= 2 * len(histogram)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_rollups(spark, documents, labels, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in documents.collect():
        if r["doc_id"] not in toxic:
            cell = want[r["source"], r["lang"], "word_bpe_49k"]
            cell[0] += 1
            cell[1] += len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    got = rollups.maintained(documents, labels).collect()
    same([tuple(r) for r in got], [(*k, *v) for k, v in want.items()])


def test_rollup_commits(spark, odd, none, labels, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    e = "struct<source:string,lang:string,version:string,tokens:long>"
    events = spark.createDataFrame([(None, ("s", None, "v1", 5)), (("s", None, "v1", 5), ("s", None, "v1", 8)), (None, ("t", "en", "v1", None)), (None, None)], f"old {e}, new {e}")
    assert roll.commit("a", events) and not roll.commit("a", events)
    assert {tuple(r) for r in roll.totals().collect()} == {("s", None, "v1", 1, 8), ("t", "en", "v1", 1, 0)}
    assert roll.commit("b", events.filter("false")) and roll.batches() == ["a", "b"]
    with pytest.raises(ValueError):
        roll.commit("../x", events)
    assert rollups.maintained(none, labels).count() == 0
    assert sum(r["n_docs"] for r in rollups.maintained(odd, labels.filter("false")).collect()) == odd.count()


def test_rollup_races(spark, tmp_path):
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    add = lambda n: spark.createDataFrame([(None, ("s", None, "v", n))], f"old {rollups.ENTRY}, new {rollups.ENTRY}")
    total = lambda: [tuple(r) for r in roll.totals().collect()]
    assert roll.commit("a", add(5)) and not roll.commit("a", add(5)) and total() == [("s", None, "v", 1, 5)]
    # A second committer of an id that has written its delta by now: its folder must not slip into the committed one.
    rollups._summed(rollups.signed(add(5))).write.parquet(f"{tmp_path}/late")
    assert not roll._claim(f"file://{tmp_path}/late", f"{roll.path}/batch=a") and total() == [("s", None, "v", 1, 5)]
    # A job lost between its commit and the snapshot: the batch counts, once, before and after the next commit.
    rollups._summed(rollups.signed(add(7))).write.parquet(f"{roll.path}/batch=b")
    assert total() == [("s", None, "v", 2, 12)] and not roll.commit("b", add(7))
    assert roll.commit("c", add(1)) and total() == [("s", None, "v", 3, 13)] and not roll.fold()
    assert len(roll._named("snapshot")) == 2


def test_tokens_of_other_tokenizers(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(r["text"] or "").encode() for r in documents.limit(40).collect()] + [b"", b" A  b, c. ", "Ä 中文".encode()]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        cache = tokens.WordCache(public_tokenizers.path(name))
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        assert cache.by_word == by_word
        for t, got in zip(texts, cache.ids(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(t.decode(), add_special_tokens=False).ids


# 10 --------------------------------------------------------------------------------------------------------------


def line_drops(docs, least=2):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark, odd, none, documents):
    long = spark.createDataFrame([(i, "\n".join(str(j % (90 + i)) for j in range(200))) for i in range(3)], "doc_id long, text string")
    for df in (odd, documents, long):
        same([tuple(r) for r in lines.digest(df, min_docs=2).collect()], line_drops(rows_of(df)))
    assert lines.digest(none).count() == 0
    assert "kept_text" in lines.line_dedup(odd).columns and lines.line_dedup(odd).count() == odd.count()


def test_lines_first(spark):
    df = spark.createDataFrame([(2, "a\nB\nc"), (1, "A\nx"), (3, "b\nb\nd")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in lines.line_dedup(df, mode="first").collect()} == {1: "A\nx", 2: "B\nc", 3: "d"}
