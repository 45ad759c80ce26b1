"""The stages of the pipeline against brute force on small tables with repeated, null and clashing rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from changelens.llm import decontaminate, lines, quality
from test_operators import base_counts, check_packing, components, op3_words, passages, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_rows():
    rng = np.random.default_rng(12)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, 800)] for _ in range(7)]
    whole = [" ".join(t) for t in texts]
    near = [" ".join([*t[:-1], "other"]) for t in texts]
    rows = [(1, whole[0]), (1, whole[0]), (2, near[0])]  # a repeated row and a near copy of it
    rows += [(5, whole[1]), (1, near[1])]  # a near copy whose id is that of another group's representative
    rows += [(None, whole[2]), (None, whole[2]), (None, near[2])]  # null ids only
    rows += [(None, whole[3]), (3, near[3]), (9, whole[3])]  # a copy without an id of documents with ids
    rows += [(7, whole[4]), (7, near[4])]  # one id, two texts, one group
    rows += [(8, whole[5]), (8, whole[6])]  # one id, two texts, two groups
    rows += [(20, None), (None, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return [*rows, (1, whole[0], "en", "t", len(whole[0])), *[(30, whole[6], "en", "s", 1)] * 3]


def groups(rows):
    """Groups of linked rows, by a union of all pairs; the place of a row stands in for its id."""
    by = defaultdict(list)
    for row, c in zip(rows, components(list(range(len(rows))), [slow_fingerprint(r[1]) for r in rows]), strict=True):
        by[c].append(row)
    return list(by.values())


def check_near_dedup(got, rows):
    left = list(got)
    assert not Counter(got) - Counter(rows)
    for group in groups(rows):
        kept = [x for x in left if x in group]
        assert len(kept) == 1, kept
        ids = [r[0] for r in group if r[0] is not None]
        assert kept[0][0] == min(ids, default=None)
        left.remove(kept[0])
    assert not left


@pytest.mark.parametrize("parts", [1, 5])
def test_near_dedup(spark, parts):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    check_near_dedup([tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()], rows)
    assert corpus_pipeline.near_dedup(spark, docs.filter("false"), "").count() == 0


def kept_by_rules(rows):
    """The base rules, and the one rule that the labels of the fixture teach: texts with # are bad."""
    return [r for r in rows if not base_counts(r[1])[-1] and "#" not in r[1]]


def without_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            seen[key(x)].add(r[0])
    texts = ["\n".join(x for x in (r[1] or "").split("\n") if not key(x) or len(seen[key(x)]) < least) for r in rows]
    return [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, texts, strict=True)]


def one_of_each(rows):
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups(rows)]


def without_passages(rows, items, window=13):
    wins = {tuple(w[s : s + window]) for w in (op3_words(t) for _, t in items) for s in range(len(w) - window + 1)}
    out = []
    for r, p in zip(rows, passages([x[:2] for x in rows], items), strict=True):
        text, w = r[1], op3_words(r[1])
        hit = {j for s in range(len(w) - window + 1) if tuple(w[s : s + window]) in wins for j in range(s, s + window)}
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text or "")]
        cut = set()
        for j in hit:
            cut |= set(range(at[j][0], at[j + 1][0] if j + 1 in hit else at[j][1]))
        kept = text and "".join(c for i, c in enumerate(text) if i not in cut)
        if not p[-1]:
            out.append((r[0], kept, *r[2:4], None if kept is None else len(kept)))
    return out


def corpus():
    """(documents, labels, benchmark): every stage has something to drop, and rows repeat, clash and lack ids."""
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    good, bad = [words(80) for _ in range(60)], [words(80) for _ in range(45)]
    for t in bad:
        t[5:65:3] = ["#" + w[1:] for w in t[5:65:3]]  # of the features only symbols differ
    texts = [(i, " ".join(t)) for i, t in enumerate(good)] + [(100 + i, " ".join(t)) for i, t in enumerate(bad)]
    texts += [(200 + i, " ".join(words(70)) + "\nThis site uses cookies \nlast line") for i in range(12)]
    texts += [texts[110], texts[110], (None, texts[3][1]), (300, texts[3][1]), (None, " ".join(words(90))), (3, " ".join(words(85))), (301, "too short"), (302, None)]
    texts += [(None, texts[-4][1])] * 2
    long = words(900)
    texts += [(310, " ".join(long)), (311, " ".join([*long[:-1], "other"])), (312, " ".join([*long[:400], "new", *long[401:]]))]
    quote = " ".join(long[100:130])
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)]
    return [(i, t, "en", "s", len(t or "")) for i, t in texts], labels, [("a", quote), ("b", " ".join(good[9][10:40])), ("c", None)]


def test_quality_stage_and_run(spark, tmp_path):
    rows, labels, items = corpus()
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ruled = kept_by_rules(rows)
    assert Counter(tuple(r) for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()) == Counter(ruled)
    lined = without_lines(ruled)
    alone = one_of_each(lined)
    clean = without_passages(alone, items)
    assert len(rows) > len(ruled) > len(alone) > len(clean) and sum(r[4] for r in lined) < sum(r[4] for r in ruled)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), [r[:2] for r in clean])


def test_line_and_decontamination_stages(spark, odd, tmp_path):
    rows, _, items = corpus()
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    few = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for data in (rows, few, near_rows()):
        docs = spark.createDataFrame(data, SCHEMA)
        assert Counter(tuple(r) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()) == Counter(without_lines(data))
        assert Counter(tuple(r) for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == Counter(without_passages(data, items))


def test_packed_stage(spark):
    rows = near_rows()
    check_packing(corpus_pipeline.packed(spark, spark.createDataFrame(rows, SCHEMA), "").collect(), [r[:2] for r in rows])


#: Names that operators use while they work, or for what they return.
TAKEN = (
    "row _th _h1 _h2 _id _pos _key _line _w _l _u _t _lines _hot _band _docs n_words mean_word word_chars n_symbols rule base_failed hit_spans hit_items n_hit n_items "
    "contaminated keeps N_Lines n_dropped kept_text fp root component component_id n id th m_id m_th _sj _k1 _k2 _n kept length start _at _part _rank _ld _q quality"
).split()


def test_clashing_columns(spark, tmp_path):
    rows, labels, items = corpus()
    wide = spark.createDataFrame([(*r, *[f"{c} {k}" for c in TAKEN]) for k, r in enumerate(rows)], SCHEMA + ", " + ", ".join(f"`{c}` string" for c in TAKEN)).repartition(3)
    for name, data, schema in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    key = {r[5]: r for r in map(tuple, wide.collect())}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns, name
        got = got.collect()
        assert got and len({r[5] for r in got}) == len(got), name
        assert all(tuple(r)[5:] == key[r[5]][5:] and (r[0], *r[2:4]) == (key[r[5]][0], *key[r[5]][2:4]) for r in got), name
    check_packing(corpus_pipeline.STAGES[-1][1](spark, wide, "").collect(), [r[:2] for r in rows])
    docs = wide.select("doc_id", "text", *TAKEN)
    for out, names in (
        (lines.line_dedup(docs), {"n_lines", "n_dropped", "keeps", "kept_text"}), (lines.line_dedup(docs, "first"), {"n_lines", "n_dropped", "keeps", "kept_text"}),
        (quality.apply_rules(docs, quality.DecisionList()), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"}),
        (decontaminate.find_passages(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")), {"n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated"}),
    ):
        assert len(out.columns) == len({c.lower() for c in out.columns}) and names <= set(out.columns)
        same = [c for c in docs.columns if c.lower() not in names and c != "text"]
        assert Counter(tuple(r) for r in out.select(*same).collect()) == Counter(tuple(r) for r in docs.select(*same).collect())
