"""Operator 1: quality rules as a learned decision list, on DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let, unboxed, written

SPLIT = r"[ \t\n\x0B\f\r]+"
#: Features that rules may test, in the order of the bins array.
FEATURES = ("n_words", "mean_word", "symbol_pct", "pipe_pct", "exclaim_pct", "upper_pct", "digit_pct", "repeat_pct", "unique_pct", "dup_line_pct", "words_per_line")
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.84, 0.88, 0.92, 0.95, 0.97, 0.99)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that the text holds twice or more; windows meet as 64-bit hashes."""

    def covered(h: Column) -> Column:
        def spread(s: Column) -> Column:
            again = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            )
            starts = F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p"))
            return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"), p.alias("p")))["n"]

        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(tagged, spread))

    def windows(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), covered)

    return F.when(F.size(words) >= 3, let(words, windows)).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """(row, base counts of the contract, features of the rules), row being docs' columns; null texts have no words. No shuffle."""
    t = F.col("_t")
    counted = lambda c: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))
    out = boxed(docs, F.coalesce("text", F.lit("")).alias("_t"))
    out = out.withColumn("_w", F.array_remove(F.split(t, SPLIT), ""))
    worded = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    out = out.withColumns({"_l": worded, "_u": F.array_distinct("_w")})
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "_lines": F.size("_l"),
        "_uniq": F.size("_u"),
        "_pipe": counted("|"),
        "_excl": counted("!"),
        "_up": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "_dig": F.regexp_count(t, F.lit(r"[0-9]")),
    }).drop("_t", "_w", "_l", "_u")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.lit(100.0) * a, b), F.lit(0.0)), 6)
    w, c = F.col("n_words"), F.col("word_chars")
    return out.withColumns({
        "mean_word": F.round(F.coalesce(F.try_divide(c.cast("double"), w), F.lit(0.0)), 6),
        "symbol_pct": share(F.col("n_symbols"), c), "pipe_pct": share(F.col("_pipe"), w), "exclaim_pct": share(F.col("_excl"), w),
        "upper_pct": share(F.col("_up"), c), "digit_pct": share(F.col("_dig"), c), "repeat_pct": share(F.col("n_repeat_words"), w),
        "unique_pct": share(F.col("_uniq"), w), "dup_line_pct": share(F.col("n_dup_lines"), F.col("_lines")),
        "words_per_line": F.round(F.coalesce(F.try_divide(w.cast("double"), F.col("_lines")), F.lit(0.0)), 6),
    }).drop("_lines", "_uniq", "_pipe", "_excl", "_up", "_dig")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the document, and none means that it stays."""

    rules: list[list[Condition]] = field(default_factory=list)

    def column(self) -> Column:
        """1 for the first rule, 2 for the second ...; null where none holds: one ordered CASE WHEN."""
        out = None
        for n, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column()
            out = F.when(holds, n) if out is None else out.when(holds, n)
        return F.lit(None).cast("int") if out is None else out.cast("int")

    def __str__(self) -> str:
        return "\n".join(f"{n}. reject if {' and '.join(map(str, r))}" for n, r in enumerate(self.rules, 1)) or "no rule"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 8) -> DecisionList:
    """Sequential covering on labelled statistics.

    sample bounds the labelled rows that are fitted on: a hash of doc_id chooses that many in expectation, and all where
    there are fewer. Labels other than 0 and 1 are ignored; of several labels of a document the lowest counts, and rows without
    a doc_id have none. Thresholds are quantiles of the sample. Two thirds grow a rule, condition by condition, by FOIL gain; one
    third prunes it to the prefix of best (p - n) / (p + n). A rule enters if its precision on the pruning third is at least
    min_precision and it covers at least min_covered bad documents in all; the rows that it covers leave before the next.
    All counts come from one aggregate, a row for each vector of bins, of which there are at most as many as sampled rows; the
    covering looks at that alone. No labels, or only one class: no rules.
    """
    good = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_q")).filter(F.col("doc_id").isNotNull())
    total = good.count()
    if total == 0:
        return DecisionList()
    share = min(1.0, sample / total)
    chosen = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).withColumnRenamed("doc_id", "_ld")
    chosen = F.broadcast(chosen) if total * share <= 200_000 else chosen
    rows = features(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_ld")))
    rows = written(rows.select("row.doc_id", *[F.col(f).cast("double").alias(f) for f in FEATURES], (F.lit(1) - F.col("row._q")).cast("int").alias("y")), "quality-sample")
    cuts = rows.agg(*[F.percentile_approx(f, list(QUANTILES), 2000).alias(f) for f in FEATURES]).first()
    edges = [sorted(set(cuts[f] or [])) for f in FEATURES]
    index = lambda f, at: sum(((F.col(f) > F.lit(e)).cast("int") for e in at), F.lit(0))
    bins = rows.select(F.array(*[index(f, at) for f, at in zip(FEATURES, edges, strict=True)]).alias("b"), "y", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0).alias("prune"))
    found = bins.groupBy("b", "y", "prune").agg(F.count("*").alias("n")).collect()
    b = np.array([r["b"] for r in found], np.int64).reshape(len(found), len(FEATURES))
    y, prune, n = (np.array([r[c] for r in found], np.int64) for c in ("y", "prune", "n"))
    left = np.ones(len(found), bool)

    def tally(rows: np.ndarray) -> dict[tuple[int, bool], int]:
        t = np.bincount(2 * y[rows] + prune[rows], n[rows], 4).astype(np.int64).tolist()
        return {(k // 2, bool(k % 2)): v for k, v in enumerate(t)}

    def best_condition(rows: np.ndarray):
        """The condition of the largest gain over the rows, the first of equals, with the counts and rows that it leaves; None if none gains."""
        whole, best = tally(rows), (1e-9, None)
        for f, name in enumerate(FEATURES):
            for e, edge in enumerate(edges[f]):
                for above in (False, True):
                    held = rows & ((b[:, f] > e) == above)
                    got = tally(held)
                    gain = _gain(got[1, False], got[0, False], whole[1, False], whole[0, False])
                    if gain > best[0]:
                        best = (gain + 1e-9, (Condition(name, above, edge), got, held))
        return best[1]

    done = DecisionList()
    while len(done.rules) < max_rules:
        rule, steps, rows = [], [], left
        while len(rule) < max_conditions and (step := best_condition(rows)):
            rule.append(step[0])
            steps.append(step[1:])
            rows = step[2]
            if step[1][0, False] == 0:
                break
        if not rule:
            break
        worth = [((g[1, True] - g[0, True]) / max(1, g[1, True] + g[0, True]), -k) for k, (g, _) in enumerate(steps)]
        k = -max(worth)[1]
        g, covered = steps[k]
        p, q = g[1, True], g[0, True]
        if g[1, False] + p < min_covered or p < min_precision * (p + q) or g[1, False] < min_precision * (g[1, False] + g[0, False]):
            break
        done.rules.append(rule[: k + 1])
        left = left & ~covered
    return done


def _ruled(docs: DataFrame, rules: DecisionList, min_words: int, max_repeat_pct: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return features(docs).withColumns({"base_failed": failed, "rule": rules.column()})


def passing(docs: DataFrame, rules: DecisionList, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """The rows of docs, as they are, that apply_rules marks as kept."""
    return unboxed(_ruled(docs, rules, min_words, max_repeat_pct).filter(~F.col("base_failed") & F.col("rule").isNull()), docs.columns)


def apply_rules(docs: DataFrame, rules: DecisionList, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """docs with the base counts, base_failed, rule (number of the first that holds, or null) and kept.

    Null and empty texts have no words and fail the base rules. Texts are read whole, repeated rows give repeated results, and an
    empty table gives an empty table. Other columns pass through, whatever their names; those of the names of the results are replaced.
    3-word windows are equal where their 64-bit hashes are.
    """
    out = _ruled(docs, rules, min_words, max_repeat_pct)
    counts = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule")}
    return unboxed(out, docs.columns, **counts, kept=~F.col("base_failed") & F.col("rule").isNull())


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    out = apply_rules(docs.select("doc_id", "text"), learn(docs, labels, **how))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
