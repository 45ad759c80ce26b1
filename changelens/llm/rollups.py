"""Operator 9: token counts in delta-maintained rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, fresh_path, slices, written
from .tokens import default_tokenizer, word_cache

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
ENTRY = "struct<source:string,lang:string,version:string,tokens:long>"


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_words, n_bpe) of each row, whole texts; null texts have no tokens. n_words counts runs outside ASCII white space.

    Null ids, sources and languages stay null, repeated rows are counted each, other columns are ignored, and an empty table gives an empty table.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = byte_texts(part.column(3))
                n = [len(t.split()) for t in texts]
                ids = [len(x) // 4 for x in words.ids(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "source", "lang", "n_words", "n_bpe"])
        words.settle()

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, source string, lang string, n_words long, n_bpe long")


def entry(source, lang, version, tokens):
    """What a document adds to the totals."""
    return F.struct(source.alias("source"), lang.alias("lang"), version.alias("version"), tokens.cast("long").alias("tokens"))


def signed(events: DataFrame) -> DataFrame:
    """Additive rows of events (old, new): an insert has a null old, a delete a null new, a revision both."""
    minus, plus = F.struct(F.lit(-1).cast("long").alias("sign"), F.col("old").alias("e")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("new").alias("e"))
    rows = events.select(F.explode(F.array(minus, plus)).alias("x")).filter("x.e is not null")
    return rows.select("x.e.source", "x.e.lang", "x.e.version", F.col("x.sign").alias("n_docs"), (F.col("x.sign") * F.coalesce("x.e.tokens", F.lit(0))).alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder, maintained by batches of deltas.

    A batch is aggregated to one row a key, map-side first, and written aside; the rename of its folder to that of its id, which
    fails if there is one, is the commit. So a retry, a repeated delivery or a second committer of an id changes nothing, and a job
    that dies before the rename leaves nothing that totals() reads. Each commit then adds its delta to the totals, as a new
    snapshot beside the ids that it covers; batches that no snapshot covers, as after a lost job or a race, are added by totals()
    and by the next commit. What is read is one row a key, however many batches there were.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _claim(self, stage: str, target: str) -> bool:
        """Rename stage to target, which must not exist; False, with stage removed, if it does."""
        context = self.spark.sparkContext
        jvm, fs, (_, to) = context._jvm, self._fs(stage)[0], self._fs(target)
        fs.mkdirs(to.getParent())
        how = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), context._jsc.hadoopConfiguration()).rename(self._fs(stage)[1], to, how)
        except Py4JJavaError:
            fs.delete(self._fs(stage)[1], True)
            if fs.exists(to):
                return False
            raise
        return True

    def _named(self, kind: str) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName().removeprefix(f"{kind}=") for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{kind}=")) if fs.exists(p) else []

    def batches(self) -> list[str]:
        return self._named("batch")

    def _state(self) -> tuple[int, list[str], bool, DataFrame]:
        """Number of the last snapshot, all batches, whether any is not in it, and the rows of the snapshot and of those."""
        done, now = self._named("snapshot"), self.batches()
        covered, paths = set(), []
        if done:
            at = f"{self.path}/snapshot={done[-1]}"
            covered = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{at}/covered").collect()}
            paths.append(f"{at}/totals")
        new = [f"{self.path}/batch={b}" for b in now if b not in covered]
        rows = self.spark.read.schema(DELTA).parquet(*paths, *new) if paths or new else self.spark.createDataFrame([], DELTA)
        return int(done[-1]) if done else 0, now, bool(new), rows

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; False if its id was committed before."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        if batch in self.batches():
            return False
        stage = fresh_path(self.spark, "rollup-stage")
        _summed(signed(events)).write.parquet(stage)
        if not self._claim(stage, f"{self.path}/batch={batch}"):
            return False
        self.fold()
        return True

    def fold(self) -> bool:
        """Write the totals of all committed batches as the next snapshot; False if there is nothing new or another writer was first."""
        last, now, new, rows = self._state()
        if not new:
            return False
        stage = fresh_path(self.spark, "rollup-stage")
        _summed(rows).write.parquet(f"{stage}/totals")
        self.spark.createDataFrame([(b,) for b in now], "batch string").write.parquet(f"{stage}/covered")
        return self._claim(stage, f"{self.path}/snapshot={last + 1:010d}")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens), keys without a document and a token left out; null sources and languages are keys like others."""
        return _summed(self._state()[-1]).filter("n_docs != 0 or n_tokens != 0")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def maintained(docs: DataFrame, labels: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Totals after four commits: all documents come with word counts, all are counted anew with a tokenizer, toxic ones go, and the first batch is delivered again."""
    spark = docs.sparkSession
    counts = written(count_tokens(docs, tokenizer), "token-counts")
    words = entry(F.col("source"), F.col("lang"), F.lit("words"), F.col("n_words"))
    bpe = entry(F.col("source"), F.col("lang"), F.lit("word_bpe_49k"), F.col("n_bpe"))
    none = F.lit(None).cast(ENTRY)
    load = counts.select(none.alias("old"), words.alias("new"))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    rollup = Rollup(spark, path or fresh_path(spark, "rollup"))
    rollup.commit("load", load)
    rollup.commit("retokenize", counts.select(words.alias("old"), bpe.alias("new")))
    rollup.commit("retract", counts.join(toxic, "doc_id", "left_semi").select(bpe.alias("old"), none.alias("new")))
    rollup.commit("load", load)
    return rollup.totals()
