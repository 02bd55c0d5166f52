"""Token counts: additive rollups kept up to date by signed, idempotent batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.bpe import RANKS, load
from gaugeworks.llm.common import WORD, ship_package, slices, table, word_count
from gaugeworks.operators.joins import sized_join
from gaugeworks.session import scratch_path

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_BASE = "base-"

#: Tokenizer versions of the query: words; and words with punctuation apart.
WORDS_1 = "words-1"
WORDS_2 = "words-2"


def words_2_count(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, and other printable characters."""
    pattern = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def with_bpe_count(docs: DataFrame, name: str = "n_bpe", ranks: str = RANKS) -> DataFrame:
    """Documents with the number of their whole text's ids under a rank file, null as empty.

    A column that already has the name is replaced; all others stay. For batches of a
    tokenizer's version: `inserted(with_bpe_count(docs), "byte_bpe_50k", F.col("n_bpe"))`.
    """
    ship_package(docs.sparkSession)
    kept = docs.drop(name)
    names = [*kept.columns, name]
    plain = [f"c{i}" for i in range(len(names))]  # so that names may hold anything
    at = names.index("text")
    renamed = kept.toDF(*plain[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in slices(batches):
            counts = [len(bpe.encode(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], plain)

    schema = renamed.withColumn(plain[-1], F.lit(0).cast("long")).schema
    return renamed.mapInArrow(run, schema).toDF(*names)


def inserted(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes that add documents under a tokenizer version."""
    return _changes(docs, tokenizer, 1, tokens)


def deleted(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes that take documents away, with the counts they came with."""
    return _changes(docs, tokenizer, -1, -tokens)


def revised(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Changes of the counts of documents that stay."""
    return _changes(docs, tokenizer, 0, new - old)


def _changes(docs: DataFrame, tokenizer: str, n_docs: int, n_tokens: Column) -> DataFrame:
    return docs.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(n_docs).cast("long").alias("n_docs"),
        n_tokens.cast("long").alias("n_tokens"),
    )


class TokenLedger:
    """Totals by source, language and tokenizer version below a folder on shared storage.

    Each batch is a folder of summed deltas, named by the batch. A batch counts once its
    writer has finished it, which Spark marks by a file; committing it again does nothing,
    and one that was broken off is written anew. Totals are sums over the folders that
    count, so the order of batches makes no difference. `compact` replaces many batches by
    one base, which lists those it holds.

    One writer at a time is assumed for one batch name. Null keys are keys of their own;
    null counts count as zero. An empty batch is committed like any other.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.path}/batches/{name}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def is_committed(self, batch: str) -> bool:
        jvm, files = self._files()
        done = files.exists(jvm.org.apache.hadoop.fs.Path(f"{self._folder(batch)}/_SUCCESS"))
        return done or batch in self._held_by_base()

    def _folders(self) -> list[str]:
        """Names of the folders that count, in order."""
        jvm, files = self._files()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        if not files.exists(root):
            return []
        names = [status.getPath().getName() for status in files.listStatus(root)]
        return sorted(n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self._folder(n)}/_SUCCESS")))

    def _base(self) -> str | None:
        """The newest base: its number follows the batches it holds."""
        bases = [name for name in self._folders() if name.startswith(_BASE)]
        return max(bases, key=lambda name: int(name.removeprefix(_BASE)), default=None)

    def _held_by_base(self) -> set[str]:
        base = self._base()
        if base is None:
            return set()
        return {row["batch"] for row in self.spark.read.parquet(f"{self.path}/held/{base}").collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch's changes (source, lang, tokenizer, n_docs, n_tokens), once.

        They are summed per key in each task before the shuffle, so a source with a third of
        all rows is one row per task. Returns whether the batch was new.
        """
        if not batch or "/" in batch or batch.startswith((_BASE, "_", ".")):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.is_committed(batch):
            return False
        self._summed(changes).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _summed(self, changes: DataFrame) -> DataFrame:
        summed = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")
        )
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def _counted(self) -> list[str]:
        base, held = self._base(), self._held_by_base()
        batches = [n for n in self._folders() if not n.startswith(_BASE) and n not in held]
        return batches + ([base] if base else [])

    def totals(self) -> DataFrame:
        """Current totals per key; keys that have come to nothing have no row."""
        names = self._counted()
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        return self._summed(self.spark.read.schema(_SCHEMA).parquet(*[self._folder(n) for n in names]))

    def compact(self) -> None:
        """Sum all batches into a base. The list of what it holds is written first, so the
        base counts only when both are there; batch folders stay until they are cleared."""
        names = [n for n in self._counted() if not n.startswith(_BASE)]
        held = sorted(self._held_by_base() | set(names))
        if not names:
            return
        base = f"{_BASE}{len(held)}"
        listed = self.spark.createDataFrame([(name,) for name in held], "batch string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/{base}")
        self.totals().write.mode("overwrite").parquet(self._folder(base))


def without_tables(text: Column) -> Column:
    """Text without the bars of table rows."""
    return F.regexp_replace(text, r"\|", " ")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after the life of a corpus, some of its batches repeated.

    All documents come in under one tokenizer version, then all under the next; those
    labelled as low quality are deleted under both; the bars of tables are taken out of the
    others, which revises their counts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    text, plain = F.col("text"), without_tables(F.col("text"))
    bad, good = sized_join(docs, low, ["doc_id"], "left_semi"), sized_join(docs, low, ["doc_id"], "left_anti")
    barred = good.where(F.contains("text", F.lit("|")))
    ledger = TokenLedger(spark, scratch_path(spark, "token-counts"))
    batches = [
        ("load", inserted(docs, WORDS_1, word_count(text))),
        ("retokenise", inserted(docs, WORDS_2, words_2_count(text))),
        ("clean", deleted(bad, WORDS_1, word_count(text)).unionByName(deleted(bad, WORDS_2, words_2_count(text)))),
        ("load", inserted(docs, WORDS_1, word_count(text))),
        ("plain", revised(barred, WORDS_1, word_count(text), word_count(plain)).unionByName(
            revised(barred, WORDS_2, words_2_count(text), words_2_count(plain))
        )),
        ("clean", deleted(bad, WORDS_1, word_count(text))),
    ]
    for at, (name, changes) in enumerate(batches):
        ledger.commit(name, changes)
        if at == 2:
            ledger.compact()
    return ledger.totals()


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE = {
    "op1_token_counts": f"""
WITH kept AS (
  SELECT source, lang, replace(coalesce(text, ''), '|', ' ') AS text FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)
), counted AS (
  SELECT source, lang, '{WORDS_1}' AS tokenizer, len(regexp_extract_all(text, '{WORD}')) AS n FROM kept
  UNION ALL
  SELECT source, lang, '{WORDS_2}', len(regexp_extract_all(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-`{{-~]')) FROM kept
)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM counted GROUP BY ALL""",
}
