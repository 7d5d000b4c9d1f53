"""Token counts kept by deltas.

Changes are signed: an insert adds a document and its tokens, a delete takes them away, a revision takes the old
count away and adds the new one. Each batch is reduced to additive totals by source, language and tokenizer
version (partial sums before the shuffle, so hot sources cost nothing) and committed under its id exactly once:
a batch whose folder is complete is not written again, an incomplete one is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm.bpe import RUN_BYTES, public_path, token_counts, word_encoder
from wardline.llm.texts import map_texts

KEYS = ["source", "lang", "tokenizer"]
WHITE = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; null and empty texts have none."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


#: Tokenizer versions that are plain column expressions.
EXPRESSIONS = {"words-1": word_count, "bytes-1": byte_count}


def bpe_counts(docs: DataFrame, name: str = "n_tokens", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the number of ids of a word-level BPE vocabulary as column ``name``."""
    path = vocabulary or public_path("word_bpe_49k.json")
    start = lambda: lambda texts: {name: token_counts(word_encoder(path), texts)}
    return map_texts(docs, StructType([StructField(name, LongType())]), start, text, limit=RUN_BYTES)


def signed_changes(changes: DataFrame) -> DataFrame:
    """``op`` (insert, delete, revise), the keys, ``old_tokens`` and ``new_tokens`` as signed rows.

    Null counts are zero. A null key is a key of its own. An unknown or null ``op`` raises when it is read:
    a change that is passed over would falsify every later total.
    """
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(F.col("op"), F.lit("null"))))
    )
    old, new = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long"), F.coalesce(F.col("new_tokens"), F.lit(0)).cast("long")
    return changes.withColumn("op", known).select(
        *KEYS,
        F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long").alias("n_docs"),
        F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).otherwise(new - old).alias("n_tokens"),
    )


def totals(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """Committed batches in ``path``, one folder each, and their sum.

    ``commit`` is safe to repeat: the folder's success mark is what makes a batch count, and Spark sets it after
    the last task. A batch without rows is committed too. Batches commute, so their order does not matter.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/{batch}"

    def committed(self, batch: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(batch)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if it had been committed before."""
        if self.committed(batch):
            return False
        totals(signed_changes(changes)).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _batches(self) -> Iterator[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in store.listStatus(folder) if store.exists(folder) else []:
            name = entry.getPath().getName()
            if not name.startswith((".", "_")) and self.committed(name):
                yield name

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups whose documents have all gone are left out."""
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        folders = [self._folder(b) for b in self._batches()]
        deltas = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return totals(deltas).where("n_docs <> 0 OR n_tokens <> 0")


def counted(docs: DataFrame, texts: dict[str, Column], versions: list[str] | None = None) -> DataFrame:
    """``doc_id`` and the keys per document and tokenizer version, with the count of each of ``texts``; one read."""
    counts = F.array(*[
        F.struct(F.lit(v).alias("tokenizer"), *[EXPRESSIONS[v](text).alias(name) for name, text in texts.items()])
        for v in versions or list(EXPRESSIONS)
    ])
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select("doc_id", "source", "lang", "c.*")
