"""A table of scores by key that a stream upserts, whatever fails in between.

Each batch is written whole under its number, then committed by a marker; readers see committed
batches only, and of a key's rows the one of the latest batch. A batch that failed before its marker is
written anew when the stream starts again from its checkpoint, over what it had left; one that failed
after it is the same again. So a batch counts once. `compact` folds committed batches into one.

Defined results: rows with a null key are dropped; of a batch's rows of one key the greatest by `order`
stays, by score where there is none; a cache without committed batches is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cache_key string, score double, version long"


@dataclass(frozen=True)
class ScoreCache:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        """The numbers of the committed batches, in order; those that a compaction replaced aren't among them."""
        fs, p = self._fs("commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        base = max((int(n.removeprefix("base-")) for n in names if n.startswith("base-")), default=None)
        numbers = sorted(int(n) for n in names if n.isdigit())
        return numbers if base is None else [n for n in numbers if n > base]

    def _base(self) -> int | None:
        fs, p = self._fs("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.removeprefix("base-")) for n in names if n.startswith("base-")), default=None)

    def _commit(self, name: str) -> None:
        fs, p = self._fs(f"commits/{name}")
        fs.create(p, True).close()

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Of batch(cache_key, score and, if there is one, order), as foreachBatch calls it."""
        order = F.struct("order", "score") if "order" in batch.columns else F.struct("score")
        rows = batch.filter("cache_key is not null").groupBy("cache_key").agg(F.max(order)["score"].alias("score"))
        rows.select("cache_key", F.col("score").cast("double").alias("score")).write.mode("overwrite").parquet(f"{self.path}/rows/{batch_id}")
        self._commit(str(batch_id))

    def read(self) -> DataFrame:
        """cache_key, score, version (the number of the batch that wrote it) of each key."""
        parts = [(n, f"rows/{n}") for n in self.committed()]
        base = self._base()
        made = self.spark.createDataFrame([], SCHEMA)
        if base is not None:
            made = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/bases/{base}")
        for n, folder in parts:
            made = made.unionByName(self.spark.read.schema("cache_key string, score double").parquet(f"{self.path}/{folder}").withColumn("version", F.lit(n).cast("long")))
        last = F.max(F.struct("version", "score")).alias("last")
        return made.groupBy("cache_key").agg(last).select("cache_key", "last.score", "last.version")

    def compact(self) -> None:
        """Fold the committed batches into a base; its marker goes last, so a failure leaves all as it was."""
        if numbers := self.committed():
            self.read().write.mode("overwrite").parquet(f"{self.path}/bases/{numbers[-1]}")
            self._commit(f"base-{numbers[-1]}")

    def misses(self, asked: DataFrame) -> DataFrame:
        """The rows of asked(cache_key, ...) that have no score yet."""
        return asked.join(self.read().select("cache_key"), "cache_key", "left_anti")

    def fill(self, asked: DataFrame, score: Callable[[DataFrame], DataFrame], batch_id: int) -> DataFrame:
        """asked with its scores: those known, and those that `score` gives for the misses, which are kept."""
        self.upsert(score(self.misses(asked)).select("cache_key", "score"), batch_id)
        return asked.join(self.read().select("cache_key", "score"), "cache_key", "left")

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that upserts stream(cache_key, score[, order]); it resumes from its checkpoint."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.upsert(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
