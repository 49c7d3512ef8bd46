"""Content stored by its digest, as partitioned tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.operators.common import settle

SCHEMA = "digest binary, content binary, n_bytes bigint, shard string"


@dataclass(frozen=True)
class Store:
    """A table ``digest, content, n_bytes`` below ``path``, partitioned by the first hex digits of the digest."""

    spark: SparkSession
    path: str
    bits: int = 512
    shard_digits: int = 2

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], SCHEMA)

    def _keyed(self, contents: DataFrame, column: str) -> DataFrame:
        digest = F.sha2(F.col(column), self.bits)
        return contents.where(F.col(column).isNotNull()).select(F.unhex(digest).alias("digest"), F.col(column).cast("binary").alias("content"), F.octet_length(column).cast("bigint").alias("n_bytes"), F.substring(digest, 1, self.shard_digits).alias("shard"))

    def put(self, contents: DataFrame, column: str = "content") -> DataFrame:
        """Stores content that isn't there yet, once per digest; returns ``digest`` of all of it. NULL is no content."""
        keyed = self._keyed(contents, column)
        fresh = keyed.dropDuplicates(["digest"]).join(self.rows().select("shard", "digest"), ["shard", "digest"], "left_anti")
        fresh.write.mode("append").partitionBy("shard").parquet(self.path)
        return keyed.select("digest")

    def put_as(self, contents: DataFrame, column: str = "content", expected: str = "content_id") -> DataFrame:
        """Stores content under the id it is said to have; returns ``expected`` of rows whose content has another one, none of which is stored."""
        true = F.unhex(F.sha2(F.col(column), self.bits)).eqNullSafe(F.col(expected))
        self.put(contents.where(true), column)
        return contents.where(~true & F.col(expected).isNotNull()).select(expected)

    def has(self, ids: DataFrame, column: str = "content_id") -> DataFrame:
        """``ids`` that are stored."""
        wanted = ids.withColumn("shard", F.substring(F.lower(F.hex(column)), 1, self.shard_digits))
        stored = self.rows().select("shard", F.col("digest").alias(column))
        return wanted.join(stored, ["shard", column], "left_semi").drop("shard")

    def open(self, ids: DataFrame, column: str = "content_id") -> DataFrame:
        """``digest, content`` of the ids that are stored; the shard prunes what is read."""
        wanted = ids.select(F.col(column).alias("digest")).distinct().withColumn("shard", F.substring(F.lower(F.hex("digest")), 1, self.shard_digits))
        return self.rows().join(wanted, ["shard", "digest"], "left_semi").select("digest", "content")

    def open_valid(self, ids: DataFrame, column: str = "content_id") -> DataFrame:
        """``digest, content, is_valid`` of the ids that are stored, each content hashed again as it is read; that of a damaged one is NULL."""
        valid = F.unhex(F.sha2("content", self.bits)) == F.col("digest")
        return self.open(ids, column).select("digest", F.when(valid, F.col("content")).alias("content"), valid.alias("is_valid"))

    def damaged(self) -> DataFrame:
        """``digest`` of rows whose content doesn't have it."""
        return self.rows().where(F.unhex(F.sha2("content", self.bits)) != F.col("digest")).select("digest")

    def remove(self, ids: DataFrame, column: str = "content_id") -> None:
        """Removes ids by rewriting the shards that hold them, and no others."""
        gone = ids.select(F.col(column).alias("digest")).distinct().withColumn("shard", F.substring(F.lower(F.hex("digest")), 1, self.shard_digits))
        touched = self.rows().join(gone.select("shard").distinct(), "shard", "left_semi")
        kept = settle(touched.join(gone, ["shard", "digest"], "left_anti"))
        emptied = [r[0] for r in gone.select("shard").distinct().join(kept.select("shard"), "shard", "left_anti").collect()]  # shards: 16 ** shard_digits at most
        kept.select("digest", "content", "n_bytes", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        for shard in emptied:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/shard={shard}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def open_any(stores: list[Store], ids: DataFrame, column: str = "content_id") -> DataFrame:
    """``digest, content, store_no`` from the first of several stores that has it."""
    found = reduce(DataFrame.unionByName, [s.open(ids, column).withColumn("store_no", F.lit(i)) for i, s in enumerate(stores)])
    first = F.row_number().over(Window.partitionBy("digest").orderBy("store_no"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def has_any(stores: list[Store], ids: DataFrame, column: str = "content_id") -> DataFrame:
    """``ids`` that at least one of several stores has."""
    found = reduce(DataFrame.unionByName, [s.has(ids, column).select(column) for s in stores]).distinct()
    return ids.join(found, column, "left_semi")


def remove_everywhere(stores: list[Store], ids: DataFrame, column: str = "content_id") -> None:
    """Removes ids from every store that has them."""
    for store in stores:
        store.remove(ids, column)


def distribute(contents: DataFrame, stores: list[Store], column: str = "content") -> dict[str, int | Exception]:
    """Writes content to several stores after hashing it once; per store the distinct pieces it holds of it, or why it failed.

    A store that fails doesn't keep the others from being written.
    """
    kept = contents.persist()
    done: dict[str, int | Exception] = {}
    try:
        for store in stores:
            try:
                done[store.path] = store.put(kept, column).distinct().count()
            except Exception as error:  # noqa: BLE001  # the caller decides what a failed target means
                done[store.path] = error
    finally:
        kept.unpersist()
    return done


def endpoints(text: str | None) -> list[str]:
    """Store places of a setting: one per line or comma, blanks and ``#`` lines left out."""
    lines = [x.strip() for line in (text or "").splitlines() if not line.strip().startswith("#") for x in line.split(",")]
    return [x for x in lines if x]
