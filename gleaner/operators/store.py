"""A record store of snapshots: every change makes a new snapshot and swaps a pointer, so it is atomic."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    return table.join(records.select(key), key, "left_anti").unionByName(records)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replace_document(table: DataFrame, records: DataFrame, source: str = "source_id") -> DataFrame:
    """All records of the sources in `records` give way to `records`."""
    return delete(table, records, source).unionByName(records)


def inventory_diff(actual: DataFrame, expected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and what differs: missing, unexpected or changed."""
    print_ = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias(n))
    both = print_(actual, "a").join(print_(expected, "e"), key, "full_outer")
    what = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return both.select(key, what.alias("problem")).where("problem is not null")


class SnapshotStore:
    """Records under a path of the shared file system: snapshot folders and a pointer, read and written by Spark only.

    Records have id, source_id, vector, text and metadata; the contract (dimension and what else must match) is
    kept in the pointer and checked before any use.
    """

    SCHEMA = "id string, source_id string, vector array<float>, text string, metadata map<string,string>"

    def __init__(self, spark: SparkSession, path: str, contract: dict):
        self.spark, self.path, self.contract = spark, path.rstrip("/"), contract
        found = self._pointer()
        if found is None:
            self._commit(spark.createDataFrame([], self.SCHEMA))
        elif found["contract"] != contract:
            raise ValueError(f"the store was made for {found['contract']}, not {contract}")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self) -> dict | None:
        """The newest of the numbered pointers."""
        fs, root = self._fs(f"{self.path}/pointers")
        if not fs.exists(root):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{names[-1]}").first()[0]) if names else None

    def _commit(self, table: DataFrame) -> None:
        now = self._pointer()
        n = (now["n"] if now else 0) + 1
        name = f"{n:012d}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/data/{name}")
        pointer = json.dumps({"n": n, "data": name, "contract": self.contract})
        self.spark.createDataFrame([(pointer,)], "value string").coalesce(1).write.text(f"{self.path}/staged/{name}")
        fs, source = self._fs(f"{self.path}/staged/{name}")
        _, root = self._fs(f"{self.path}/pointers")
        fs.mkdirs(root)
        if not fs.rename(source, self._fs(f"{self.path}/pointers/{n:012d}")[1]):
            raise RuntimeError("another writer was first")

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/data/{self._pointer()['data']}")

    def _checked(self, records: DataFrame) -> DataFrame:
        records = records.select("id", "source_id", F.col("vector").cast("array<float>").alias("vector"), "text", "metadata")
        bad = records.where(F.col("id").isNull() | F.col("vector").isNull() | (F.size("vector") != self.contract["dimension"]) | F.exists("vector", lambda v: v.isNull() | F.isnan(v)))
        if not bad.isEmpty():
            raise ValueError("a record has no id, or its vector has another dimension or is not finite")
        if not records.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("an id is there twice")
        return records

    def upsert(self, records: DataFrame) -> None:
        self._commit(upsert(self.table(), self._checked(records)))

    def delete(self, ids: DataFrame) -> int:
        before = self.count()
        self._commit(delete(self.table(), ids))
        return before - self.count()

    def replace_document(self, records: DataFrame) -> None:
        self._commit(replace_document(self.table(), self._checked(records)))

    def reset(self) -> None:
        self._commit(self.spark.createDataFrame([], self.SCHEMA))

    def count(self) -> int:
        return self.table().count()

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.table().join(ids.select("id").distinct(), "id", "left_semi")

    def search(self, vector: list[float], limit: int, filters: dict[str, str] | None = None) -> DataFrame:
        """id, score (cosine), rank of the best records whose metadata equals the filters; ties to the smaller id."""
        if len(vector) != self.contract["dimension"]:
            raise ValueError("the query has another dimension")
        rows = self.table()
        for k in sorted(filters or {}):
            rows = rows.where(F.col("metadata")[k] == filters[k])
        q = F.array(*[F.lit(float(v)) for v in vector])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
        v = F.col("vector")
        score = dot(v, q) / F.sqrt(dot(v, v) * sum(x * x for x in vector))
        top = rows.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        from pyspark.sql import Window

        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
