"""The knowledge store: Parquet tables in hash buckets of their document, of which a change writes those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.sources.versions import Tables, Versions

TABLES = ("documents", "parents", "chunks", "vectors")


def replaced(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def forgotten(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def manifest(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("ts"), "doc_id")


def known(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (doc_id) with whether a document of that id is stored."""
    there = documents.select("doc_id").distinct().withColumn("there", F.lit(True))
    return ids.join(there, "doc_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The stored rows (chunks, parents) of the given keys; none of no keys."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def titled(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with the title of their document, or its id where it has none."""
    titles = documents.select("doc_id", F.col("title").alias("_title"))
    return rows.join(titles, "doc_id", "left").withColumn("title", F.coalesce("_title", F.col("doc_id").cast("string"))).drop("_title")


class Store:
    """The tables of the documents, in hash buckets of doc_id and in versions.

    A change rewrites the buckets that hold its documents and no other; readers see the version before it or the one after.
    Of two writers that start from one version the later gets a Conflict and leaves nothing behind. Buckets are for
    the life of a store: about as many as make a bucket of the largest table some 100 MB.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.versions = Versions(spark, path)
        number, manifest = self.versions.head()
        self.tables = Tables(self.versions, manifest.get("of", buckets))

    def version(self) -> int:
        return self.versions.head()[0]

    def table(self, name: str, ids: DataFrame | None = None) -> DataFrame | None:
        """A table as of now, or its rows of some documents, for which only their buckets are opened."""
        _, now = self.versions.head()
        if not now:
            return None
        if ids is None:
            return self.tables.read(now["tables"][name])
        return by_ids(self.tables.read(now["tables"][name], self.tables.touched(ids, "doc_id")), ids, "doc_id")

    def _change(self, base: int, now: dict, gone: DataFrame, new: dict[str, DataFrame], touched: list[int]) -> None:
        folder = self.versions.folder()
        try:
            tables = {name: self.tables.replaced(now.get("tables", {}).get(name), gone, new.get(name), touched, "doc_id", f"{folder}/{name}") for name in TABLES}
            self.versions.commit(base, now, {"of": self.tables.n, "tables": tables})
        except Exception:
            self.versions.discard(folder)
            raise

    def upsert(self, **tables: DataFrame) -> None:
        """Replaces the documents that the given tables name, in all tables at once."""
        base, now = self.versions.to_change()
        ids = tables["documents"].select("doc_id").distinct()
        self._change(base, now, ids, tables, self.tables.touched(ids, "doc_id"))

    def forget(self, ids: list[str]) -> bool:
        """Removes documents from all tables; False if none of them is there."""
        base, now = self.versions.to_change()
        if not now:
            return False
        gone = self.versions.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        touched = self.tables.touched(gone, "doc_id")
        if self.tables.read(now["tables"]["documents"], touched).join(gone, "doc_id", "left_semi").isEmpty():
            return False
        self._change(base, now, gone, {}, touched)
        return True

    def vacuum(self, keep: int = 1, age_s: float = 3600.0) -> int:
        return self.versions.vacuum(keep, age_s)

    def list_documents(self) -> DataFrame:
        return manifest(self.table("documents"))
