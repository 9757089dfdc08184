"""Ledgers as Parquet folders: appends add files, a replacement is a new folder that one small file then names.

Readers go by that file, which is exchanged in one step, so they see either the old ledgers or the new ones, all of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom import schemas as S
from promptloom.operators.ledger import latest_by_key

TABLES = {"cache_entries": S.CACHE_ENTRIES, "lookup_records": S.LOOKUP_RECORDS, "feedback_events": S.FEEDBACK_EVENTS, "active_learning_pairs": S.ACTIVE_LEARNING_PAIRS}


class Ledgers:
    """The four ledgers under one folder. Older files without newer columns read as null there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        """Folder that holds a ledger now."""
        return self._folder(name, self._versions().get(name, 0))

    def _folder(self, name: str, version: int) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.folder}/{name}.parquet" if not version else f"{self.folder}/{name}.{version}.parquet"

    def _hadoop(self, path: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, conf, target, target.getFileSystem(conf)

    def _versions(self) -> dict[str, int]:
        jvm, _, target, fs = self._hadoop(f"{self.folder}/_current.json")
        if not fs.exists(target):
            return {}
        stream = fs.open(target)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point_to(self, versions: dict[str, int]) -> None:
        jvm, conf, aside, fs = self._hadoop(f"{self.folder}/_current.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(versions, sort_keys=True).encode("utf-8")))
        stream.close()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_current.json")
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(place), over)

    def read(self, name: str) -> DataFrame:
        """All rows of a ledger; one that was never written is empty."""
        path = self.path(name)
        _, _, target, fs = self._hadoop(path)
        if not fs.exists(target):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def lookup(self, query_id: str) -> DataFrame:
        """The last row of one query id, by a filter that reaches the files."""
        return latest_by_key(self.read("lookup_records").where(F.col("query_id") == query_id), "query_id", ["created_at"])

    def entry(self, entry_id: str) -> DataFrame:
        return self.read("cache_entries").where(F.col("id") == entry_id)

    def append(self, name: str, rows: DataFrame) -> None:
        S.conform(rows, TABLES[name]).write.mode("append").parquet(self.path(name))

    def lookups(self) -> DataFrame:
        """The last row of every query id: a later write replaces an earlier one."""
        return latest_by_key(self.read("lookup_records"), "query_id", ["created_at"])

    def replace(self, ledgers: dict[str, DataFrame]) -> None:
        """Put other rows, which may derive from the old ones, in the place of some ledgers, all at once.

        The folders before the last are removed; readers that began with the last ones can go on.
        """
        before = self._versions()
        after = before | {name: before.get(name, 0) + 1 for name in ledgers}
        for name, rows in ledgers.items():
            S.conform(rows, TABLES[name]).write.mode("overwrite").parquet(self._folder(name, after[name]))
        self._point_to(after)
        for name in ledgers:
            if after[name] > 1:
                _, _, old, fs = self._hadoop(self._folder(name, after[name] - 2))
                fs.delete(old, True)
