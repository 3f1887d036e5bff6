"""Durable state: Parquet tables in versions, and a pointer that is replaced at once.

A commit writes all tables of a version, then moves the pointer. A crash before that leaves the old
version in force. One writer is assumed. Works on any file system that Spark reads.

What a sink has taken is appended to the version's acks, batch by batch, without writing its tables again; it is
part of the outbox as read, and goes into the next version's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import FILES, OUTBOX, VENDORS

ACKS = "sheet string, row_key string, acked string"
TABLES = {"files": FILES, "vendors": VENDORS, "outbox": OUTBOX}


class State:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """0: nothing was committed yet."""
        pointer = self._path("CURRENT")
        fs = pointer.getFileSystem(self._conf)
        if not fs.exists(pointer):
            return 0
        stream = fs.open(pointer)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], TABLES[name])
        table = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/v={n}/{name}")
        acks = self._path(f"v={n}/acks")
        if name != "outbox" or not acks.getFileSystem(self._conf).exists(acks):
            return table
        taken = self.spark.read.schema(ACKS).parquet(f"{self.folder}/v={n}/acks").distinct()
        both = table.join(taken, ["sheet", "row_key"], "left")
        return both.withColumn("synced_hash", F.coalesce("acked", "synced_hash")).select(*table.columns)

    def ack(self, rows: list[tuple[str, str, str]]) -> None:
        """(sheet, row_key, row_hash) of one batch, which the sink has now."""
        self.spark.createDataFrame(rows, ACKS).coalesce(1).write.mode("append").parquet(f"{self.folder}/v={self.version()}/acks")

    def commit(self, **changed: DataFrame) -> int:
        """A new version with the changed tables and the others as they were."""
        n = self.version() + 1
        for name in TABLES:
            table = changed[name] if name in changed else self.read(name)
            table.select(*[f.name for f in self.read(name).schema]).write.mode("overwrite").parquet(f"{self.folder}/v={n}/{name}")
        new, pointer = self._path("CURRENT.new"), self._path("CURRENT")
        stream = pointer.getFileSystem(self._conf).create(new, True)
        stream.write(bytearray(str(n).encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else pointer.getFileSystem(self._conf).getUri(), self._conf).rename(new, pointer, how)
        return n
