"""Tables that streams keep up: a ring of commits, and a log-structured keyed table on it.

Everything goes through Spark's readers and writers, so any store they reach
will do. A commit is one small file in one of ``SLOTS`` numbered folders, the
version's number modulo ``SLOTS``; readers take the highest version they see.
While a slot is written anew the versions before it stand in the other slots, so
there is always a whole one, and a reader opens the same few files however many
batches there have been.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import dedupe_by_key
from ..operators.timeline import byte_ledger

SLOTS = 4


class Ring:
    """Versions of a small set of rows, the newest of which counts."""

    def __init__(self, spark: SparkSession, folder: str, shape: str):
        self.spark, self.folder, self.shape = spark, folder, f"version long, {shape}"

    def latest(self, before: int | None = None) -> list:
        """Rows of the newest version, or of the newest one below ``before``; none before the first commit."""
        try:
            rows = self.spark.read.schema(f"{self.shape}, slot int").parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        found = rows.drop("slot").collect()  # a few rows in each of SLOTS files
        newest = max((r["version"] for r in found), default=None)
        return [r for r in found if r["version"] == newest]

    def commit(self, version: int, rows: Sequence[tuple]) -> None:
        df = self.spark.createDataFrame([(version, *r) for r in rows], self.shape)
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/slot={version % SLOTS}")


class KeyedTable:
    """Latest row per key, kept as immutable runs.

    A batch is written as one new run of its own rows. Runs of a level are merged
    when there are ``fan`` of them, into one run of the next level, so a row is
    rewritten once per level and a batch never reads the whole table. The ring's
    newest version names the runs that count; what a crash leaves behind is named
    by none. Readers merge the runs by newest order.

    Expired rows go when all runs are part of a merge: before that, they still
    hide the older rows of their keys. Runs that were merged away stay for
    ``SLOTS`` versions, for readers of older ones, and are then emptied.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: Sequence[str], fan: int = 8):
        self.spark, self.folder, self.schema, self.key, self.order, self.fan = spark, folder, schema, key, list(order), fan
        self.ring = Ring(spark, f"{folder}/versions", "batch long, level int, run string, retired long")

    def runs(self) -> tuple[int, int, list[tuple[int, str]], list[tuple[str, int]]]:
        """(version, last batch, runs as (level, name), retired names with the version that retired them)."""
        rows = self.ring.latest()
        if not rows:
            return -1, -1, [], []
        live = [(r["level"], r["run"]) for r in rows if r["level"] is not None]
        return rows[0]["version"], rows[0]["batch"], live, [(r["run"], r["retired"]) for r in rows if r["retired"] is not None]

    def _read(self, names: Sequence[str]) -> DataFrame:
        paths = [f"{self.folder}/{name}" for name in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        return dedupe_by_key(rows.select(columns), self.key, self.order, [c for c in columns if c != self.key]).select(columns)

    def _write(self, rows: DataFrame, name: str) -> None:
        # sorted files let a look-up of few keys skip most of a run by its statistics
        (rows.sortWithinPartitions(self.key).write.mode("overwrite")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.folder}/{name}"))

    def latest(self, only: Column | None = None) -> DataFrame:
        """The newest row of every key, or of the keys that ``only`` allows (a condition on the key alone)."""
        rows = self._read([name for _, name in self.runs()[2]])
        return self._newest(rows if only is None else rows.filter(only))

    def add(self, batch: int, rows: DataFrame, alive: Column | None = None) -> None:
        """One batch of rows. A batch that was committed already changes nothing."""
        version, last, live, retired = self.runs()
        if batch <= last:
            return
        name = f"run-{batch}-0"
        self._write(self._newest(rows), name)
        live, gone = [(0, name), *live], []
        level = 0
        while sum(at == level for at, _ in live) >= self.fan:
            merged = [n for at, n in live if at == level]
            kept = [(at, n) for at, n in live if at != level]
            newest = self._newest(self._read(merged))
            name = f"run-{batch}-{level + 1}"
            self._write(newest if kept or alive is None else newest.filter(alive), name)
            live, gone, level = [*kept, (level + 1, name)], [*gone, *merged], level + 1
        old = [(n, since) for n, since in retired if version + 1 - since <= SLOTS]
        self._commit(version + 1, [(batch, at, n, None) for at, n in live] + [(batch, None, n, since) for n, since in old]
                     + [(batch, None, n, version + 1) for n in gone])
        for n, since in retired:
            if version + 1 - since > SLOTS:
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/{n}")

    def _commit(self, version: int, rows: list[tuple]) -> None:
        self.ring.commit(version, rows)


def cache_table(spark: SparkSession, folder: str, schema: str, key: str = "canonical_key",
                order: Sequence[str] = ("analyzed_us", "event_id"), fan: int = 8) -> KeyedTable:
    return KeyedTable(spark, folder, schema, key, order, fan)


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, reusable: Column, key: str = "canonical_key",
                order: Sequence[str] = ("analyzed_us", "event_id"), alive: Column | None = None, fan: int = 8) -> StreamingQuery:
    """Keeps a ``KeyedTable`` of the newest reusable rows; ``alive`` says which rows compaction may keep."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def add(batch: DataFrame, number: int) -> None:
        cache_table(batch.sparkSession, folder, schema, key, order, fan).add(number, batch.filter(reusable), alive)

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def account(stream: DataFrame, budget: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Running reserved amount over all rows, and the rows past the budget.

    The amount and the number of rows so far are one committed row; a batch scans
    its own rows by block and starts from there. A batch that runs again starts
    from the version below it and replaces its own rows, so the first breach stays
    where it was.
    """
    reserve = F.when(F.col("kind") == "reserve", F.col("bytes")).otherwise(0)

    def add(batch: DataFrame, number: int) -> None:
        ring = Ring(batch.sparkSession, f"{folder}/carry", "reserved long, rows long")
        before = ring.latest(before=number)
        carry, count = (before[0]["reserved"], before[0]["rows"]) if before else (0, 0)
        rows = byte_ledger(batch.withColumn("sequence", F.col("sequence") - count), 1 << 62)
        reserved = F.col("reserved") + carry
        rows.select("seq", "kind", reserved.alias("reserved"), F.when(F.col("problem").isNotNull(), F.col("problem")).when(
            (F.col("kind") == "reserve") & (reserved > budget), "over_budget").alias("problem")
        ).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        own = batch.agg(F.coalesce(F.sum(reserve), F.lit(0)).alias("reserved"), F.count(F.lit(1)).alias("rows")).first()
        ring.commit(number, [(carry + own["reserved"], count + own["rows"])])

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
