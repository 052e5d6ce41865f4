"""Tables of Parquet files that change: appends by batch, changes and removals by copy, compaction by size.

What a table holds is the newest version of its manifest: a row a file with its number of
rows that have a time, size, time bounds and the batches whose rows it holds. A version is written whole and
counts once its write is committed; files that it no longer names stay for its readers
until `vacuum`. So a reader sees all of a change or nothing, a replayed batch is known by
its number, and compaction can replace many batches' files by one. One job writes a table;
a second one that wants the same version fails and can try again.

Bounds answer questions before rows are read: a range of time reads the files that meet it,
the newest rows are looked for in the newest files first.

Defined results: rows without time are in every full read, in no range, and behind all
others in `newest`; an unknown batch of no rows is noted; a change of ids that no row has
touches no file; equal ids are changed alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import newest_partition

MANIFEST = "file string, rows long, bytes long, low timestamp_ntz, high timestamp_ntz, batches array<long>, schema string"
#: Files below this size are compacted, into files of about this size.
SMALL_BYTES = 64 << 20


@dataclass(frozen=True)
class Stored:
    """A table below `root`, whose `time` column gives the bounds of its files and whose `key` names its rows."""

    spark: SparkSession
    root: str
    time: str
    key: str = "id"

    # ---- versions ----

    def files(self) -> DataFrame:
        """The manifest's newest version; a row without file only tells the schema and batches."""
        newest = newest_partition(self.spark, f"{self.root}/manifest", "v")
        return self.spark.createDataFrame([], MANIFEST) if newest is None else self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={newest}")

    def _commit(self, manifest: DataFrame) -> None:
        newest = newest_partition(self.spark, f"{self.root}/manifest", "v", committed=False)
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/v={int(newest or -1) + 1:012d}")

    def _written(self, rows: DataFrame, batches: list[int]) -> DataFrame:
        """Write rows as new files; their manifest rows."""
        newest = newest_partition(self.spark, f"{self.root}/data", "w", committed=False)
        folder = f"{self.root}/data/w={int(newest or -1) + 1:012d}"
        rows.withColumn("_day", F.to_date(self.time)).hint("rebalance", F.col("_day")).drop("_day").write.parquet(folder)
        found = self.spark.read.schema(rows.schema).parquet(folder)
        meta = F.col("_metadata")
        facts = found.groupBy(meta["file_path"].alias("file"), meta["file_size"].alias("bytes")).agg(F.count(self.time).alias("rows"), F.min(F.col(self.time).cast("timestamp_ntz")).alias("low"), F.max(F.col(self.time).cast("timestamp_ntz")).alias("high"))
        own = {"batches": F.lit(batches).cast("array<long>"), "schema": F.lit(rows.schema.json())}
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        out = self.spark.createDataFrame(facts.withColumns(own).select(*names).collect(), MANIFEST)  # a row a file of this write
        return out if not out.isEmpty() else self.spark.createDataFrame([(None, 0, 0, None, None, batches, rows.schema.json())], MANIFEST)

    def schema(self) -> StructType | None:
        one = self.files().select("schema").first()
        return StructType.fromJson(json.loads(one["schema"])) if one else None

    # ---- reads ----

    def _rows(self, files: list[str]) -> DataFrame:
        schema = self.schema()
        if schema is None:
            raise ValueError(f"no table at {self.root}")
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _named(self, files: DataFrame) -> list[str]:
        return [r["file"] for r in files.where("file IS NOT NULL").select("file").collect()]

    def read(self, low: Column | None = None, high: Column | None = None) -> DataFrame:
        """All rows, or those of low <= time <= high, of whose files only those are read that may hold any."""
        files, time = self.files(), F.col(self.time)
        if low is not None:
            files = files.where(F.col("high") >= low)
        if high is not None:
            files = files.where(F.col("low") <= high)
        rows = self._rows(self._named(files))
        rows = rows if low is None else rows.where(time >= low)
        return rows if high is None else rows.where(time <= high)

    def count(self, low: Column, high: Column) -> int:
        """Rows of low <= time <= high: whole files by their bounds, others by reading them."""
        files = self.files().where((F.col("high") >= low) & (F.col("low") <= high))
        whole = (F.col("low") >= low) & (F.col("high") <= high)
        counted = files.where(whole).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
        cut = self._named(files.where(~whole))
        return counted["n"] + (self._rows(cut).where(F.col(self.time).between(low, high)).count() if cut else 0)

    def range_or_all(self, low: Column, high: Column, least: int) -> DataFrame:
        """Rows of the range if it has `least` of them, else all: the bounds decide before rows are read."""
        return self.read(low, high) if self.count(low, high) >= least else self.read()

    def newest(self, n: int, condition: Column | None = None) -> DataFrame:
        """The n rows of largest (time, key) that meet the condition, from the newest files on, until no other file can hold one of them."""
        files = self.files().where("file IS NOT NULL").select("file", "high").orderBy(F.desc_nulls_last("high")).collect()
        taken, step, order = 0, 1, (F.desc_nulls_last(self.time), F.desc(self.key))
        while True:
            taken = min(taken + step, len(files))
            rows = self._rows([f["file"] for f in files[:taken]])
            rows = (rows if condition is None else rows.where(condition)).orderBy(*order).limit(n)
            if taken == len(files):
                return rows
            last = rows.agg(F.count(self.time).alias("n"), F.min(F.col(self.time).cast("timestamp_ntz")).alias("t")).first()
            if last["n"] == n and (files[taken]["high"] is None or last["t"] > files[taken]["high"]):
                return rows
            step *= 2

    # ---- writes ----

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a batch's rows; a batch that is there already, also within a compacted file, is left as it is."""
        files = self.files()
        if not files.where(F.array_contains("batches", F.lit(batch_id).cast("long"))).isEmpty():
            return False
        self._commit(files.unionByName(self._written(rows, [batch_id])))
        return True

    def _rewritten(self, touched: list[str], rows: DataFrame) -> None:
        """Replace the touched files by new ones with the rows."""
        files = self.files()
        gone = files.where(F.col("file").isin(touched))
        batches = sorted({b for r in gone.select(F.explode("batches").alias("b")).distinct().collect() for b in r})
        self._commit(files.where(F.col("file").isNull() | ~F.col("file").isin(touched)).unionByName(self._written(rows, batches)))

    def _touched(self, hits: DataFrame) -> tuple[list[str], int]:
        """Files with rows of `hits` (a selection with its file), and the number of those rows."""
        found = hits.groupBy("file").agg(F.count("*").alias("n")).collect()
        return [r["file"] for r in found], sum(r["n"] for r in found)

    def change(self, changes: DataFrame) -> int:
        """Set the columns that `changes` has beside the key, one row a key; only files with such keys are rewritten. The number of rows that are changed."""
        rows = self.read()
        if not self._named(self.files()):
            return 0
        fields = [c for c in changes.columns if c != self.key]
        new = changes.select(F.col(self.key), *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("changed"))
        hits = rows.select(F.col(self.key), F.col("_metadata.file_path").alias("file")).join(new.select(self.key), self.key, "left_semi")
        touched, n = self._touched(hits)
        if touched:
            joined = self._rows(touched).join(new, self.key, "left")
            self._rewritten(touched, joined.select(*[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]))
        return n

    def remove(self, condition: Column) -> int:
        """Remove the rows that meet the condition; only their files are rewritten. The number of rows that go."""
        if not self._named(self.files()):
            return 0
        touched, n = self._touched(self.read().where(condition).select(F.col("_metadata.file_path").alias("file")))
        if touched:
            self._rewritten(touched, self._rows(touched).where(~F.coalesce(condition, F.lit(False))))
        return n

    def compact(self, small_bytes: int = SMALL_BYTES) -> int:
        """Rewrite the files below the size as few; larger ones are not read. The number of files that are replaced."""
        small = self._named(self.files().where(F.col("bytes") < small_bytes))
        if len(small) < 2:
            return 0
        self._rewritten(small, self._rows(small))
        return len(small)

    def vacuum(self) -> int:
        """Remove files that the newest version doesn't name, and older versions; no reader or writer may be at work. The number of files removed."""
        keep = {f.rpartition("/data/")[2] for f in self._named(self.files())}
        newest = newest_partition(self.spark, f"{self.root}/manifest", "v")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        n = 0
        for folder in fs.listStatus(path(f"{self.root}/data")):
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().toString()
                if name.endswith(".parquet") and name.rpartition("/data/")[2] not in keep:
                    n += bool(fs.delete(f.getPath(), False))
        for v in fs.listStatus(path(f"{self.root}/manifest")):
            if not v.getPath().toString().endswith(f"v={newest}"):
                fs.delete(v.getPath(), True)
        return n
