"""Tables with a key that change in place: upserts, partial updates and deletes that read and write only the buckets they touch.

A table is a folder of Parquet files in a number of buckets, told by a hash of some key columns. A change collects the
numbers of its buckets (never more than the table has), reads those buckets alone, merges, and replaces them by dynamic
partition overwrite: files of other buckets keep their names and times. Every bucket holds one row that only says it is
there, so that a bucket whose rows all go is replaced too, and one that is lost is noticed.

One writer at a time. A change that is repeated gives the same table. Finished files are moved at the end: a driver that
dies then may leave some buckets changed and others not; a bucket that is missing makes every later change of it, and
missing(), say so instead of starting it anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import checkpointed

BUCKET, LIVE = "_bucket", "_live"


@dataclass(frozen=True)
class KeyedTable:
    """A table at path with one row for each value of the columns by.

    on: those of by that tell the bucket, all by default; a date or a parent's key here keeps what changes together in few
    buckets. Nulls in a key are a value of their own. Columns need an order, so none may be a map.
    """

    path: str
    by: tuple[str, ...]
    on: tuple[str, ...] = ()
    buckets: int = 64

    def __post_init__(self) -> None:
        if not self.by or not set(self.on) <= set(self.by):
            raise ValueError("a key has columns, and those of the bucket are among them")

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(self.on or self.by)), F.lit(self.buckets)).cast("int"))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table as it is now."""
        return self._stored(spark).filter(LIVE).drop(BUCKET, LIVE)

    def missing(self, spark: SparkSession) -> list[int]:
        """Buckets whose files are gone."""
        there = self._stored(spark).filter(~F.col(LIVE)).select(BUCKET).distinct().collect()
        return sorted(set(range(self.buckets)) - {r[0] for r in there})

    def _write(self, rows: DataFrame, touched: Sequence[int] | None = None) -> None:
        marks = rows.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias(BUCKET), F.lit(False).alias(LIVE))
        if touched is not None:
            marks = marks.filter(F.col(BUCKET).isin(list(touched)))
        out = rows.withColumn(LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True)
        # adaptive execution cuts large buckets and packs small ones, so that a bucket is few files
        writer = out.hint("rebalance", BUCKET).write.partitionBy(BUCKET)
        if touched is not None:
            writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes a new table; of rows with one key, the last by all columns stays. An empty one has its buckets too."""
        taken = {BUCKET, LIVE} & {c.lower() for c in rows.columns}
        if taken:
            raise ValueError(f"columns with names of the table's own: {sorted(taken)}")
        self._write(self._merged(self._bucket(rows).withColumn("_new", F.lit(True)), rows.columns, False))

    def _merged(self, both: DataFrame, columns: Sequence[str], partial: bool) -> DataFrame:
        """One row for each key: that of the change, else the old one. Rows are folded before they are exchanged, also those of a hot key."""
        rest = [c for c in columns if c not in self.by]
        row = F.struct(F.lit(0).alias("_"), *rest)
        new, old = F.max(F.when(F.col("_new"), row)), F.max(F.when(~F.col("_new"), row))
        folded = both.groupBy(BUCKET, *self.by).agg(new.alias("_n"), old.alias("_o"))

        def value(c: str) -> Column:
            n, o = F.col("_n")[c], F.col("_o")[c]
            return F.coalesce(n, o) if partial else F.when(F.col("_n").isNotNull(), n).otherwise(o)

        return folded.select(BUCKET, *(F.col(c) if c in self.by else value(c).alias(c) for c in columns))

    def _touched(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """The stored rows of the buckets of keys, and the numbers of these buckets."""
        spark = keys.sparkSession
        touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())
        stored = self._stored(spark).filter(F.col(BUCKET).isin(touched))
        lost = set(touched) - {r[0] for r in stored.filter(~F.col(LIVE)).select(BUCKET).distinct().collect()}
        if lost:
            raise RuntimeError(f"{self.path}: no files of buckets {sorted(lost)}")
        return stored.filter(LIVE).drop(LIVE), touched

    def upsert(self, new: DataFrame, partial: bool = False) -> list[int]:
        """Rows of new take the place of those with their key, or are added; of several with one key, the last by all columns.

        partial: a null in new, or a column that it lacks, keeps the old value. Without rows in new nothing is written.
        Returns the buckets that were written.
        """
        types = {f.name: f.dataType for f in self.rows(new.sparkSession).schema}
        lacking = set(types) - set(new.columns)
        if set(new.columns) - set(types) or lacking & set(self.by) or (lacking and not partial):
            raise ValueError(f"columns differ from those of the table: {sorted(set(types) ^ set(new.columns))}")
        # keys get the stored type first: hashes differ by type
        own = [(F.lit(None) if c in lacking else F.col(c)).cast(t).alias(c) for c, t in types.items()]
        change = checkpointed(self._bucket(new.select(*own)))
        stored, touched = self._touched(change)
        if touched:
            both = stored.withColumn("_new", F.lit(False)).unionByName(change.withColumn("_new", F.lit(True)))
            self._write(self._merged(both, list(types), partial), touched)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows go whose key columns equal those that keys has; it has all that tell the bucket. Returns the buckets that were written."""
        spark = keys.sparkSession
        types = {f.name: f.dataType for f in self.rows(spark).schema}
        if not set(self.on or self.by) <= set(keys.columns) <= set(self.by):
            raise ValueError(f"keys need {self.on or self.by} and no more than {self.by}")
        gone = checkpointed(self._bucket(keys.select(*(F.col(c).cast(types[c]).alias(c) for c in keys.columns)).distinct()))
        stored, touched = self._touched(gone)
        if touched:
            other = gone.select(F.col(BUCKET).alias("_gone"), *(F.col(c).alias(f"_gone_{c}") for c in keys.columns))
            same = reduce(Column.__and__, (stored[c].eqNullSafe(other[f"_gone_{c}"]) for c in keys.columns), stored[BUCKET] == other["_gone"])
            self._write(stored.join(other, same, "left_anti"), touched)
        return touched


def delete_cascade(spark: SparkSession, parents: KeyedTable, old: Column, children: Mapping[KeyedTable, Mapping[str, str]]) -> DataFrame:
    """Deletes the parents for which old is true, and before them their children, so that a run cut off can be repeated.

    children maps each table to its columns that hold the parent's key: {column of the child: column of the parent}.
    Returns the keys that went.
    """
    gone = checkpointed(parents.rows(spark).filter(old).select(*parents.by))
    for table, names in children.items():
        table.delete(gone.select(*(F.col(p).alias(c) for c, p in names.items())))
    parents.delete(gone)
    return gone
