"""Result tables that a replayed micro-batch cannot change twice.

Each micro-batch overwrites its own folder, so running a batch again gives the
same table. What the rows mean together (sum, latest value, latest group,
distinct) is an aggregation applied when reading.

Batches are kept in epochs of ``compact_every``. The first batch of an epoch
folds the epoch before it into a base, date by date, and only for dates that
epoch holds; other dates keep the base they have, which the folders' names tell::

    log/epoch=E/batch_id=N          rows of a batch, a file or a few
    base/epoch=E/date=D             rows of a date, folded up to the end of epoch E
    finished/N                      an empty file for batch N, written last

A batch reads the log of its own epoch (or the one before) and the base of the
dates it asks for, so its cost does not grow with history. Rows are clustered by date
before they are written, so a date has one file, or a few if it is large; small dates of
a batch share one, whose statistics let readers pass it over. Batch numbers follow each
other without a gap, as a stream gives them.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.runtime import listed, remove, touch

T_NULL = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a date
Fold = Callable[[DataFrame], DataFrame]
Dates = tuple[datetime.date, datetime.date]

_NUMBERS = [T.StructField("epoch", T.LongType()), T.StructField("batch_id", T.LongType())]


def summed(keys: tuple[str, ...], value: str | tuple[str, ...]) -> Fold:
    """Every batch adds to the values of its keys."""
    values = (value,) if isinstance(value, str) else value
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def latest(keys: tuple[str, ...], value: str) -> Fold:
    """The last batch to hold a key sets its value."""
    return lambda rows: rows.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def distinct(keys: tuple[str, ...]) -> Fold:
    return lambda rows: rows.select(*keys).distinct()


def latest_groups(group: tuple[str, ...]) -> Fold:
    """The last batch to hold a group replaces the group's rows."""

    def fold(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*group).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, [*group, "batch_id"], "left_semi").drop("batch_id")

    return fold


class BatchLog:
    """One such table below ``path``; ``dated`` tables have a ``date`` column.

    ``compact_every`` names folders, so it stays the same over a table's life.
    """

    def __init__(
        self,
        path: str,
        schema: T.StructType,
        fold: Fold,
        dated: bool = False,
        compact_every: int = 100,
    ):
        self.path = path.rstrip("/")
        self.schema = schema
        self.fold = fold
        self.dated = dated
        self.compact_every = compact_every

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of one batch, in place of an earlier try.

        The first batch of an epoch also folds the epoch before into the base. The
        table as it was before this batch is not touched by that.
        """
        spark = rows.sparkSession
        epoch = batch_id // self.compact_every
        own = f"epoch={epoch}/batch_id={batch_id}"
        self._save(rows.select(*self.schema.names), f"log/{own}", False)
        if batch_id % self.compact_every == 0 and epoch > 0:
            self._compact(spark, epoch - 1)
        touch(spark, f"{self.path}/finished/{batch_id}")
        if batch_id > 1:  # the one before stays, in case a reader lists the files just now
            remove(spark, f"{self.path}/finished/{batch_id - 2}")

    def current(
        self, spark: SparkSession, before: int | None = None, dates: Dates | None = None
    ) -> DataFrame:
        """The table after all finished batches, or after those before one batch."""
        return self.fold(self.rows(spark, before, dates))

    def rows(
        self, spark: SparkSession, before: int | None = None, dates: Dates | None = None
    ) -> DataFrame:
        """Stored rows with their ``batch_id``, not yet folded.

        ``dates`` limits a dated table to a range, first and last included: only the
        folders of these dates are read. In a stream all batches before the one at work are finished;
        without ``before`` the list of finished batches tells where to stop.
        """
        if before is None:
            before = self._next(spark)
        if before <= 0:
            return self._empty(spark)
        # the batch that starts an epoch still reads the epoch before as log
        base_epoch = (before - 1) // self.compact_every - 1
        parts = [
            self._log(spark, epoch)
            for epoch in range(base_epoch + 1, (before - 1) // self.compact_every + 1)
        ]
        parts = [p.where(F.col("batch_id") < before) for p in parts if p is not None]
        if base_epoch >= 0:
            parts += self._base(spark, base_epoch, dates)
        if not parts:
            return self._empty(spark)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows if dates is None else rows.where(F.col("date").between(*map(F.lit, dates)))

    def _next(self, spark: SparkSession) -> int:
        """The number after the last finished batch."""
        return max((int(name) for name in listed(spark, f"{self.path}/finished/*")), default=-2) + 1

    def _empty(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([], self.schema)
        return rows.withColumn("batch_id", F.lit(-1).cast("bigint"))

    def _save(self, rows: DataFrame, folder: str, by_date: bool) -> None:
        """Write rows clustered by date: few files, also from many tasks."""
        clustered = rows.hint("rebalance", *["date"] * self.dated)
        writer = clustered.write.mode("overwrite")
        if by_date:
            writer = writer.partitionBy("date")
        writer.parquet(f"{self.path}/{folder}")

    def _read(
        self, spark: SparkSession, kind: str, schema: T.StructType, *folders: str
    ) -> DataFrame | None:
        """Rows of some folders with the values in the folders' names; None if there are none."""
        root = f"{self.path}/{kind}"
        paths = [f"{root}/{folder}" for folder in folders] or [root]
        try:
            return spark.read.schema(schema).option("basePath", root).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _log(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        schema = T.StructType([*self.schema.fields, *_NUMBERS])
        found = self._read(spark, "log", schema, f"epoch={epoch}")
        return None if found is None else found.drop("epoch")

    def _base_folders(self, spark: SparkSession, epoch: int) -> dict[str, list[int]]:
        """date -> epochs up to this one that hold a base of it, oldest first."""
        found: dict[str, list[int]] = {}
        for folder in listed(spark, f"{self.path}/base/epoch=*/date=*", levels=2):
            number, date = (part.split("=", 1)[1] for part in folder.split("/"))
            if int(number) <= epoch:
                found.setdefault(date, []).append(int(number))
        return {date: sorted(numbers) for date, numbers in found.items()}

    def _base(self, spark: SparkSession, epoch: int, dates: Dates | None) -> list[DataFrame]:
        """The folded rows up to the end of an epoch, with the number of its last batch."""
        if self.dated:
            first, last = ("", "~") if dates is None else map(str, dates)
            folders = [
                f"epoch={numbers[-1]}/date={date}"
                for date, numbers in self._base_folders(spark, epoch).items()
                if first <= date <= last or date == T_NULL
            ]
        else:
            folders = [f"epoch={epoch}"]
        if not folders:
            return []
        schema = T.StructType([*self.schema.fields, _NUMBERS[0]])
        found = self._read(spark, "base", schema, *folders)
        if found is None:
            return []
        last = F.lit((epoch + 1) * self.compact_every - 1).cast("bigint")
        return [found.drop("epoch").withColumn("batch_id", last)]

    def _compact(self, spark: SparkSession, epoch: int) -> None:
        """Fold an epoch's log into the base of the dates it holds.

        Called by the first batch of the next epoch, which may be tried again: what it
        reads stays. The log of the epoch before that one, and bases replaced by then,
        are emptied; nobody reads them any more.
        """
        log = self._log(spark, epoch)
        if not self.dated:
            rows = self._base(spark, epoch - 1, None) if epoch else []
            rows += [] if log is None else [log]
            if not rows:
                return
            both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
            self._save(self.fold(both), f"base/epoch={epoch}", False)
            if epoch > 1:
                self._clear(spark, f"base/epoch={epoch - 2}")
        else:
            span = None if log is None else log.agg(F.min("date"), F.max("date")).first()
            if span is not None and span[0] is not None:
                held = log.select("date").distinct()
                rows = log
                for base in self._base(spark, epoch - 1, tuple(span)) if epoch else []:
                    rows = rows.unionByName(base.join(held, "date", "left_semi"))
                self._save(self.fold(rows), f"base/epoch={epoch}", True)
            # of the bases before this one, the last serves if this batch is tried again
            replaced = [
                f"base/epoch={number}/date={date}"
                for date, numbers in self._base_folders(spark, epoch - 1).items()
                for number in numbers[:-1]
            ]
            self._clear(spark, *replaced)
        if epoch > 0:
            self._clear(spark, f"log/epoch={epoch - 1}")

    def _clear(self, spark: SparkSession, *folders: str) -> None:
        """Delete folders that nobody reads any more."""
        remove(spark, *[f"{self.path}/{folder}" for folder in folders])
