"""Snapshot tables laid out by the day on which their rows expire."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofweave.sources.keyed import KeyedTable

SECONDS_A_DAY = 86_400


@dataclasses.dataclass(frozen=True)
class DatedTable(KeyedTable):
    """A keyed table with a bucket per UTC day of ``until``, so that expiry meets few folders.

    A row's day must not change while its key lives. Rows that never expire
    (null) share the bucket -1. Times without a zone are taken in the session's.
    """

    until: str = "expires_at"

    def _bucket(self) -> Column:
        day = F.floor(F.unix_seconds(F.col(self.until).cast("timestamp")) / SECONDS_A_DAY)
        return F.coalesce(day, F.lit(-1)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        # A day has no bounded size, so it may be written by several tasks.
        return rows.hint("rebalance", "bucket")

    def change(
        self,
        spark: SparkSession,
        needing: Callable[[DataFrame], DataFrame],
        changed: Callable[[DataFrame], DataFrame],
        number: int,
    ) -> int:
        """Rewrite by ``changed`` the days that hold rows ``needing`` it; how many there were.

        Other days keep their folders, days without rows leave the table, and a
        repetition that finds nothing to do writes nothing. All changes show at
        once, with the manifest. ``number`` is above those of earlier writes.
        """
        folders = self._folders(spark)
        if not folders:
            return 0
        held = spark.read.parquet(*sorted(folders.values()))
        touched = [r[0] for r in needing(held).select(self._bucket().alias("bucket")).distinct().collect()]
        if not touched:
            return 0
        place = f"{self.root}/data/{number}"
        if any(folder.startswith(f"{place}/") for folder in folders.values()):
            raise ValueError(f"write {number} is part of the table already")
        rows = spark.read.schema(held.schema).parquet(*[folders[b] for b in touched])
        self._write(changed(rows), place)
        left = {b: f"{place}/bucket={b}" for b in touched if self._exists(spark, f"{place}/bucket={b}")}
        kept = {b: folder for b, folder in folders.items() if b not in touched}
        self._publish(spark, {**kept, **left}, number)
        return len(touched)
