"""A keyed table of committed versions: batches that are whole or not there, replayed batches that change nothing.

A batch writes its rows (and the keys it removes) to folders of its own and
becomes visible with the version that lists them.  Writers that start from one
version conflict; the later one reads the new version and commits after it.
Readers take the last row of each key, as of any version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.plans.versions import Conflict, Versions

#: Times that a batch is committed anew after another writer's.
RETRIES = 20


@dataclass
class VersionedTable:
    """Rows of ``schema`` in ``folder``, one a key; columns whose names begin with ``_lw_`` are its own."""

    spark: SparkSession
    folder: str
    schema: str
    keys: Sequence[str]

    def versions(self) -> Versions:
        return Versions(self.spark, self.folder)

    def apply(self, rows: DataFrame | None = None, removed: DataFrame | None = None, new_only: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Puts ``rows`` in place of those of their keys and takes the keys of ``removed`` out; the table's version then.

        A key in both stays, with the row of ``rows``; of rows of one key in
        one batch any stays.  With ``new_only`` keys that the table has keep
        their rows.  ``batch`` is a writer's name and the number of its batch:
        one that was committed already changes nothing.
        """
        ours = f"{uuid.uuid4().hex}"
        written = {"rows": None, "removed": None}
        for _ in range(RETRIES):
            number, state = self.versions().latest()
            state = state or {"parts": [], "batches": {}}
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return number
            if rows is not None and (written["rows"] is None or new_only):
                wanted = rows.join(self._read(state).select(*self.keys), list(self.keys), "left_anti") if new_only else rows
                written["rows"] = f"rows-{ours}-{number}"
                wanted.dropDuplicates(list(self.keys)).write.mode("overwrite").parquet(f"{self.folder}/{written['rows']}")
            if removed is not None and written["removed"] is None:
                written["removed"] = f"removed-{ours}"
                removed.select(*self.keys).distinct().write.mode("overwrite").parquet(f"{self.folder}/{written['removed']}")
            batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
            try:
                self.versions().commit(number + 1, {"parts": [*state["parts"], {"at": number + 1, **written}], "batches": batches})
                return number + 1
            except Conflict:
                continue
        raise Conflict(f"{RETRIES} times: {self.folder}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, by default the last one."""
        state = self.versions().latest()[1] if version is None else self.versions().read(version)
        return self._read(state or {"parts": []})

    def _read(self, state: dict) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema)
        parts = [(p["at"], p["rows"]) for p in state["parts"] if p["rows"]]
        if not parts:
            return columns
        # Of each key the row of the last part that has it; a removal comes before its own batch's rows.
        legs = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/{path}").withColumn("_lw_at", F.lit(2 * at + 1)) for at, path in parts]
        gone = [(p["at"], p["removed"]) for p in state["parts"] if p["removed"]]
        keys = self.spark.createDataFrame([], self.schema).select(*self.keys)
        legs += [self.spark.read.schema(keys.schema).parquet(f"{self.folder}/{path}").withColumn("_lw_at", F.lit(2 * at)) for at, path in gone]
        if len(legs) == 1:
            return legs[0].drop("_lw_at")
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)
        last = whole.groupBy(*self.keys).agg(F.max_by(F.struct(*columns.columns), "_lw_at").alias("_lw_row"), F.max("_lw_at").alias("_lw_at"))
        return last.where(F.col("_lw_at") % 2 == 1).select("_lw_row.*")

    def compact(self) -> int:
        """The rows as one part, in a version of its own."""
        number, state = self.versions().latest()
        path = f"rows-{uuid.uuid4().hex}-{number}"
        self._read(state).write.parquet(f"{self.folder}/{path}")
        self.versions().commit(number + 1, state | {"parts": [{"at": number + 1, "rows": path, "removed": None}]})
        return number + 1

    def history(self) -> DataFrame:
        """version, parts, and what the last of them brought, of all versions."""
        rows = []
        for number in self.versions().numbers():
            parts = self.versions().read(number)["parts"]
            rows.append((number, len(parts), bool(parts[-1]["rows"]), bool(parts[-1]["removed"])))
        return self.spark.createDataFrame(rows, "version long, parts int, has_rows boolean, has_removals boolean")

    def follow(self, stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Upserts a stream batch by batch under a writer's name; a batch that is run again changes nothing."""
        each = lambda rows, number: self.apply(rows, batch=(name, number)) and None
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
