"""Logs of JSON lines read as they grow: good rows to a versioned table, lines that are none to a table of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.versioned import VersionedTable

REJECTED = "path string, line string, n long"


@dataclass
class LogReader:
    """Reads the files of a folder once each, in batches; what a batch gave is kept under its number.

    ``rows`` has one row a key, of the last batch that has it; ``rejects`` counts each bad line
    of each file.  A batch that runs again after a crash changes neither.
    """

    spark: SparkSession
    source: str
    folder: str
    schema: str
    keys: tuple[str, ...]
    files: int = 100

    def __post_init__(self):
        self.rows = VersionedTable(self.spark, f"{self.folder}/rows", self.schema, self.keys)
        self.rejects = VersionedTable(self.spark, f"{self.folder}/rejects", REJECTED, ("path", "line"))

    def parsed(self, lines: DataFrame) -> DataFrame:
        """path, line, row of text lines; the row is null where the line is no JSON object of the schema."""
        mark = "_lw_bad"
        row = F.from_json("value", f"{self.schema}, {mark} string", {"columnNameOfCorruptRecord": mark, "mode": "PERMISSIVE"})
        found = lines.where(F.trim("value") != "").select("path", F.col("value").alias("line"), row.alias("row"))
        whole = F.col("row").isNotNull() & F.col(f"row.{mark}").isNull() & F.col(f"row.{self.keys[0]}").isNotNull()
        return found.select("path", "line", F.when(whole, F.col("row").dropFields(mark)).alias("row"))

    def _batch(self, lines: DataFrame, number: int) -> None:
        lines.persist()
        try:
            found = self.parsed(lines)
            self.rows.apply(found.where("row is not null").select("row.*"), batch=("log", number))
            bad = found.where("row is null").groupBy("path", "line").agg(F.count("*").alias("n"))
            self.rejects.apply(bad, batch=("log", number))
        finally:
            lines.unpersist()

    def catch_up(self) -> None:
        """Reads what is new, then stops; goes on from its checkpoint the next time."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", self.files).option("recursiveFileLookup", True).text(self.source).select("value", F.col("_metadata.file_path").alias("path"))
        query = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
