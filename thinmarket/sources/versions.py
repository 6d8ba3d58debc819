"""Tables of one folder in committed versions, for jobs of several steps that may be stopped anywhere."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from thinmarket.session import shuffles_dropped

MANIFEST = "version long, round string, step string, table string, place int, path string"


class TableStore:
    """Named tables under ``root``, each a list of Parquet folders that are written once.

    A step writes the folders of its new rows, checks that they hold what was written, and then appends
    one file to the manifest, which names all folders of all tables as of that version. Readers take the newest version.
    So a step is either there with all its tables or not at all, and folders of a stopped step are
    never read. Appending to a table adds a folder and rewrites nothing. A (round, step) that the
    manifest has is not done again. One job at a time may publish to a root. What a write has shuffled
    is dropped when it ends, so a job of many steps holds the shuffles of one of them at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self) -> tuple[int, dict[str, list[str]]]:
        """Number and folders of the newest version; as many rows as folders come to the driver."""
        rows = self._rows()
        if rows is None:
            return 0, {}
        newest = rows.agg(F.max("version").alias("v")).first().v
        tables: dict[str, list[str]] = {}
        for r in rows.filter(F.col("version") == newest).orderBy("table", "place").collect():
            tables.setdefault(r.table, []).append(r.path)
        return newest, tables

    @property
    def version(self) -> int:
        return self._newest()[0]

    def done(self, round_id: str, step: str) -> bool:
        rows = self._rows()
        return rows is not None and not rows.filter((F.col("round") == round_id) & (F.col("step") == step)).isEmpty()

    def read(self, table: str) -> DataFrame:
        """The table as the newest version has it."""
        return self.spark.read.parquet(*self._newest()[1][table])

    def added(self, round_id: str, step: str, table: str) -> DataFrame:
        """The rows that a step wrote for a table."""
        of_step = self._rows().filter((F.col("round") == round_id) & (F.col("step") == step) & (F.col("table") == table))
        return self.spark.read.parquet(of_step.orderBy(F.desc("place")).first().path)

    def _write(self, table: str, rows: DataFrame | Sequence[DataFrame]) -> str:
        path, written = f"{self.root}/{table}/{uuid.uuid4().hex}", 0
        parts = [rows] if isinstance(rows, DataFrame) else rows
        for part in parts:
            seen = Observation()
            with shuffles_dropped(part.sparkSession):
                part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("compression", "zstd").parquet(path)
            written += seen.get["n"]
        there = self.spark.read.schema(parts[0].schema).parquet(path).count()
        if there != written:
            raise OSError(f"{path} has {there} rows of {written} written")
        return path

    def publish(self, round_id: str, step: str, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame | Sequence[DataFrame]] | None = None) -> bool:
        """Writes the tables of a step and makes them the newest version; False if the step is done already.

        Rows given in parts are written one part after the other, into one folder.
        """
        if self.done(round_id, step):
            return False
        version, tables = self._newest()
        tables = {name: list(paths) for name, paths in tables.items()}
        for name, rows in (replace or {}).items():
            tables[name] = [self._write(name, rows)]
        for name, rows in (append or {}).items():
            tables.setdefault(name, []).append(self._write(name, rows))
        listed = [(version + 1, round_id, step, name, i, path) for name, paths in tables.items() for i, path in enumerate(paths)]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return True
