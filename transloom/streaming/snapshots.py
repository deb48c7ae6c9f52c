"""The latest row of each key as a table on disk that grows by its changes (T5).

    delta/batch=<n>/     the last row of each key among those of trigger n
    base/version=<n>/    the last row of each key up to trigger n, written every ``every`` triggers
    manifest/<n>         what version n consists of: one base (or none) and the deltas since, one name a line

A trigger writes its own changes, then its manifest, which appears by a rename; a reader takes the newest manifest and
sees that version whole, whatever is written meanwhile. A replayed trigger writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.session import path_exists


class LatestTable:
    """``keys`` name a row, ``order`` tells which of its versions is the last, ``columns`` are what it holds."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, columns: list[str], every: int = 50):
        self.spark, self.path, self.keys, self.order, self.columns, self.every = spark, path.rstrip("/"), keys, order, columns, every

    def latest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(self.order, *self.columns), F.col(self.order)).alias("s"))
        return last.select(*self.keys, *[F.col(f"s.{c}").alias(c) for c in (self.order, *self.columns)])

    # --- manifests -------------------------------------------------------------------------------
    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(conf)

    def _publish(self, version: int, parts: list[str]) -> None:
        Path, fs = self._fs()
        hidden, shown = Path(f"{self.path}/manifest/_{version}"), Path(f"{self.path}/manifest/{version:012d}")
        out = fs.create(hidden, True)
        out.write("\n".join(parts).encode())
        out.close()
        fs.delete(shown, False)
        if not fs.rename(hidden, shown):
            raise OSError(f"manifest {shown} could not be published")

    def _parts(self, version: int) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.path}/manifest/{version:012d}").collect()]

    def version(self) -> int | None:
        """The newest version."""
        Path, fs = self._fs()
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(Path(f"{self.path}/manifest"))]
        return max((int(n) for n in names if n.isdigit()), default=None)

    # --- rows ------------------------------------------------------------------------------------
    def _rows(self, parts: list[str]) -> DataFrame:
        columns = [*self.keys, self.order, *self.columns]
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]).select(*columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (default: the newest): one base and the deltas since, at most ``every`` of them."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version of {self.path} yet")
        return self.latest(self._rows(self._parts(version)))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        before = []
        if batch_id > 0:
            if not path_exists(self.spark, f"{self.path}/manifest/{batch_id - 1:012d}"):  # going on would lose every older row
                raise FileNotFoundError(f"version {batch_id - 1} of {self.path} is gone")
            before = self._parts(batch_id - 1)
        delta = f"delta/batch={batch_id}"
        self.latest(rows).write.mode("overwrite").parquet(f"{self.path}/{delta}")
        parts = [*before, delta]
        if (batch_id + 1) % self.every == 0:
            base = f"base/version={batch_id}"
            self.latest(self._rows(parts)).write.mode("overwrite").parquet(f"{self.path}/{base}")
            parts = [base]
        self._publish(batch_id, parts)


def upsert_latest_status(table_root: str, every: int = 50):
    """T5 ``foreachBatch`` sink: the last status per model. ``latest_status`` reads it."""
    return lambda df, batch_id: status_table(df.sparkSession, table_root, every).write(df, batch_id)


def status_table(spark: SparkSession, table_root: str, every: int = 50) -> LatestTable:
    return LatestTable(spark, table_root, ["model"], "n", ["status", "message", "progress"], every)
