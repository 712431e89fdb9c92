"""Tables that streams write batch by batch, so that a batch that is written again changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetspectra.sources.tables import shared_folder

BATCH, UPTO = "__batch", "__upto"


class BatchTable:
    """A table as one folder of files per micro-batch, and from time to time a snapshot of all before.

    Each batch replaces its own folder, so what a query writes again after a restart takes the place of what it had
    written, whole or in part. A folder counts once its job has finished (its ``_SUCCESS`` file). With ``keys``, a
    key's row is the one of the latest batch that has it (batches must not hold a key twice, as in update mode);
    without, all rows of all batches are the table. A snapshot is taken after every ``snapshot_every`` batches from
    the rows before it; a batch that a snapshot holds is not written again. ``clean_up`` removes what snapshots hold.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), snapshot_every: int = 50):
        self.spark, self.path, self.keys, self.snapshot_every = spark, path.rstrip("/"), list(keys), snapshot_every

    def write(self, rows: DataFrame, batch: int) -> None:
        """Put a batch in; for ``foreachBatch``."""
        last = self._snapshot()
        if last is not None and batch <= last:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.snapshot_every and (batch + 1) % self.snapshot_every == 0:
            self.take_snapshot(batch)

    def read(self) -> DataFrame:
        """The table as of the last finished batch."""
        rows = self._rows(None)
        if rows is None:
            raise ValueError(f"no finished batch in {self.path}")
        return rows.drop(BATCH)

    def take_snapshot(self, upto: int) -> None:
        """Store the table of all batches up to ``upto``; later ones are kept apart."""
        rows = self._rows(upto)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.path}/upto={upto}")

    def clean_up(self) -> None:
        """Remove the batches and snapshots that the latest snapshot holds. No reader may be at work on them."""
        last = self._snapshot()
        for kind in ("batch", "upto"):
            for number in self._finished(kind, any_state=True):
                if last is not None and (number <= last if kind == "batch" else number < last):
                    self._fs().delete(self._hadoop(f"{self.path}/{kind}={number}"), True)

    def _rows(self, upto: int | None) -> DataFrame | None:
        """Rows with their batch, up to a batch (all if None), the latest of each key."""
        last = self._snapshot(upto)
        batches = [b for b in self._finished("batch") if (last is None or b > last) and (upto is None or b <= upto)]
        parts = []
        if last is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/upto={last}"))
        if batches:
            # A folder's name gives its batch; the folders are read as one table.
            files = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in batches])
            parts.append(files.withColumnRenamed("batch", BATCH).withColumn(BATCH, F.col(BATCH).cast("bigint")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if not self.keys:
            return rows
        rest = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        newest = rows.groupBy(*self.keys).agg(
            F.max(BATCH).alias(BATCH), F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), BATCH).alias("__row")
        )
        return newest.select(*[F.col(f"`{c}`") if c in (*self.keys, BATCH) else F.col("__row")[c].alias(c) for c in rows.columns])

    def _snapshot(self, upto: int | None = None) -> int | None:
        return max((n for n in self._finished("upto") if upto is None or n <= upto), default=None)

    def _finished(self, kind: str, any_state: bool = False) -> list[int]:
        fs, root = self._fs(), self._hadoop(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in numbers if any_state or fs.exists(self._hadoop(f"{self.path}/{kind}={n}/_SUCCESS"))]

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def start_table(
    rows: DataFrame,
    table: BatchTable,
    name: str,
    mode: str = "append",
    once: bool = False,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start a query that puts each micro-batch of ``rows`` into ``table``.

    ``once`` works off what there is and ends. The query goes on from ``checkpoint``, by default a folder of its
    name under the session's shared folder.
    """
    place = checkpoint or f"{shared_folder(rows.sparkSession)}/fleetspectra-stream-{name}"
    writer = rows.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", place).foreachBatch(table.write)
    return (writer.trigger(availableNow=True) if once else writer).start()
