"""Running a stream to the end of what is available and reading its result."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from shelfmark.functions.session import work_dir

#: Files of a part that arrives as one micro-batch: four for every core, at most this many.
PART_FILES = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep operator state off the heap, with small increments per checkpoint, for streams started inside."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the parquet tables ``name*`` of a folder, each a file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}*.parquet")


def arrivals(parts: Sequence[DataFrame], folder: str, files: int | None = None) -> DataFrame:
    """A stream of ``parts`` that arrive one after the other, a micro-batch each, in the order given.

    A part is written by up to ``files`` tasks. A micro-batch is that number of files, so a part with fewer gets copies of
    an empty one before the next part is written.
    """
    spark = parts[0].sparkSession
    files = files or min(PART_FILES, 4 * spark.sparkContext.defaultParallelism)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    system = hadoop.Path(folder).getFileSystem(conf)

    def written(path: str) -> list:
        return [f.getPath() for f in system.listStatus(hadoop.Path(path)) if f.getPath().getName().endswith(".parquet")]

    parts[0].limit(0).coalesce(1).write.parquet(f"{folder}/empty")
    empty = written(f"{folder}/empty")[0]
    for no, part in enumerate(parts):
        path = f"{folder}/part={no}"
        part.coalesce(files).write.mode("append").parquet(path)
        missing = files - len(written(path)) if no < len(parts) - 1 else 0
        for i in range(missing):
            hadoop.FileUtil.copy(system, empty, system, hadoop.Path(f"{path}/empty-{i}.parquet"), False, conf)
    reader = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/part=*")


class LateRows(StreamingQueryListener):
    """What a stream reports of rows that came behind the watermark.

    ``dropped`` counts what its stateful operators turned away. Behind a partial aggregate that is fewer than the rows that
    came, so a stream that observes ``rows`` under the name ``came`` has those in ``came``.
    """

    def __init__(self):
        self.dropped = self.came = 0
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        seen = event.progress.observedMetrics.get("came")
        self.came += seen["rows"] if seen is not None else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def wait(self, seconds: float = 60.0) -> "LateRows":
        """Until the last report has arrived; reports come behind the stream."""
        if not self._ended.wait(seconds):
            raise TimeoutError("the stream has not reported its end")
        return self


@contextmanager
def late_rows(spark: SparkSession):
    """Listen to the one stream that is started inside."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def run(stream: DataFrame, handle, mode: str = "append", checkpoint: str | None = None) -> None:
    """Drain the source through ``handle(batch, batch_id)`` and stop.

    ``handle`` must give the same effect when a batch is repeated after a failure.
    """
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint or work_dir(stream.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def collect_batches(stream: DataFrame, mode: str) -> DataFrame:
    """All emitted rows with their ``batch``; every batch owns a folder it may rewrite."""
    spark = stream.sparkSession
    out = work_dir(spark, "emitted")
    run(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)


def latest(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final value per key of an update-mode stream."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")
