"""Session settings, the shared checkpoint folder, and tables that live there for a while."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", partitions: int = 8, app: str = "jetframe") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("JETFRAME_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; set below the warehouse if none is."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
        if named is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            named = f"{warehouse}/_checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its size is known to the planner."""
    return _written(df)[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, by the file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Shelf:
    """Owner of the tables an operator writes between its rounds.

    ``put`` writes a table below the shared folder and reads it back, so lineage ends there and a lost
    executor costs a reread. ``drop`` deletes tables that no later round reads; what is still on the
    shelf when ``close`` is called goes too, except the tables it is told to keep.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, *over: DataFrame | None) -> DataFrame:
        """Writes ``df``, then drops the tables it takes the place of."""
        table, path = _written(df)
        self._paths[id(table)] = (table, path)
        self.drop(*over)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self._paths:
                delete_folder(self.spark, self._paths.pop(id(table))[1])

    def close(self, *keep: DataFrame | None) -> None:
        kept = {id(k) for k in keep}
        self.drop(*[t for key, (t, _) in list(self._paths.items()) if key not in kept])


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that made them is over.

    For rounds whose tables are all written: no later query reads an earlier one's shuffles. Not for
    ``toLocalIterator``, whose jobs go on after its query counts as over.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python workers get so many rows at a time: for rows that are large themselves."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
