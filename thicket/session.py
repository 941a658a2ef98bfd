"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library is written for. All are stock Spark options.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text packs well: a file of texts is several times larger in memory, and the
    # optimizer's own broadcast choices should know.
    "spark.sql.sources.fileCompressionFactor": "6.0",
    # A damaged text file gives replacement characters instead of a failed job.
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine, so there the
    setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="thicket-")
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Owner of the tables that ``materialize`` writes while it is open; ``drop`` deletes them.

    Frames that read such a table must have been used up, or written, before it is dropped.
    """

    _open: list[Scratch] = []

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    def drop(self) -> None:
        for spark, path in self.tables:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = []


def materialize(df: DataFrame, name: str = "step", outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The innermost open ``Scratch`` owns the table, or with ``outlives`` the one around it.

    Used where lineage must be cut (iterations) or where several consumers must
    see the very same rows (range buckets). Parquet keeps column pruning and
    gives the optimizer true sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/thicket-{name}-{uuid.uuid4().hex}"
    owners = Scratch._open[:-1] if outlives else Scratch._open
    if owners:
        owners[-1].tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
