"""Session settings and the one way this library stores intermediate tables."""

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="tiebreak", master=None, **conf):
    """A session with the settings the plans are written for."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark):
    """The shared folder for stored intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tiebreak-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark, label):
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


# the job whose tables materialize writes; a thread, such as a stream's callback, has its own
_owner = ContextVar("owner", default=None)


def materialize(df: DataFrame, label="table") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several branches of one plan need the same costly frame. Unlike
    a cached frame the table survives lost executors, and unlike a checkpointed
    one it keeps column pruning, filter pushdown and file statistics. Inside a
    ``with Stored(spark)`` block the table goes at the end of the block.
    """
    if _owner.get() is not None:
        return _owner.get().write(df, label)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stored:
    """The intermediate tables of one job, below one folder that goes when they do.

    ``with Stored(spark, "job") as tables`` drops them at the end of the block, and with them what
    ``materialize`` writes meanwhile: the results must be written by then. Without the block
    the frames read from them stay usable until ``drop`` is called, on all tables or on
    those named.
    """

    def __init__(self, spark, label="tables"):
        self.spark, self.path = spark, scratch_path(spark, label)
        self._n = 0

    def write(self, df: DataFrame, label="table") -> DataFrame:
        self._n += 1
        path = f"{self.path}/{label}-{self._n}"
        df.write.parquet(path)
        frame = self.spark.read.schema(df.schema).parquet(path)
        frame._stored_at = path
        return frame

    def drop(self, *frames):
        for path in [f._stored_at for f in frames] or [self.path]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self):
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_):
        _owner.reset(self._token)
        self.drop()
