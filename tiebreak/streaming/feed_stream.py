"""The fixture feed as a file stream.

Pages arrive in a landing folder per endpoint. A fixture's date says nothing about when its page
arrives, so nothing is ever too late: each micro-batch is reduced to one row per
fixture and stored, and the exact first or latest row is taken when the stored rows are read.
``compact_feed`` keeps the store small.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixtures import dedup_feed, latest_feed
from ..sources.feed import parse_feed
from ..sources.tables import path_exists

ARRIVED = "arrived"


def feed_stream(spark, paths_by_endpoint, max_files=None) -> DataFrame:
    """The flat feed as a stream over the landing folders, with the time each page ``arrived``."""
    pages = None
    for no, (_, path) in enumerate(paths_by_endpoint.items()):
        if not path_exists(spark, path):
            continue
        reader = spark.readStream
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        part = reader.text(path).select(
            "value", F.lit(no).alias("endpoint_no"), F.col("_metadata.file_modification_time").alias(ARRIVED))
        pages = part if pages is None else pages.unionByName(part)
    if pages is None:
        raise FileNotFoundError(f"no feed found, tried: {list(paths_by_endpoint.values())}")
    return parse_feed(pages)


def _reduced(feed):
    """The first and the latest row of each fixture: all that a later reduction needs."""
    return dedup_feed(feed).withColumn("kept_as", F.lit("first")).unionByName(
        latest_feed(feed, ARRIVED).withColumn("kept_as", F.lit("latest")))


def start_feed_dedup(feed: DataFrame, out, checkpoint, trigger=None, on_batch=None):
    """Starts the query that stores each micro-batch, reduced, below ``out``.

    ``on_batch(df, batch_id)`` may do more with the fixtures of a batch, such as predicting
    them. Returns the query; read the result with ``read_deduped`` or ``read_latest``.
    """
    def store(batch, batch_id):
        # overwriting the batch's own folder makes a repeated batch harmless
        _reduced(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if on_batch is not None:
            on_batch(dedup_feed(batch).drop(ARRIVED), batch_id)

    return (
        feed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def _stored(spark, out, schema, kept_as):
    path = f"{out}/batch=*"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    rows = spark.read.schema(", ".join([*columns, "kept_as string"])).parquet(path)
    return rows.where(F.col("kept_as") == kept_as).drop("kept_as")


def read_deduped(spark, out, schema) -> DataFrame:
    """The first row in feed order of each fixture as of now, as the batch operator gives it."""
    return dedup_feed(_stored(spark, out, schema, "first")).drop(ARRIVED)


def read_latest(spark, out, schema) -> DataFrame:
    """The row of each fixture in the pages that arrived last: a result shows once it is known."""
    return latest_feed(_stored(spark, out, schema, "latest"), ARRIVED).drop(ARRIVED)


def compact_feed(spark, out, schema):
    """Replaces the stored batches by one. Run it while no query writes to ``out``.

    The merged rows are written before the old folders go; a run that breaks off leaves
    repeats behind, which change no result.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.globStatus(fs_path) or []]
    if len(old) < 2:
        return
    last = max(int(p.getName().split("=")[1].split("-")[0]) for p in old)
    merged = f"{out}/batch={last}-compacted"
    if any(p.getName() == f"batch={last}-compacted" for p in old):
        merged += "-again"
    first = dedup_feed(_stored(spark, out, schema, "first")).withColumn("kept_as", F.lit("first"))
    latest = latest_feed(_stored(spark, out, schema, "latest"), ARRIVED).withColumn("kept_as", F.lit("latest"))
    first.unionByName(latest).write.parquet(merged)
    for path in old:
        fs.delete(path, True)


