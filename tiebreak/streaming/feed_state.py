"""The fixture feed with keyed state: a micro-batch passes on what it changes, and nothing else.

Per fixture (both teams and the date) the state holds its first place in feed order, and the row that arrived last. It
goes when nothing of the fixture has arrived for a while: pages repeat soon after one another, while the date
of a fixture says nothing about when its page comes. No row is ever too late. One that comes after its state has gone
is passed on again, and the readers of ``feed_stream``, which take the first or the latest of what is stored, still give its place.
"""

from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.fixtures import FEED_KEY
from .feed_stream import ARRIVED

STATE = "first_order string, last_arrived bigint, last_order string, last_row string"
CHANGE = "kept_as string, arrived bigint, row string"


def _feed_order():
    """The order columns as one text that sorts like them; a page without number comes first."""
    page = F.col("page_no").cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")
    return F.concat(F.lpad(F.col("endpoint_no").cast("string"), 10, "0"), F.coalesce(F.lpad(page.cast("string"), 20, "0"), F.lit("")),
                    F.lit("."), F.lpad(F.col("item_no").cast("string"), 10, "0"))


def _changes(keep_ms):
    """Rows of one fixture that come before all seen so far, or show it otherwise than the last one did."""
    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        first, arrived, order, row = state.get if state.exists else (None, None, None, None)
        out = []
        for part in parts:
            # most fixtures have a row or two: plain values cost a fraction of what a frame does for them
            rows = list(zip(part["order"].tolist(), part["arrived"].tolist(), part["row"].tolist()))
            order_least, came, text = min(rows, key=itemgetter(0))
            if first is None or order_least < first:
                first = order_least
                out.append(("first", came, text))
            at = max(r[1] for r in rows)
            order_newest, _, text = min((r for r in rows if r[1] == at), key=itemgetter(0))
            if arrived is None or at > arrived or (at == arrived and order_newest < order):
                if text != row:
                    out.append(("latest", at, text))
                arrived, order, row = at, order_newest, text
        state.update((first, arrived, order, row))
        state.setTimeoutDuration(keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["kept_as", "arrived", "row"])
    return run


def feed_changes(feed: DataFrame, keep_ms: int) -> DataFrame:
    """The stream of changes to the flat feed: its columns, and ``kept_as``, "first" or "latest".

    State that nothing has touched for ``keep_ms`` goes with the next micro-batch.
    """
    content = F.to_json(F.struct(*(c for c in feed.columns if c != ARRIVED)), {"ignoreNullFields": "false"})
    keyed = feed.select(*FEED_KEY, _feed_order().alias("order"), F.unix_micros(ARRIVED).alias("arrived"), content.alias("row"))
    changes = keyed.groupBy(*FEED_KEY).applyInPandasWithState(
        _changes(keep_ms), CHANGE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feed.schema if f.name != ARRIVED)
    opened = changes.select("kept_as", F.timestamp_micros("arrived").alias(ARRIVED), F.from_json("row", schema).alias("r"))
    return opened.select(*(F.col(ARRIVED) if c == ARRIVED else F.col(f"r.{c}") for c in feed.columns), "kept_as")


def start_feed_state(feed: DataFrame, out, checkpoint, keep_ms=48 * 3600 * 1000, trigger=None, on_batch=None):
    """Starts the query that stores the changes of each micro-batch below ``out``, for ``read_deduped`` and ``read_latest``.

    ``on_batch(df, batch_id)`` gets the fixtures that are new or show otherwise than before.
    """
    def store(batch, batch_id):
        # overwriting the batch's own folder makes a repeated batch harmless
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if on_batch is not None:
            changed = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}")
            on_batch(changed.where("kept_as = 'latest'").drop("kept_as", ARRIVED), batch_id)

    writer = feed_changes(feed, keep_ms).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    # timeouts by the clock ask for batches without data for ever, so that a query over what is available would never end
    conf, setting = feed.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(setting, before)
