"""Status of groups: a machine fed by a log, as keyed state of a stream or from the whole log at once.

Log: key, at (timestamp), seq (orders events of one time), kind, n, item. Kinds: ``found`` (n items are to be done: downloading,
counters start anew), ``started`` (item: processing), ``done`` (as many are processed as have been started since the
last found, so failed ones in between count), ``failed`` (changes nothing), ``finished`` (idle, no current item).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "status string, current long, processed long, total long, started_at timestamp"
#: Seconds that an item takes, as long as none is done.
PRIOR = 45.0


class _Machine:
    """One key's state; what is not after the last event that was applied is ignored, so that events come in any number of times."""

    def __init__(self, held: tuple | None):
        self.last, self.status, self.current, self.processed, self.total, self.started, self.begun = held or ((-1, -1), "idle", None, 0, 0, None, 0)

    def apply(self, at: int, seq: int, kind: str, n: int | None, item: int | None) -> None:
        if (at, seq) <= self.last:
            return
        self.last = (at, seq)
        if kind == "found":
            self.status, self.total, self.processed, self.begun, self.started = "downloading", n or 0, 0, 0, at
        elif kind == "started":
            self.status, self.current, self.begun = "processing", item, self.begun + 1
        elif kind == "done":
            self.processed = self.begun
        elif kind == "finished":
            self.status, self.current = "idle", None


_STATE = "last_at long, last_seq long, status string, current long, processed long, total long, started long, begun long"


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def track(log: DataFrame, key: str = "id") -> DataFrame:
    """A stream of key and STATUS: a row for each key that a micro-batch of the log has events of, as it is after them."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = _Machine(((s := state.get)[:2], *s[2:]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        for at, seq, kind, n, item in zip(rows["us"], rows["seq"], rows["kind"], rows["n"], rows["item"], strict=True):
            m.apply(int(at), int(seq), kind, _whole(n), _whole(item))
        state.update((*m.last, m.status, m.current, m.processed, m.total, m.started, m.begun))
        yield pd.DataFrame({key: [k[0]], "status": [m.status], "current": pd.array([m.current], "Int64"), "processed": [m.processed], "total": [m.total], "started": pd.array([m.started], "Int64")})

    rows = log.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(F.col(key).cast("long").alias(key), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), "kind", F.col("n").cast("long").alias("n"), F.col("item").cast("long").alias("item"))
    out = rows.groupBy(key).applyInPandasWithState(each, f"{key} long, status string, current long, processed long, total long, started long", _STATE, "update", GroupStateTimeout.NoTimeout)
    return out.select(key, "status", "current", "processed", "total", F.timestamp_micros("started").alias("started_at"))


def keep(tracked: DataFrame, target: str, checkpoint: str, **trigger):
    """Start a query that writes what each micro-batch changes to the folder ``target``; one run again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return tracked.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(stored: DataFrame, key: str = "id") -> DataFrame:
    """key and STATUS: the last state of each key in what ``keep`` wrote."""
    cols = ["status", "current", "processed", "total", "started_at"]
    return stored.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(key, "s.*")


def statuses(log: DataFrame, key: str = "id") -> DataFrame:
    """The same from the whole log, by grouping only: what the last events of each kind say."""
    at = F.struct("at", "seq")
    rows = log.where(F.col(key).isNotNull() & F.col("at").isNotNull())

    def last(kinds: list[str], value: Column) -> Column:
        return F.max_by(F.when(F.col("kind").isin(kinds), value), F.when(F.col("kind").isin(kinds), at))

    found = rows.where("kind = 'found'").groupBy(key).agg(F.max(at).alias("found"))
    own = rows.join(found, key, "left").withColumn("here", F.coalesce(at > F.col("found"), F.col("found").isNull()))
    done = own.where("kind = 'done' and here").groupBy(key).agg(F.max(at).alias("done"))
    name = F.when(F.col("kind") == "found", "downloading").when(F.col("kind") == "started", "processing").otherwise("idle")
    return own.join(done, key, "left").groupBy(key).agg(
        F.coalesce(last(["found", "started", "finished"], name), F.lit("idle")).alias("status"),
        last(["started", "finished"], F.when(F.col("kind") == "started", F.col("item"))).alias("current"),
        F.count_if((F.col("kind") == "started") & F.col("here") & (at < F.col("done"))).alias("processed"),
        F.coalesce(last(["found"], F.col("n")), F.lit(0)).cast("long").alias("total"), last(["found"], F.col("at")).alias("started_at"),
    )


def with_eta(status: DataFrame, as_of: Column, progress: Column | None = None) -> DataFrame:
    """Adds eta_s and eta_min (of all that is left, while items are processed and one is done) and item_eta_s (of the current item).

    An item takes as long as those before it took, or PRIOR seconds while none is done. progress: percent of the current item.
    """
    elapsed = as_of.cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    busy = (F.col("status") == "processing") & F.col("started_at").isNotNull()
    each = elapsed / F.col("processed")
    left = F.when(busy & (F.col("processed") > 0), each * (F.col("total") - F.col("processed")))
    own = F.when(F.col("processed") > 0, each).otherwise(PRIOR) * ((100 - F.coalesce(progress if progress is not None else F.lit(0), F.lit(0))) / 100.0)
    return status.withColumns({"eta_s": left.cast("long"), "eta_min": F.round(left / 60, 1), "item_eta_s": F.when((F.col("status") == "processing") & F.col("current").isNotNull(), own.cast("long"))})
