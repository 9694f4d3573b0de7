"""Confirmations of previews that expire, over whole logs and over streams.

Requests are (key, id, at, kind): a ``preview`` opens what its key holds anew, for ``SECONDS``; a ``confirm`` in that time is ``applied``, a further
one ``used``; one without an open preview is ``unknown``, as an expired preview is forgotten like one that never was.
``outcomes`` reads a log with window functions; ``stream`` does the same with a state for each key and a timer that drops it.
Requests count in order of (at, id); a request that is later than the watermark is dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECONDS = 15 * 60
LATE = "10 minutes"


def outcomes(requests: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """(id, key, outcome) of every confirmation of a log."""
    before = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == "preview", F.col("at")), ignorenulls=True).over(before)
    rows = requests.select("key", "id", "at", "kind", opened.alias("opened"), F.sum((F.col("kind") == "preview").cast("int")).over(before).alias("nth_preview"))
    of_preview = Window.partitionBy("key", "nth_preview").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.sum((F.col("kind") == "confirm").cast("int")).over(of_preview)).where("kind = 'confirm'")
    late = F.col("opened").isNull() | (F.col("at") > F.col("opened") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return rows.select("id", "key", F.when(late, "unknown").when(F.col("nth") == 1, "applied").otherwise("used").alias("outcome"))


class _Confirmations(StatefulProcessor):
    """One open preview for each key: when it was opened and whether it is used."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at double, used boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["at", "id"])  # one key's requests of one batch
        held, out = self.open.get() if self.open.exists() else None, []
        for r in requests.itertuples():
            at = r.at.timestamp()
            if r.kind == "preview":
                held = (at, False)
            elif held is None or at > held[0] + self.seconds:
                out.append((r.id, key[0], "unknown"))
            else:
                out.append((r.id, key[0], "used" if held[1] else "applied"))
                held = (held[0], True)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is not None:
            self.open.update(held)
            self.handle.registerTimer(int((held[0] + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["id", "key", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame([], columns=["id", "key", "outcome"])

    def close(self) -> None:
        pass


def stream(requests: DataFrame, seconds: int = SECONDS, late: str = LATE) -> DataFrame:
    """As ``outcomes``, of a stream. Its session needs the RocksDB state store."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    grouped = requests.select("key", "id", "at", "kind").withWatermark("at", late).groupBy("key")
    return grouped.transformWithStateInPandas(_Confirmations(seconds), f"id {kinds['id']}, key {kinds['key']}, outcome string", "Append", "EventTime")
