"""Alerts that go out by count or by time, each once.

Matches of a target wait in a keyed state until there are 50, or for a second after the first of them; then all that wait go out, 50 to a payload.
Payloads are written by a sink with a commit for each epoch of the query: a payload has a key, and what was sent is noted by key, so that an
epoch that runs again sends what is missing alone.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts
from ..session import filesystem
from .tail import ROCKS, begin

PAYLOAD = "target string, delivery long, batch long, payload string"
#: Milliseconds that the first match of a delivery waits, and how often it is looked at.
WINDOW, EVERY = 1000, "1 second"


def _latest(most: int):
    """Of a task's matches the latest ``most``, with their order: were there more of one target, the older ones would be dropped anyway."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        n = 0
        for batch in batches:
            for target, item in zip(batch.column("target").to_pylist(), batch.column("item").to_pylist(), strict=True):
                own = kept.setdefault(target, [])
                own.append((n, item))
                n += 1
                if len(own) >= 2 * most:
                    del own[:-most]
        rows = [(target, n, item) for target, own in kept.items() for n, item in own[-most:]]
        if rows:
            part = TaskContext.get().partitionId()
            columns = zip(*rows, strict=True)
            target, place, item = (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays([target, pa.array([part] * len(rows), pa.int64()), place, item], ["target", "part", "place", "item"])

    return work


class Pending(StatefulProcessor):
    """Matches of a target that wait, and the number of its next delivery."""

    def __init__(self, size: int, most: int, window: int):
        self.size, self.most, self.window = size, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.next = handle.getValueState("next", "delivery long")

    def _flush(self, key: tuple, items: list[str]) -> pd.DataFrame:
        (delivery,) = self.next.get() if self.next.exists() else (0,)
        self.next.update((delivery + 1,))
        self.items.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        cut = [items[i : i + self.size] for i in range(0, len(items), self.size)]
        return pd.DataFrame([(key[0], delivery, i, '{"entries":[' + ",".join(c) + "]}") for i, c in enumerate(cut)], columns=["target", "delivery", "batch", "payload"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(tuple(r) for frame in rows for r in frame[["part", "place", "item"]].itertuples(index=False))
        items = ([x for (x,) in self.items.get()] if self.items.exists() else []) + [x for _, _, x in new]
        items = items[-self.most :]
        if len(items) >= self.size:
            yield self._flush(key, items)
            return
        self.items.put([(x,) for x in items])
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.items.exists():
            yield self._flush(key, [x for (x,) in self.items.get()])

    def close(self) -> None:
        pass


def payloads(matched: DataFrame, target: Column, size: int = alerts.BATCH, most: int = alerts.BACKLOG, window: int = WINDOW) -> DataFrame:
    """target, delivery, batch and payload of a stream of matched entries, by count or by time; see :data:`PAYLOAD`.

    A delivery goes out once ``size`` matches wait, or ``window`` milliseconds after the first; of more than ``most`` that wait the oldest are dropped.
    """
    matched.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    items = alerts.payload_items(matched).select(target.cast("string").alias("target"), F.to_json("item", {"ignoreNullFields": "false"}).alias("item"))
    few = items.mapInArrow(_latest(most), "target string, part long, place long, item string")
    return few.groupBy("target").transformWithStateInPandas(statefulProcessor=Pending(size, most, window), outputStructType=PAYLOAD, outputMode="Append", timeMode="ProcessingTime")


@dataclass
class Written(WriterCommitMessage):
    rows: list[tuple[str, int, int, str]]


class DeliveryWriter(DataSourceStreamWriter):
    """Tasks hand their payloads over; the commit of an epoch sends them, in order, and notes each that was sent."""

    def __init__(self, send: Callable[[str, str, str], None], ledger: str):
        self.send, self.ledger = send, ledger

    def write(self, iterator) -> Written:
        return Written([(r.target, r.delivery, r.batch, r.payload) for r in iterator])

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, base = filesystem(self.ledger)
        system.create_dir(base, recursive=True)
        for target, delivery, batch, payload in sorted(r for m in messages if m for r in m.rows):
            key = f"{target}#{delivery}.{batch}"
            note = posixpath.join(base, key.encode().hex())
            if system.get_file_info(note).is_file:
                continue
            self.send(target, key, payload)
            with system.open_output_stream(note) as f:
                f.write(json.dumps({"key": key, "epoch": batchId}).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Nothing was sent yet: payloads go out in commits alone."""


def sink(send: Callable[[str, str, str], None], ledger: str) -> type[DataSource]:
    """A streaming sink, to be registered with Spark, that calls ``send`` (target, key, payload) once for each payload.

    ``ledger`` is a folder for the keys of what was sent.  If ``send`` returns and its note is lost before it is written, the payload
    goes out again with the same key.
    """

    class Deliveries(DataSource):
        @classmethod
        def name(cls) -> str:
            return "deliveries"

        def schema(self) -> str:
            return PAYLOAD

        def streamWriter(self, schema, overwrite: bool) -> DeliveryWriter:
            return DeliveryWriter(send, ledger)

    return Deliveries


def deliver(payloads_: DataFrame, send: Callable[[str, str, str], None], ledger: str, checkpoint: str, every: str = EVERY) -> StreamingQuery:
    """Send the payloads of a stream, each once, until the query is stopped.

    Matches that wait are looked at each time ``every`` has passed, so such a query has no end of its own.
    """
    payloads_.sparkSession.dataSource.register(sink(send, ledger))
    return begin(payloads_.sparkSession, payloads_.writeStream.format("deliveries").outputMode("append"), checkpoint, every)


def finish(query: StreamingQuery, idle: int = 3) -> None:
    """Wait until a query has run so many batches without input, in which what waits for its time goes out; then stop it."""
    last, quiet = None, 0
    while query.isActive and quiet < idle:
        query.awaitTermination(0.2)
        progress = query.lastProgress
        if progress and progress.batchId != last:
            last, quiet = progress.batchId, 0 if progress.numInputRows else quiet + 1
    query.stop()
