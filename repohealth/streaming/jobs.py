"""Streaming jobs and the batch forms they share: progress, snapshots, incremental reconciliation, chunk assembly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repohealth.functions.scalars import count_if
from repohealth.operators import history


def latest_progress(events: DataFrame) -> DataFrame:
    """Newest event per scan and module; works on a table and, in update mode, on a stream.

    The state of the stream is one row per module, as the replay buffer for late listeners.
    """
    return events.groupBy("scan_id", "module_id").agg(
        F.max_by(F.struct("pct", "status", "ts", "seq"), F.struct("ts", "seq")).alias("_e")
    ).select("scan_id", "module_id", "_e.*")


def batch_progress(latest: DataFrame) -> DataFrame:
    """Modules of a scan: all, finished (failed ones included) and failed."""
    return latest.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("status").isin("completed", "failed")).alias("completed"),
        count_if(F.col("status") == "failed").alias("failed"),
    )


PROGRESS_SCHEMA = "scan_id long, total long, completed long, failed long"


class ScanCounters(StatefulProcessor):
    """Per scan a map from module to its newest event; the counters after every micro-batch with news.

    A repeated or older event changes nothing. A scan that has had no event for ``forget_ms`` of event time is dropped.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.modules = handle.getMapState("modules", "module_id string", "ts long, seq long, status string")

    def _last(self) -> int | None:
        return max((v[0] for v in self.modules.values()), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._last()
        newest: dict[str, tuple] = {}
        for batch in rows:
            for module, ts, seq, status in zip(batch["module_id"], micros(batch["ts"]), batch["seq"], batch["status"]):
                newest[module] = max(newest.get(module, (ts, int(seq), status)), (ts, int(seq), status))
        for module, event in newest.items():
            if not self.modules.containsKey((module,)) or tuple(self.modules.getValue((module,))) < event:
                self.modules.updateValue((module,), event)
        last = self._last()
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.forget_ms)
            self.handle.registerTimer(last // 1000 + self.forget_ms)
        states = [v[2] for v in self.modules.values()]
        yield pd.DataFrame({"scan_id": [int(key[0])], "total": [len(states)], "completed": [sum(x in ("completed", "failed") for x in states)], "failed": [states.count("failed")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.modules.clear()
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in PROGRESS_SCHEMA.split(", ")})

    def close(self) -> None:
        pass


def micros(times: pd.Series) -> list[int]:
    """Microseconds since 1970 of timestamps."""
    return times.astype("datetime64[us]").astype("int64").tolist()


def batch_progress_stream(events: DataFrame, delay: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """The same counters on a stream of module events (scan_id, module_id, ts, seq, status), in update mode.

    Events may come repeated, in any order within ``delay``, and in any micro-batch. State is one event a module, and
    none once a scan has been silent for ``forget_ms`` of event time.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("scan_id").transformWithStateInPandas(ScanCounters(forget_ms), PROGRESS_SCHEMA, "Update", "EventTime")


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """Text of every reply from its chunks in order. A reply is one model answer, so its chunks are few."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("audit_id", "module_id").agg(
        F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("text"), F.count(F.lit(1)).alias("chunks"))


DELTA_SCHEMA = "repo_id long, snapshot_id long, overall double, delta double"


class SnapshotDeltas(StatefulProcessor):
    """Snapshots wait, ordered by time and id, until the watermark has passed them; then each gets its delta.

    State is what waits and the last value that was given out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, snapshot_id long", "overall double")
        self.last = handle.getValueState("last", "overall double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ts, number, overall in zip(micros(batch["ts"]), batch["snapshot_id"], batch["overall"]):
                self.waiting.updateValue((ts, int(number)), (float(overall),))
                self.handle.registerTimer(ts // 1000 + 1)
        yield self._none()

    @staticmethod
    def _none() -> pd.DataFrame:
        return pd.DataFrame({"repo_id": pd.Series(dtype="int64"), "snapshot_id": pd.Series(dtype="int64"), "overall": pd.Series(dtype="float64"), "delta": pd.Series(dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k for k in (tuple(k) for k in self.waiting.keys()) if k[0] // 1000 < until)
        out = []
        for place in due:
            overall = self.waiting.getValue(place)[0]
            before = self.last.get()[0] if self.last.exists() else overall
            # halves go up, as in half_up
            out.append((int(key[0]), place[1], overall, math.floor((overall - before) * 10 + 0.5) / 10))
            self.last.update((overall,))
            self.waiting.removeKey(place)
        yield pd.DataFrame(out, columns=list(self._none().columns)) if out else self._none()

    def close(self) -> None:
        pass


def snapshot_delta_stream(snapshots: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Change of every snapshot against the repository's previous one, on a stream.

    Snapshots may come repeated, in any order and in any micro-batch, up to ``delay`` behind the newest one; each is
    given out once, when the watermark has passed it, with the delta that the whole history gives. Later ones are
    dropped, as the watermark says. State is the snapshots within the delay and one number per repository.
    """
    timed = snapshots.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("repo_id").transformWithStateInPandas(SnapshotDeltas(), DELTA_SCHEMA, "Append", "EventTime")


def incremental_reconcile(
    load_scans: Callable[[], DataFrame], load_findings: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: reconcile the repositories whose scans finished in the batch.

    The batch holds (repo_id, scan_id) of finished scans. Only those repositories
    are read from the tables. ``write`` must overwrite by (scan_id, fingerprint) or
    by batch id, so that a repeated batch leaves the same result.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("repo_id").distinct()
        scans = load_scans().join(touched, "repo_id", "left_semi")
        ranked = history.ranked_findings(scans, load_findings(), 3)
        newest = history.latest_scans(scans, 3)
        counts = newest.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
        current = history.reconcile(ranked, counts).unionByName(history.tombstones(ranked, newest))
        write(current, batch_id)

    return handle
