"""Streaming forms: per-agent history state, online decision, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrylens.functions import constants as C
from sentrylens.operators import decisions

INPUT = ("agent", "row_id", "us", "level", "rule_id", "srcip", "auth", "scan", "brute")
SECOND = 1_000_000
FEATURES = (
    "alert_rate_1min", "failed_login_5min", "unique_src_ip_10min", "high_sev_ratio_20",
    "rule_diversity_10min", "time_since_last_high", "scan_preceded", "brute_preceded",
)
OUTPUT_SCHEMA = "agent string, row_id long, us long, " + ", ".join(f"{f} double" for f in FEATURES)
#: What waits, and what an agent's history holds: ``timed`` says that a row of the agent had a time.
WAITING = pa.schema(
    [("agent", pa.string()), ("row_id", pa.int64()), ("us", pa.int64()), ("level", pa.float64()), ("rule_id", pa.string()),
     ("srcip", pa.string()), ("auth", pa.bool_()), ("scan", pa.bool_()), ("brute", pa.bool_())]
)
BUFFER = WAITING.remove(1).append(pa.field("timed", pa.bool_()))
#: Rows of a state value, and groups of agents unless the caller has another number.
PACK_ROWS, GROUPS = 50_000, 256


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start streams inside with the RocksDB state store, which list state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(
        key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _first_seen(codes: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Number of different codes among the counted entries of each row."""
    out = np.zeros(len(codes))
    for k in range(codes.shape[1]):
        again = (counted[:, :k] & (codes[:, :k] == codes[:, k : k + 1])).any(axis=1)
        out += counted[:, k] & ~again
    return out


def buffer_features(rows: pd.DataFrame, start: int | np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """The eight history features of some rows, each from the twenty rows before it.

    ``start``: the first of these rows, or a mask of them. ``begins``: the place where each row's history begins, for the rows
    of several agents behind one another.
    """
    begins = np.zeros(len(rows), dtype=np.int64) if begins is None else begins
    wanted = np.arange(start, len(rows)) if isinstance(start, int) else np.flatnonzero(start)
    known = rows["us"].notna().to_numpy()
    us = rows["us"].where(known, 0).to_numpy(dtype=np.int64)
    level = rows["level"].to_numpy(dtype=float)
    src, rule = (pd.factorize(rows[c])[0] for c in ("srcip", "rule_id"))
    src = np.where(rows["srcip"].eq("").to_numpy(), -1, src)
    auth, scan, brute = (rows[c].eq(True).to_numpy(dtype=bool) for c in ("auth", "scan", "brute"))
    lag = np.arange(1, C.HISTORY_ROWS + 1)
    out = np.zeros((len(wanted), len(FEATURES)))
    for lo in range(0, len(wanted), 20_000):
        here = wanted[lo : lo + 20_000]
        at = here[:, None] - lag
        there = at >= begins[here][:, None]
        at = np.maximum(at, 0)
        age = us[here][:, None] - us[at]
        past = there & known[at] & (age >= 0)
        recent, high = past & (age <= 600 * SECOND), past & (level[at] >= 10)
        n = there.sum(axis=1)
        block = np.column_stack(
            [
                (past & (age <= 60 * SECOND)).sum(axis=1),
                (past & (age <= 300 * SECOND) & auth[at]).sum(axis=1),
                _first_seen(src[at], recent & (src[at] >= 0)),
                (there & (level[at] >= 8)).sum(axis=1) / np.maximum(n, 1),
                _first_seen(rule[at], recent & (rule[at] >= 0)),
                np.where(high.any(axis=1), np.where(high, age, np.iinfo(np.int64).max).min(axis=1) / SECOND, C.NO_RECENT_HIGH),
                (recent & scan[at]).any(axis=1),
                (recent & brute[at]).any(axis=1),
            ]
        ).astype(float)
        nothing = ~known[here] | (n == 0)
        block[nothing] = [0.0, 0.0, 0.0, 0.0, 0.0, C.NO_RECENT_HIGH, 0.0, 0.0]
        out[lo : lo + len(here)] = block
    return out


class AgentBuffer(StatefulProcessor):
    """STR1: the alerts of a group of agents wait until the watermark has passed them, then leave in event order.

    State, as packed tables (a call for thousands of rows, not one for each agent): the alerts that wait, the last twenty
    of each agent that left, and a timer for the earliest that waits.
    """

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffer = handle.getListState("buffer", "packed binary")
        self._waiting = handle.getListState("waiting", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[list(INPUT)]
        timed = new[new["us"].notna()]
        if len(timed):
            self._waiting.appendList(_packed(timed, WAITING))
            self._wake(int(timed["us"].min()))
        untimed = new[new["us"].isna()].sort_values("row_id", kind="stable")
        if len(untimed):
            yield self._out(untimed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = _unpacked(self._waiting.get(), WAITING)
        due = (held["us"] // 1000 < now).to_numpy()
        left = held[~due]
        if due.any():
            self._waiting.put(_packed(left, WAITING)) if len(left) else self._waiting.clear()
            yield self._out(held[due].sort_values(["us", "row_id"], kind="stable"))
        wake = [int(left["us"].min()) // 1000 + 1] if len(left) else []  # the timer that fired is still listed, and goes by itself
        if self.forget_ms is not None:
            wake += self._forget(now, left["agent"])
        if wake:
            self._handle.registerTimer(min(wake))

    def _wake(self, us: int) -> None:
        """A timer that fires once the watermark is beyond the earliest alert that waits."""
        at = us // 1000 + 1
        if not any(t <= at for t in self._handle.listTimers()):
            self._handle.registerTimer(at)

    def _forget(self, now: int, waiting: pd.Series) -> list[int]:
        """Free the state of agents that stay away; the times at which the next of the others is to go.

        An agent goes when its history is older than the silence and nothing of it waits; one that never had a time stays.
        """
        held = _unpacked(self._buffer.get(), BUFFER)
        ends = held.groupby("agent", dropna=False)["us"].transform("max").fillna(0).astype("int64") // 1000 + 1 + self.forget_ms
        idle = held["timed"] & ~held["agent"].isin(waiting)
        gone = idle & (ends <= now)
        if gone.any():
            self._buffer.put(_packed(held[~gone], BUFFER)) if not gone.all() else self._buffer.clear()
        rest = ends[idle & ~gone]
        return [int(rest.min())] if len(rest) else []

    def _out(self, new: pd.DataFrame) -> pd.DataFrame:
        """Features of alerts in order; the last twenty of each agent become the history of its next ones."""
        held = _unpacked(self._buffer.get(), BUFFER)
        every = pd.concat([held.assign(fresh=False, row_id=0), new.assign(fresh=True, timed=new["us"].notna())], ignore_index=True)
        agent = pd.factorize(every["agent"], use_na_sentinel=False)[0]
        order = np.argsort(agent, kind="stable")  # of an agent, the history comes first
        every, agent = every.iloc[order].reset_index(drop=True), agent[order]
        fresh = every["fresh"].to_numpy(dtype=bool)
        starts = np.r_[True, agent[1:] != agent[:-1]]
        timed = pd.Series(every["timed"].to_numpy(dtype=bool)).groupby(agent).transform("any").to_numpy()
        starts |= self._visits(every["us"], agent, fresh)
        begins = np.maximum.accumulate(np.where(starts, np.arange(len(every)), 0))
        features = buffer_features(every, fresh, begins)
        ends = np.r_[agent[1:] != agent[:-1], True]
        end = np.flatnonzero(ends)[agent]  # codes are in order of place, without gaps
        kept = (np.arange(len(every)) >= begins[end]) & (end - np.arange(len(every)) < C.HISTORY_ROWS)
        self._buffer.put(_packed(every.assign(timed=timed)[kept], BUFFER))
        result = every.loc[fresh, ["agent", "row_id", "us"]].reset_index(drop=True)
        result["us"] = result["us"].astype("float64" if new["us"].isna().any() else "int64")
        return pd.concat([result, pd.DataFrame(features, columns=list(FEATURES))], axis=1)

    def _visits(self, us: pd.Series, agent: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The alerts that come after a silence of ``forget_ms``."""
        if self.forget_ms is None or us[fresh].isna().any():
            return np.zeros(len(us), dtype=bool)
        before = us.groupby(agent).cummax().groupby(agent).ffill().groupby(agent).shift()  # the latest so far
        return fresh & (us - before >= self.forget_ms * 1000).to_numpy(dtype=bool)

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """Rows as state values, each a compressed table of up to ``PACK_ROWS`` rows."""
    table = pa.Table.from_pandas(rows, schema, preserve_index=False)
    out = []
    for lo in range(0, len(table), PACK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(table.slice(lo, PACK_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(values: Iterator[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(v[0])).read_all() for v in values]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()


def stream_history(alerts: DataFrame, late: str = "1 hour", forget_days: int | None = None, groups: int = GROUPS) -> DataFrame:
    """STR1: history features on a stream of ``INPUT`` columns, in event time.

    An alert leaves when the watermark (the latest time seen less ``late``) has passed it, after all earlier ones of
    its agent (ties by row id). So the result is that of the batch history however the stream is cut into
    micro-batches and however rows are disordered within ``late``. A row that comes behind the watermark is dropped
    by Spark and counted in the progress of the query (``numRowsDroppedByWatermark``); so are times up to 1970, where the watermark starts. Rows without a time cannot
    wait: they leave at once with the default features and enter the history where they arrive.

    State is at most twenty alerts of an agent plus those within ``late``. Agents share the state of one of ``groups`` groups,
    by hash, since a call to the state store costs more than the features of an alert; a task holds one group's alerts
    between two watermarks, so large inputs want more groups (a stream goes on with the number that it began with).
    With ``forget_days`` an agent that was silent for so long starts anew, and a timer frees its state. Needs the RocksDB
    state store.
    """
    timed = alerts.select(*INPUT).withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", late)
    grouped = timed.withColumn("_group", F.pmod(F.xxhash64("agent"), F.lit(groups))).groupBy("_group")
    return grouped.transformWithStateInPandas(
        statefulProcessor=AgentBuffer(None if forget_days is None else forget_days * 86_400_000),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_decisions(
    scored: DataFrame, theta1: float, theta2: float, s1: str = "s1", s2: str = "s2",
    rule: str = "rule_id", criticality: str = "agent_criticality",
) -> DataFrame:
    """STR2: the two-layer decision on every alert of a stream (stateless)."""
    deferred = decisions.defers(F.col(rule), F.col(criticality))
    return scored.withColumns(
        decisions.two_layer(F.col(s1), F.col(s2), theta1, theta2, deferred)
    )


def stream_counts(
    alerts: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", window: str = "10 minutes",
    slide: str | None = None,
) -> DataFrame:
    """WIN12 (tumbling) and a sliding count on a stream, with a watermark for late rows."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        alerts.withWatermark(ts, late).groupBy(frame, key).agg(F.count(F.lit(1)).alias("n"))
    )


def stream_rounds(alerts: DataFrame, key: str, ts: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """WIN13 on a stream: rounds as session windows."""
    return (
        alerts.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
