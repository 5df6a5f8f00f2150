"""Search inputs as streams: wait for a pause, and let the latest answer win."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

_OUT, _STATE = "session string, ts timestamp, query string", "ts timestamp, query string"


def debounced_stream(inputs: DataFrame, gap_ms: int = C.DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """Inputs (session, ts, query) that no other input of the session follows within the gap.

    The last input of a session waits in state until the watermark has passed it
    by the gap.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [(t, q) for b in batches for t, q in zip(b["ts"], b["query"])]
        if state.exists:
            rows.append(state.get)
        rows = sorted((pd.Timestamp(t), q) for t, q in rows)
        out = [rows[k] for k in range(len(rows) - 1) if (rows[k + 1][0] - rows[k][0]).total_seconds() * 1000 > gap_ms]
        if state.hasTimedOut:
            out += rows[-1:]
            state.remove()
        elif rows:
            state.update((rows[-1][0].to_pydatetime(), rows[-1][1]))
            state.setTimeoutTimestamp(max(int(rows[-1][0].timestamp() * 1000) + gap_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": [key[0]] * len(out), "ts": [t for t, _ in out], "query": [q for _, q in out]})

    return inputs.withWatermark("ts", late).groupBy("session").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Latest(StatefulProcessor):
    """Keeps a session's highest sequence number seen; forgets a session that has been idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "sequence bigint, due bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, due = self.held.get() if self.held.exists() else (None, None)
        best = None
        for batch in rows:
            for ts, sequence, answer in zip(batch["ts"], batch["sequence"], batch["answer"]):
                due = max(due or 0, int(pd.Timestamp(ts).timestamp() * 1000) + self.idle_ms)
                if (before is None or sequence > before) and (best is None or sequence > best[0]):
                    best = (int(sequence), answer)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.held.update((best[0] if best else before, due))
        if best:
            yield pd.DataFrame({"session": [key[0]], "sequence": [best[0]], "answer": [best[1]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"session": [], "sequence": [], "answer": []}).astype({"session": str, "sequence": "int64", "answer": str})

    def close(self) -> None:
        pass


def latest_answers(answers: DataFrame, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """(session, sequence, answer) whenever a session's answer (session, ts, sequence, answer) is newer than all before.

    The highest sequence number is kept by session, across any span of time, until the
    watermark has passed the session's last answer by ``idle_ms``; an answer to an older
    input never follows a newer one. Needs the RocksDB state store, and output mode update.
    """
    held = answers.withWatermark("ts", late).groupBy("session")
    return held.transformWithStateInPandas(_Latest(idle_ms), "session string, sequence bigint, answer string", "Update", "EventTime")
