"""Stateful processors of the task streams: retries in event order, and the content cache with expiry.

Both keep their state per task in the session's state store and bound it in
event time: what the watermark has passed is folded into a counter or dropped,
and a timer forgets a task that has been quiet for a horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures of a task are held in runs of so many milliseconds of event time.
RUN_MS = 10 * 60 * 1000
_RUN = np.dtype([("at", "<i8"), ("id", "<i8")])
#: Rows handed on at once.
_ROWS = 10_000


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype(np.int64).to_numpy()


class Retries(StatefulProcessor):
    """Attempt numbers of a task's failures in event order, however they arrive.

    The failures that may still be preceded by a late one (younger than the
    watermark) are held as sorted runs, a map from ten minutes of event time to
    packed (time, id) pairs; older ones are only counted.  Rows are emitted when
    they arrive; if a late failure comes before others, those are emitted again
    with their new number, so the newest row of an event is right whatever the
    batches (``jobs.latest_retries``).
    """

    def __init__(self, base_ms: int, max_ms: int, max_attempts: int | None, idle_ms: int):
        self.base_ms, self.max_ms, self.max_attempts, self.idle_ms = base_ms, max_ms, max_attempts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._runs = handle.getMapState("runs", "run long", "packed binary")
        self._past = handle.getValueState("past", "n long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        past, last_ms = tuple(self._past.get()) if self._past.exists() else (0, 0)
        runs = {k[0]: np.frombuffer(v[0], _RUN) for k, v in self._runs.iterator()}
        first = None
        changed = set()
        for pdf in rows:  # Arrow batches in any order; a failure is 16 bytes here
            new = np.empty(len(pdf), _RUN)
            new["at"], new["id"] = _micros(pdf["event_at"]), pdf["event_id"].to_numpy(np.int64)
            for run in np.unique(new["at"] // 1000 // RUN_MS).tolist():
                mine = new[new["at"] // 1000 // RUN_MS == run]
                runs[run] = np.sort(np.concatenate((runs.get(run, np.empty(0, _RUN)), mine)), order=("at", "id"))
                changed.add(run)
            least = np.sort(new, order=("at", "id"))[0]
            first = least if first is None or (least["at"], least["id"]) < (first["at"], first["id"]) else first
            last_ms = max(last_ms, int(new["at"].max()) // 1000)
        n = past
        for run in sorted(runs):
            here = runs[run]
            late = (here["at"] > first["at"]) | ((here["at"] == first["at"]) & (here["id"] >= first["id"]))
            for k in range(int(np.argmax(late)) if late.any() else len(here), len(here), _ROWS):
                yield self._rows(key[0], here[k:k + _ROWS], n + k)
            n += len(here)
        mark = timerValues.getCurrentWatermarkInMs()
        for run in sorted(runs):
            if (run + 1) * RUN_MS <= mark:  # nothing can come before these any more
                past += len(runs[run])
                if self._runs.containsKey((run,)):
                    self._runs.removeKey((run,))
            elif run in changed:
                self._runs.updateValue((run,), (runs[run].tobytes(),))
        self._past.update((past, last_ms))
        self._handle.registerTimer(max(last_ms, mark) + self.idle_ms)

    def _rows(self, task: str, part: np.ndarray, attempt: int) -> pd.DataFrame:
        attempts = attempt + np.arange(len(part))
        delay = np.minimum(self.max_ms, self.base_ms * 2.0 ** np.minimum(attempts, 40)).astype(np.int64)
        dead = attempts >= self.max_attempts if self.max_attempts is not None else np.zeros(len(part), bool)
        at = pd.Series(part["at"].astype("datetime64[us]"))
        return pd.DataFrame({"event_id": part["id"], "task_id": task, "attempt": attempts, "delay_ms": delay,
                             "action": np.where(dead, "dead_letter", "retry"),
                             "next_at": (at + pd.to_timedelta(delay, unit="ms")).where(~pd.Series(dead))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        if self._past.exists():
            _, last_ms = self._past.get()
            if timerValues.getCurrentWatermarkInMs() >= last_ms + self.idle_ms:  # no failure for a whole horizon: forget the task
                self._past.clear()
                self._runs.clear()
        return iter(())

    def close(self) -> None:
        pass


class ContentCache(StatefulProcessor):
    """Contents that a task cached, for ``ttl_ms`` of event time, and the steps that read them.

    Every step is answered, with the newest content not older than the lifetime
    or with none (a miss); entries of a micro-batch are stored before its steps
    are answered, in whatever order its rows come.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entries = handle.getMapState("entries", "cached_us long, event_id long", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        steps, last = [], None
        for pdf in rows:
            at = _micros(pdf["event_at"])
            for is_entry, us, event_id, content in zip(pdf["is_entry"], at.tolist(), pdf["event_id"].tolist(), pdf["content"], strict=True):
                if is_entry:
                    self._entries.updateValue((us, event_id), (content,))
                    last = us if last is None else max(last, us)
            step = ~pdf["is_entry"].to_numpy(bool)
            steps.append((pdf["event_id"].to_numpy(np.int64)[step], at[step]))
        # state larger than a lifetime is gone with the timer, so this is what a task cached within it
        held = sorted((k[0], k[1], v[0]) for k, v in self._entries.iterator())
        times = np.array([h[0] for h in held], np.int64)
        for ids, at in steps:
            for k in range(0, len(ids), _ROWS):
                part = at[k:k + _ROWS]
                newest = np.searchsorted(times, part, "right") - 1
                hit = (newest >= 0) & (part - (times[np.maximum(newest, 0)] if len(times) else 0) <= self.ttl_ms * 1000)
                yield pd.DataFrame({"event_id": ids[k:k + _ROWS], "task_id": key[0], "event_at": part.astype("datetime64[us]"),
                                    "hit": hit, "cached": [held[j][2] if h else None for j, h in zip(newest.tolist(), hit.tolist(), strict=True)]})
        if last is not None:
            self._handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        oldest = (timerValues.getCurrentWatermarkInMs() - self.ttl_ms) * 1000
        for k in [tuple(k) for k in self._entries.keys()]:
            if k[0] < oldest:
                self._entries.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass
