"""Order-dependent session features of a stream, from a bounded state.

Events wait in a list until the watermark has passed them; then their order is final and they are folded, in order,
into running moments. A session's state is what waits (the events of one watermark delay), one row of
moments and one row for each key code that is held down: it does not grow with the session's length. A timer
closes the session when no event came for the gap, and its features are emitted.

Events that arrive after the watermark has passed them are left out, as in every stream with a watermark.
One session is one task's work here; `sessions.features_of_closed` reads the stored table instead and splits large ones.
"""

from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keystride import schema as S

#: Names of the detector's features that a stream's state holds.
FEATURES = [f"keystroke_{n}" for n in S.KEYSTROKE_FEATURES] + [f"mouse_{n}" for n in S.MOUSE_FEATURES]
CLOSED = "session_id string, session_start timestamp, last_event timestamp, events long, " + ", ".join(f"{n} double" for n in FEATURES)

_EVENT = ["at", "t", "pos", "lane", "kind", "key_code", "x", "y"]
_WAITING = "at long, t double, pos long, lane string, kind string, key_code long, x double, y double"
_HELD = "n long, mean double, spread double"
_COUNTS = ["events", "keys", "moves", "clicks", "hold_n", "interkey_n", "velocity_n", "acceleration_n"]
_MOMENTS = [f"{n}_{m}" for n in ("hold", "interkey", "velocity", "acceleration") for m in ("mean", "spread")]
_LAST = ["key_first", "key_last", "mouse_first", "mouse_last", "move_t", "move_x", "move_y", "move_velocity"]
_RUN = [*_COUNTS, "start", "last", *_MOMENTS, *_LAST]
_RUNNING = ", ".join([f"{n} long" for n in (*_COUNTS, "start", "last")] + [f"{n} double" for n in (*_MOMENTS, *_LAST)])


def merged(n: int, mean: float, spread: float, m: int, other: float, more: float) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of two groups together."""
    total = n + m
    step = other - mean
    return total, mean + step * m / total, spread + more + step * step * n * m / total


class _Run:
    """The moments of an open session."""

    def __init__(self, values: dict | None = None):
        self.v = values or {**dict.fromkeys(_COUNTS, 0), "start": None, "last": None, **dict.fromkeys(_MOMENTS, 0.0), **dict.fromkeys(_LAST)}

    def add(self, name: str, n: int, mean: float, spread: float = 0.0) -> None:
        v = self.v
        v[f"{name}_n"], v[f"{name}_mean"], v[f"{name}_spread"] = merged(
            v[f"{name}_n"], v[f"{name}_mean"], v[f"{name}_spread"], n, mean, spread
        )

    def fold(self, event: tuple, held: dict) -> None:
        """Take the next event in order; `held` has the keydowns of each code that wait for a keyup."""
        at, t, _, lane, kind, code, x, y = event
        v = self.v
        v["start"], v["last"], v["events"] = at if v["start"] is None else v["start"], at, v["events"] + 1
        if lane == "key":
            self._key(t, kind, code, held)
            return
        v["mouse_first"], v["mouse_last"] = t if v["mouse_first"] is None else v["mouse_first"], t
        if lane == "click":
            v["clicks"] += 1
        elif lane == "movement":
            self._move(t, x, y)

    def _key(self, t: float, kind: str, code: int | None, held: dict) -> None:
        v = self.v
        if v["key_last"] is not None and kind == "keydown" and t - v["key_last"] < S.LONG_PAUSE_SECONDS:
            self.add("interkey", 1, t - v["key_last"])
        v["key_first"], v["key_last"], v["keys"] = t if v["key_first"] is None else v["key_first"], t, v["keys"] + 1
        if kind == "keydown":
            held[code] = merged(*held.get(code, (0, 0.0, 0.0)), 1, t, 0.0)
        elif kind == "keyup" and code in held:
            n, mean, spread = held.pop(code)
            self.add("hold", n, t - mean, spread)

    def _move(self, t: float, x: float | None, y: float | None) -> None:
        v = self.v
        v["moves"] += 1
        dt = None if v["move_t"] is None else t - v["move_t"]
        known = None not in (x, y, v["move_x"], v["move_y"])
        if dt is not None and dt > 0 and known:
            velocity = sqrt((x - v["move_x"]) ** 2 + (y - v["move_y"]) ** 2) / dt
            self.add("velocity", 1, velocity)
            if v["move_velocity"] is not None:
                self.add("acceleration", 1, (velocity - v["move_velocity"]) / dt)
            v["move_velocity"] = velocity
        v["move_t"], v["move_x"], v["move_y"] = t, x, y

    def _of(self, name: str, absent: float | None = None) -> tuple[float | None, float | None]:
        n = self.v[f"{name}_n"]
        return (self.v[f"{name}_mean"], sqrt(max(self.v[f"{name}_spread"], 0.0) / n)) if n else (absent, absent)

    @staticmethod
    def _rate(n: int, first: float | None, last: float | None) -> float | None:
        return n / (last - first) if first is not None and last > first else None

    def features(self) -> list[float | None]:
        v = self.v
        keys = [None] * len(S.KEYSTROKE_FEATURES)
        if v["keys"]:
            keys = [*self._of("hold"), *self._of("interkey"), self._rate(v["keys"], v["key_first"], v["key_last"])]
        mouse = [None] * len(S.MOUSE_FEATURES)
        if v["moves"] >= 2:
            acceleration = self._of("acceleration", 0.0)
            mouse = [*self._of("velocity"), *acceleration, self._rate(v["clicks"], v["mouse_first"], v["mouse_last"]), acceleration[0]]
        return keys + mouse


class SessionState(StatefulProcessor):
    def __init__(self, gap_seconds: float):
        self.gap = round(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.running = handle.getValueState("running", _RUNNING)
        self.held = handle.getMapState("held", "code long", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[_EVENT].astype(object).where(frame[_EVENT].notna(), None)
            self.waiting.appendList([
                (int(r[0]), float(r[1]), int(r[2]), r[3], r[4], None if r[5] is None else int(r[5]), r[6], r[7]) for r in frame.itertuples(index=False)
            ])
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def close(self) -> None:
        pass

    def _settle(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Fold what is final, emit what has ended, and ask to be called again when there is more to do."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        final = sorted((e for e in events if e[0] <= now), key=lambda e: (e[0], e[1], e[2]))
        rest = [e for e in events if e[0] > now]
        run = _Run(dict(zip(_RUN, self.running.get()))) if self.running.exists() else None
        if final or run:
            held = {k[0]: tuple(h) for k, h in self.held.iterator()} if run else {}
            held = {None if code == _NO_CODE else code: h for code, h in held.items()}
            ended = []
            for event in final:
                if run and event[0] - run.v["last"] > self.gap:
                    ended.append(run)
                    run, held = None, {}
                run = run or _Run()
                run.fold(event, held)
            if run and run.v["last"] + self.gap <= now:
                ended.append(run)
                run, held = None, {}
            self._store(run, held)
            if final:
                self.waiting.clear()
                if rest:
                    self.waiting.put(rest)
            if ended:
                yield pd.DataFrame([
                    (key[0], pd.Timestamp(e.v["start"], unit="us"), pd.Timestamp(e.v["last"], unit="us"), e.v["events"], *e.features()) for e in ended
                ], columns=["session_id", "session_start", "last_event", "events", *FEATURES])
        times = [e[0] for e in rest] + ([run.v["last"] + self.gap] if run else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def _store(self, run: _Run | None, held: dict) -> None:
        self.held.clear()
        if run is None:
            self.running.clear()
            return
        self.running.update(tuple(run.v[n] for n in _RUN))
        for code, moments in held.items():
            self.held.updateValue((_NO_CODE if code is None else code,), moments)


#: A map's key cannot be null.
_NO_CODE = -(2**63)


def session_state_features(events: DataFrame, gap_seconds: float, delay: str) -> DataFrame:
    """One row (CLOSED) for each session that ended: keystroke and mouse features, as the batch operators give them.

    Needs the RocksDB state store: start the stream within `session.rocksdb_state`.
    """
    rows = events.where("session_id is not null and event_time is not null").select(
        "session_id", "event_time", F.unix_micros("event_time").alias("at"), "t", "pos", "lane", "kind", F.col("key_code").cast("long").alias("key_code"), "x", "y"
    )
    return rows.withWatermark("event_time", delay).groupBy("session_id").transformWithStateInPandas(
        SessionState(gap_seconds), CLOSED, "append", "EventTime"
    )
