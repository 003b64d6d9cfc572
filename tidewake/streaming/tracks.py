"""Track segments and count windows on streams, with typed state for each vessel and segment.

Rows may come in any order within the watermark's lateness. They wait in state until the watermark has passed them, and
are then taken in order of event time, so results are those of the batch operators however a stream is cut into batches.
The state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.samples import ROW, named_windows
from ..plans.config import DEFAULT, EARTH_RADIUS_M, KNOTS_PER_MPS, Thresholds
from ..plans.stages import ship_code

TIME, MICROS, ORDER = "timestamp_utc", "event_us", "ingest_order"
SEGMENT_COLUMNS = "dt_to_prev_seconds double, implied_speed_from_prev_knots double, segment_break_before string, segment_id string"
END_COLUMNS = "mmsi long, segment_id string, start_us long, end_us long, num_points long"


class InOrder(StatefulProcessor):
    """Rows of a key in order of event time, once the watermark has passed them; of rows of one time the least by `tie`.

    State: the rows that wait (no more than come within the lateness), and the time up to which rows were taken. One timer
    is set at a time, for the first row that waits or, where none does, for `idle_s` after the last row taken.
    """

    def __init__(self, fields: T.StructType, tie: str, idle_s: float) -> None:
        self.fields, self.tie, self.idle_ms = fields, tie, int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.taken = handle.getValueState("taken", "us long")

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Results of rows in order; the first comes after all taken before."""
        raise NotImplementedError

    def idle(self, key: tuple) -> Iterator[pd.DataFrame]:
        """Results once the watermark is idle_s beyond the last row taken."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.fields.names].astype(object)
        new = new.where(new.notnull(), None)
        yield from self._advance(key, [tuple(r) for r in new.itertuples(index=False)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        at, past = self.fields.names.index(MICROS), watermark_ms * 1000
        done = self.taken.get()[0] if self.taken.exists() else None
        rows = [r for r in [*(tuple(x) for x in self.waiting.get()), *new] if done is None or r[at] > done]
        ready, later = [r for r in rows if r[at] <= past], [r for r in rows if r[at] > past]
        if ready:
            frame = pd.DataFrame(ready, columns=self.fields.names).sort_values([MICROS, self.tie]).drop_duplicates(MICROS).reset_index(drop=True)
            done = int(frame[MICROS].iloc[-1])
            self.taken.update((done,))
            yield from self.take(key, frame)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.handle.registerTimer(min(r[at] for r in later) // 1000 + 1)
        elif done is not None:
            over = done // 1000 + self.idle_ms + 1
            if watermark_ms > over:
                yield from self.idle(key)
            else:
                self.handle.registerTimer(over)

    def close(self) -> None:
        pass


def haversine_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


class Segments(InOrder):
    """Segment breaks of one vessel. State: the last row's place, speed, cap and time, and its segment's number, start and size."""

    KEPT = ("lat", "lon", "sog", "shiptype_soft_cap_knots")

    def __init__(self, fields: T.StructType, tie: str, limits: Thresholds, ends: bool) -> None:
        super().__init__(fields, tie, limits.segment_gap_s)
        self.limits, self.ends = limits, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long, lat double, lon double, sog double, cap double, number long, start long, points long, ended boolean")

    def _summary(self, key: tuple, number: int, start: int, end: int, points: int) -> tuple:
        return int(key[0]), f"{key[0]}_{number:06d}", int(start), int(end), int(points)

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        us = rows[MICROS].to_numpy(np.int64)
        now = {c: rows[c].to_numpy(np.float64) for c in self.KEPT}
        before = {c: np.append(np.nan if last is None or last[1 + k] is None else last[1 + k], v[:-1]) for k, (c, v) in enumerate(now.items())}
        dt = (us - np.append(us[0] if last is None else last[0], us[:-1])) / 1e6
        with np.errstate(divide="ignore", invalid="ignore"):
            implied = haversine_m(before["lat"], before["lon"], now["lat"], now["lon"]) / dt * KNOTS_PER_MPS
        either = lambda c, other: np.maximum(*(np.nan_to_num(x[c], nan=other) for x in (before, now)))
        m = self.limits
        most = np.maximum(m.implied_speed_factor * either("sog", 0.0), either("shiptype_soft_cap_knots", m.hard_cap_knots) + m.implied_speed_margin_knots)
        reason = np.where(dt > m.segment_gap_s, "time_gap", np.where(implied > most, "implied_speed", "continue")).astype(object)
        if last is None:
            reason[0], dt[0], implied[0] = "start", np.nan, np.nan
        number = (-1 if last is None else last[5]) + np.cumsum(reason != "continue")
        # the open segment and those that these rows end
        runs = [(int(k), us[number == k]) for k in np.unique(number)]
        closed, open_ = [], None if last is None else (last[5], last[6], last[0], last[7], last[8])
        for k, t in runs:
            if open_ is not None and open_[0] == k:
                open_ = (k, open_[1], t[-1], open_[3] + len(t), False)
            else:
                closed += [] if open_ is None or open_[4] else [self._summary(key, *open_[:4])]
                open_ = (k, t[0], t[-1], len(t), False)
        state = [None if np.isnan(v[-1]) else float(v[-1]) for v in now.values()]
        self.last.update((int(us[-1]), *state, int(open_[0]), int(open_[1]), int(open_[3]), False))
        if self.ends:
            if closed:
                yield pd.DataFrame(closed, columns=_names(END_COLUMNS))
            return
        yield rows.assign(mmsi=int(key[0]), dt_to_prev_seconds=dt, implied_speed_from_prev_knots=implied, segment_break_before=reason, segment_id=[f"{key[0]}_{k:06d}" for k in number])

    def idle(self, key: tuple) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        if last is not None and not last[8]:
            self.last.update((*last[:8], True))
            if self.ends:
                yield pd.DataFrame([self._summary(key, last[5], last[6], last[0], last[7])], columns=_names(END_COLUMNS))


class Windows(InOrder):
    """Windows of so many rows at every so many of a segment. State: the last rows, one less than a window, and the next row's number."""

    def __init__(self, fields: T.StructType, limits: Thresholds) -> None:
        super().__init__(fields, "lat", limits.segment_gap_s)
        self.size, self.step = limits.hist_points + limits.fut_points, limits.window_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", self.fields)
        self.number = handle.getValueState("number", "n long")

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n = self.number.get()[0] if self.number.exists() else 0
        held = pd.DataFrame([tuple(r) for r in self.ring.get()], columns=self.fields.names)
        every = pd.concat([held, rows], ignore_index=True) if len(held) else rows
        first = n - len(held)  # the number of the first row held
        starts = range(-(-first // self.step) * self.step - first, len(every) - self.size + 1, self.step)
        out = [(*key, first + s, *(every[c].iloc[s : s + self.size].tolist() for c in self.fields.names)) for s in starts if s >= 0]
        keep = every.iloc[-(self.size - 1) :].astype(object)
        self.ring.put([tuple(r) for r in keep.where(keep.notnull(), None).itertuples(index=False)])
        self.number.update((n + len(rows),))
        if out:
            yield pd.DataFrame(out, columns=["mmsi", "segment_id", "_i", *self.fields.names])

    def idle(self, key: tuple) -> Iterator[pd.DataFrame]:
        for state in (self.ring, self.number, self.taken):
            state.clear()
        return iter(())


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _state_fields(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])


def _with_micros(rows: DataFrame, lateness: str) -> DataFrame:
    """With the event time as a number; the processor's rows are named tuples, which have no names with leading underscores."""
    ship_code()
    return rows.withColumnsRenamed({"_ingest_order": ORDER}).withColumn(MICROS, F.unix_micros(TIME)).withWatermark(TIME, lateness)


def segment_stream(messages: DataFrame, lateness: str = "10 minutes", limits: Thresholds = DEFAULT) -> DataFrame:
    """Rows of segment_tracks for a stream of clean messages, each once the watermark has passed it.

    Rows later than the watermark are dropped, of rows of one vessel and time the first by _ingest_order counts (without
    that column the one of least latitude), as in the batch. Names of columns must not begin with an underscore, but
    for that one, nor may other columns be timestamps.
    """
    df = _with_micros(messages, lateness)
    held = [c for c in df.columns if c not in (TIME, "mmsi")]
    fields = _state_fields(df, held)
    out = T.StructType([T.StructField("mmsi", T.LongType()), *fields.fields, *T.StructType.fromDDL(SEGMENT_COLUMNS).fields])
    tie = ORDER if ORDER in held else "lat"
    found = df.groupBy("mmsi").transformWithStateInPandas(Segments(fields, tie, limits, False), out, "Append", "EventTime")
    return found.withColumn(TIME, F.timestamp_micros(MICROS)).drop(MICROS).withColumnsRenamed({ORDER: "_ingest_order"})


def segment_ends(messages: DataFrame, lateness: str = "10 minutes", limits: Thresholds = DEFAULT) -> DataFrame:
    """Rows of segment_summary for a stream of clean messages: each segment once, when a break or the watermark has ended it."""
    df = _with_micros(messages, lateness)
    fields = _state_fields(df, [c for c in df.columns if c in (MICROS, ORDER, *Segments.KEPT)])
    tie = ORDER if ORDER in fields.names else "lat"
    found = df.groupBy("mmsi").transformWithStateInPandas(Segments(fields, tie, limits, True), END_COLUMNS, "Append", "EventTime")
    return found.select("mmsi", "segment_id", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), "num_points")


def window_stream(points: DataFrame, lateness: str = "10 minutes", limits: Thresholds = DEFAULT) -> DataFrame:
    """Rows of make_windows for a stream of 20-second points, each window once its last row is passed by the watermark.

    A segment's state is dropped once the watermark is a segment gap beyond its last row.
    """
    df = _with_micros(points, lateness)
    fields = _state_fields(df, [c for c in (MICROS, *ROW) if c != TIME])
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
    out = T.StructType([T.StructField("mmsi", T.LongType()), T.StructField("segment_id", T.StringType()), T.StructField("_i", T.LongType()), *arrays.fields])
    found = df.groupBy("mmsi", "segment_id").transformWithStateInPandas(Windows(fields, limits), out, "Append", "EventTime")
    rows = F.transform(F.arrays_zip(*[F.col(f.name) for f in fields]), lambda r: F.struct(*[(F.timestamp_micros(r[MICROS]) if c == TIME else r[c]).alias(c) for c in ROW]))
    return named_windows(found.select("mmsi", "segment_id", "_i", rows.alias("_w")))
