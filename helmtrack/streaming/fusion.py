"""Sensor fusion, progress and level checks on streams.

Samples of a series may come in any micro-batch.  A series' state is the
filter and the last frame taken; within a batch its samples are put in order,
and a sample at or before the last frame is too late and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recurrence import FILTERS, FORCES, RATES, GyroOnly, run_filter
from ..operators.series import FRAME, ID

_OUT = f"{ID} bigint, {FRAME} bigint, roll double, pitch double, yaw double"


def fuse_stream(samples: DataFrame, *, method: str = "ekf", gain: float = 0.51, fps: float = 30.0) -> DataFrame:
    """As operators.recurrence.fuse, on a stream of (series_id, frame, rates, forces)."""
    made = FILTERS.get(method.lower(), GyroOnly)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = made(fps, gain)
        blob, last = state.get if state.exists else (f.start(1).tobytes(), -1)
        at = np.frombuffer(blob).reshape(1, -1)
        rows = pd.concat(list(batches)).sort_values(FRAME, kind="stable")
        rows = rows[rows[FRAME] > last].drop_duplicates(FRAME)
        out, at = run_filter(f, at, np.array([0, len(rows)]), rows[[*RATES, *FORCES]].to_numpy(np.float64))
        if len(rows):
            last = int(rows[FRAME].iloc[-1])
        state.update((at.tobytes(), last))
        done = pd.DataFrame(out, columns=["roll", "pitch", "yaw"], dtype="float64")
        yield pd.DataFrame({ID: key[0], FRAME: rows[FRAME].to_numpy("int64"), **{c: done[c].to_numpy() for c in done}})

    return samples.groupBy(ID).applyInPandasWithState(step, _OUT, "filter binary, last bigint", "append", GroupStateTimeout.NoTimeout)


#: Seconds between a job's updates, beyond its total that count as a runaway (with and without padding after the active part), and without ticks that count as silence (fixed values).
THROTTLE, SLACK, PADDED_SLACK, SILENCE = 0.25, 5.0, 10.0, 30.0
_PROGRESS = "job bigint, at double, speed double, progress double, runaway boolean, silent boolean"
_PROGRESS_STATE = "at0 double, done0 double, speed double, told double, held double, last_done double, last_total double, last_active double, fallen boolean"


def percent(done: float, total: float, active: float) -> float:
    """Padding after the active part counts for the last percent; never quite all."""
    if total <= 0.0:
        return 0.0
    part = active if 0.0 < active < total else total
    if part == total:
        return min(99.0, done / total * 100.0)
    return min(98.0, done / max(0.001, part) * 98.0) if done < part else min(99.0, 98.0 + (done - part) / max(0.001, total - part))


def progress_stream(ticks: DataFrame, *, alpha: float = 0.3, apart: float = 0.5, throttle: float = THROTTLE, slack: float = SLACK, padded_slack: float = PADDED_SLACK, silence: float = SILENCE, live: bool = False) -> DataFrame:
    """job, at, speed, progress, runaway, silent for a stream of (job, at, done, total) and perhaps active: seconds of video against wall seconds.

    The speed is a moving average of samples at least ``apart`` seconds apart.
    A job is reported at most every ``throttle`` seconds; a tick that comes
    sooner is held.  A job beyond its total by ``slack`` seconds, or
    ``padded_slack`` where it has padding, has run away, and is reported at
    once.

    A ``live`` stream has timers, by the clock of the stream: one reports a held
    tick if no other follows; when a job has been silent for ``silence`` seconds
    another says so, once, with what was last known of it.  Such a stream never
    ends by itself.  Without timers held ticks are reported as their batch ends.
    """
    rows = ticks if "active" in ticks.columns else ticks.withColumn("active", F.lit(0.0))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at0, done0, speed, told, held, *last, fallen = state.get if state.exists else (None, None, None, None, None, 0.0, 0.0, 0.0, False)
        done, total, active = last

        def report(at: float, silent: bool = False) -> tuple:
            most = padded_slack if 0.0 < active < total else slack
            return key[0], at, speed, round(percent(done, total, active), 1), bool(done > total + most), silent

        out = []
        if state.hasTimedOut:
            if held is not None:
                out.append(report(held))
                told, held = held, None
            elif not fallen:
                out.append(report(told if told is not None else at0, silent=True))
                fallen = True
        else:
            fallen = False
            for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
                at, done, total, active = float(r.at), float(r.done), float(r.total), float(r.active or 0.0)
                if at0 is None:
                    at0, done0 = at, done
                elif at - at0 >= apart:
                    now = (done - done0) / (at - at0)
                    speed = now if speed is None else alpha * now + (1.0 - alpha) * speed
                    at0, done0 = at, done
                row = report(at)
                if told is None or at - told >= throttle or row[4]:
                    out.append(row)
                    told, held = at, None
                else:
                    held = at
            if held is not None and not live:
                out.append(report(held))
                told, held = held, None
        state.update((at0, done0, speed, told, held, done, total, active, fallen))
        if live and not fallen:
            state.setTimeoutDuration(max(1, round(1000 * (throttle if held is not None else silence))))
        yield pd.DataFrame(out, columns=["job", "at", "speed", "progress", "runaway", "silent"])

    return rows.groupBy("job").applyInPandasWithState(step, _PROGRESS, _PROGRESS_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by time window and key; rows later than ``late`` are left out.  An extension: the motion tools have no such thing."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
