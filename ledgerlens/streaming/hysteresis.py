"""Observations per component turned into a steady state: runs switch it, flapping locks it.

One pure rule serves the batch form and the streaming form. It jumps from switch to switch:
where a run reaches the length that switches is found for a whole batch at once, so the work
in Python goes by the number of switches, not of observations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Run lengths that switch, switches tolerated in a stretch of seconds, seconds of the lock; bounds of a healthy
# observation.
BAD_RUN, GOOD_RUN, FLAPS, STRETCH, LOCK = 2, 3, 3, 300.0, 300.0
LATENCY_MS, DIVERGENCE, THROUGHPUT = 5000.0, 0.5, 0.20
OUT = "component string, ts timestamp, state string, switched boolean"


def unhealthy(latency: str, kl: str, throughput: str) -> Column:
    """Whether an observation is out of bounds; a NULL is within."""
    out = (F.col(latency) > LATENCY_MS, F.col(kl) > DIVERGENCE, F.col(throughput) < THROUGHPUT)
    return F.greatest(*(F.coalesce(x, F.lit(False)) for x in out))


def trigger(latency: str, kl: str, throughput: str) -> Column:
    """What is out of bounds, in words; within_bounds where nothing is."""
    parts = (
        (F.col(latency) > LATENCY_MS, "heartbeat_latency_ms=%.1f", latency), (F.col(kl) > DIVERGENCE, "kl_divergence=%.4f", kl),
        (F.col(throughput) < THROUGHPUT, "throughput_ratio=%.4f", throughput),
    )
    text = F.concat_ws("; ", *(F.when(out, F.format_string(pattern, F.col(c).cast("double"))) for out, pattern, c in parts))
    return F.when(text == "", "within_bounds").otherwise(text)


@dataclass
class Health:
    state: str = "HEALTHY"
    bad: int = 0
    good: int = 0
    switches: list[float] = field(default_factory=list)
    until: float = 0.0


def _runs(bad: np.ndarray, before: int, what: bool) -> np.ndarray:
    """Length of the run of ``what`` that ends at each observation, ``before`` being that before the first."""
    at = np.arange(1, len(bad) + 1)
    broken = np.maximum.accumulate(np.where(bad == what, 0, at)) if len(bad) else at
    return at - broken + np.where(broken == 0, before, 0)


def move(h: Health, at: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, switched) after each observation, at rising times in seconds; h goes on from there."""
    n = len(at)
    state, switched = np.empty(n, dtype=object), np.zeros(n, dtype=bool)
    bad_runs, good_runs = _runs(bad, h.bad, True), _runs(bad, h.good, False)
    fell, rose = np.flatnonzero(bad_runs >= BAD_RUN), np.flatnonzero(good_runs >= GOOD_RUN)
    i, since = 0, 0  # the next observation; where counting began anew after a lock
    while i < n:
        if h.state == "COOLDOWN":
            free = i + int(np.searchsorted(at[i:], h.until))
            state[i:free] = h.state
            i = free
            if i == n:
                break
            h.state, h.bad, h.good, since = "DEGRADED", 0, 0, i
            later = _runs(bad[i:], 0, False)  # a run that began before the lock ended counts from its end
            rose = i + np.flatnonzero(later >= GOOD_RUN)
            bad_runs[i:], good_runs[i:] = _runs(bad[i:], 0, True), later
        events, other = (fell, "DEGRADED") if h.state == "HEALTHY" else (rose, "HEALTHY")
        k = int(np.searchsorted(events, i))
        j = int(events[k]) if k < len(events) else n
        state[i:j] = h.state
        if j == n:
            break
        h.state = other
        switched[j] = True
        h.switches = [t for t in h.switches if at[j] - t <= STRETCH] + [float(at[j])]
        if len(h.switches) > FLAPS:
            h.state, h.until = "COOLDOWN", float(at[j]) + LOCK
        state[j] = h.state
        i = j + 1
    if n and (h.state != "COOLDOWN" or switched[n - 1]):
        h.bad, h.good = int(bad_runs[n - 1]), int(good_runs[n - 1])
    return state, switched


def step(h: Health, at: float, unhealthy: bool) -> bool:
    """Move on by one observation at a time in seconds; whether the state changed."""
    return bool(move(h, np.array([at]), np.array([unhealthy]))[1][0])


def _moved(component: str, rows: pd.DataFrame, h: Health) -> pd.DataFrame:
    at = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
    state, switched = move(h, at, rows["unhealthy"].to_numpy(dtype=bool))
    return pd.DataFrame({"component": component, "ts": rows["ts"].to_numpy(), "state": state, "switched": switched})


def health_states(observations: DataFrame) -> DataFrame:
    """Batch: (component, ts, unhealthy) in order of ts, of equal ones the healthy first, to (component, ts, state, switched).

    Rows with a NULL in one of the three are left out. A component's state depends on all
    that came before, so it is one sequence; it streams through in sorted batches and is
    never held as a whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, h = None, Health()
        for frame in frames:
            for component, rows in frame.groupby("component", sort=False):
                if component != name:
                    name, h = component, Health()
                yield _moved(component, rows, h)

    rows = observations.select("component", "ts", "unhealthy").where("component IS NOT NULL AND ts IS NOT NULL AND unhealthy IS NOT NULL")
    return rows.repartition("component").sortWithinPartitions("component", "ts", "unhealthy").mapInPandas(run, OUT)


def stream_states(observations: DataFrame) -> DataFrame:
    """Streaming: the same with the state kept between triggers."""

    def more(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h = Health(*state.get[:3], list(state.get[3]), state.get[4]) if state.exists else Health()
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "unhealthy"], kind="stable")
        out = _moved(key[0], rows, h)
        state.update((h.state, h.bad, h.good, h.switches, h.until))
        yield out

    return observations.groupBy("component").applyInPandasWithState(
        more, OUT, "state string, bad int, good int, switches array<double>, until double", "append", GroupStateTimeout.NoTimeout
    )
