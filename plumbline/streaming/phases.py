"""The phase machine on a live stream, as state that composes.

One snapshot is a map from the state before it to the state after it. The state has two parts, whether the run
was inferring and the memory floor it entered inference with, and a map only has to say what it makes of "was
inferring" and "was not", and whether it sets a floor or leaves the one before. Maps compose, so a micro-batch
is folded by running maxima over arrays, and a run keeps one small value of state, whatever has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Names of the phases by number.
PHASES = np.array(["waking", "loadingModel", "inferring"], dtype=object)
INFERRING = 2
#: A missing instant as a number, before all others.
NEVER = np.iinfo("int64").min
STATE = "ts long, event_id long, phase int, floor_bytes long"
ROWS = "run_id long, event_id long, phase string, entered boolean, floor_bytes long, late boolean"


def folded(
    phase: np.ndarray, used: np.ndarray, before: int, floor: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """entered, floor and whether there is one, for snapshots in order, from the state before the first.

    A snapshot enters inference if it infers and the one before did not; its floor is that of the last
    entry up to it, which is a running maximum over the places of entries.
    """
    previous = np.concatenate(([before], phase[:-1]))
    entered = (phase == INFERRING) & (previous != INFERRING)
    last = np.maximum.accumulate(np.where(entered, np.arange(len(phase)), -1))
    known = (last >= 0) | (floor is not None)
    return entered, np.where(last >= 0, used[np.maximum(last, 0)], floor or 0), known


class PhaseFold(StatefulProcessor):
    """One value of state per run: the last snapshot's instant and id, its phase, and the floor.

    A micro-batch of a run comes as chunks and is put in order by (ts, event_id) as a whole. A snapshot that
    is not after the state's last one came too late, and one without an instant has no place: it is given
    back with its own phase, marked ``late``, without a floor, and does not change the state, so what was
    given out before stays right.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        times = batch["ts"].to_numpy("datetime64[us]").astype("int64")
        ids = batch["event_id"].to_numpy("int64")
        order = np.lexsort((ids, times))
        batch, times, ids = batch.iloc[order], times[order], ids[order]
        ready, loaded = (batch[c].eq(True).to_numpy(bool) for c in ("available", "model_loaded"))
        phase = np.where(~ready, 0, np.where(~loaded, 1, INFERRING))
        last_ts, last_id, before, floor = self._state.get() if self._state.exists() else (NEVER, 0, 0, None)
        late = (times < last_ts) | (times == NEVER) | ((times == last_ts) & (ids <= last_id))
        n = int(late.sum())  # late ones stand first, as the batch is in order
        entered, floors, known = folded(phase[n:], batch["used_bytes"].fillna(0).to_numpy("int64")[n:], before, floor)
        if n < len(batch):
            self._state.update((int(times[-1]), int(ids[-1]), int(phase[-1]), int(floors[-1]) if known[-1] else None))
        nothing = np.zeros(n, "int64")
        yield pd.DataFrame(
            {
                "run_id": np.full(len(batch), key[0]),
                "event_id": ids,
                "phase": PHASES[phase],
                "entered": np.concatenate((nothing, entered)).astype(bool),
                "floor_bytes": pd.arrays.IntegerArray(
                    np.concatenate((nothing, floors)).astype("int64"), ~np.concatenate((nothing, known)).astype(bool)
                ),
                "late": late,
            }
        )

    def close(self) -> None:
        pass


def phases_stream(telemetry: DataFrame) -> DataFrame:
    """Phase of every snapshot of a live stream: run_id, event_id, phase, entered, floor_bytes, late.

    Over snapshots that arrive in order of their instants this is ``telemetry.phases``, however they are
    cut into micro-batches. Missing readings count as nothing answering.
    """
    return telemetry.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=PhaseFold(), outputStructType=ROWS, outputMode="Append", timeMode="None"
    )
