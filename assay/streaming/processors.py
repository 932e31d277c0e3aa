"""Keyed state of the metric-log streams: what a run needs to go on, kept in Spark's state store.

Runs are dealt into buckets by hash, and a bucket is the group that Spark calls with its new rows of one micro-batch: a
call costs milliseconds, so one for every run would outweigh the rows. The processor brings the rows of each run in step
order, and keeps a bounded state per run: a tracker its best row, a window its last rows, a difference the last values. A step
that is not above the run's last one was seen before (a log written twice after a restart) and is skipped. State goes
when the run has been silent for the time to live, if one is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Ordered(StatefulProcessor):
    """Rows of each run of a bucket in step order, after the run's last step that was seen."""

    schema = ""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", f"runs array<struct<run string, at bigint, {self.schema}>>", self.ttl_ms)

    def close(self) -> None:
        """Nothing is held outside the state."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.state.get()
        states = {e[0]: tuple(e) for e in (held[0] if held else []) if self.ttl_ms is None or e[1] + self.ttl_ms > now}
        new = pd.concat(list(rows))
        codes, names = pd.factorize(new["run"], use_na_sentinel=False)
        steps = new["step"].to_numpy()
        order = np.lexsort((steps, codes))
        twice = (np.diff(codes[order]) == 0) & (np.diff(steps[order]) == 0)
        order = order[np.r_[True, ~twice]]
        codes, columns = codes[order], {c: new[c].to_numpy()[order] for c in new.columns if c not in ("run", "_bucket")}
        ends = np.searchsorted(codes, np.arange(len(names) + 1))
        parts, owners = [], []
        for name, low, high in zip(names.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            run = name if isinstance(name, str) else None
            old = states[run][2:] if run in states else None
            if old is not None:
                low += int(np.searchsorted(columns["step"][low:high], old[0], side="right"))
            if low < high:
                out, state = self.follow({c: v[low:high] for c, v in columns.items()}, old)
                states[run] = (run, now, int(columns["step"][high - 1]), *state)
                parts.append(out)
                owners += [run] * len(out["step" if "step" in out else "last_step"])
        self.state.update((list(states.values()),))
        if parts:
            yield self.frame({"run": owners} | {c: [v for part in parts for v in part[c]] for c in parts[0]})

    def frame(self, columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame(columns)

    def work(self, new: pd.DataFrame, old) -> tuple[pd.DataFrame, tuple]:
        """follow, for the rows of one run as a table."""
        out, state = self.follow({c: new[c].to_numpy() for c in new.columns}, old)
        return pd.DataFrame(out), state

    def follow(self, new: dict[str, np.ndarray], old) -> tuple[dict, tuple]:
        """Output columns and state after new rows of one run, which are in step order; old is None or (last step, state...)."""
        raise NotImplementedError


class BestTracker(_Ordered):
    """Best value, rows since it or since the phase began, and the stop; the values of all sets at the best step."""

    schema = "last_step bigint, best double, best_step bigint, idle bigint, phase bigint, stop_step bigint, at_best array<double>, seen_at_best array<bigint>, seen array<bigint>"

    def __init__(self, patience: int, sign: int, stops_from: int, sets: list[str], ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.patience, self.sign, self.stops_from, self.sets = patience, sign, stops_from, sets

    def follow(self, new: dict[str, np.ndarray], old) -> tuple[dict, tuple]:
        none = [None] * len(self.sets)
        _, best, best_step, idle, phase, stop, at_best, seen_at_best, seen = old or (None, None, None, 0, None, None, none, none, none)
        at_best, seen_at_best, seen = list(at_best), list(seen_at_best), list(seen)
        scored = zip(*(new[c].astype(float).tolist() for c in self.sets)) if self.sets else [()] * len(new["step"])
        for step, own, value, row in zip(new["step"].tolist(), new["phase"].tolist(), new["value"].astype(float).tolist(), scored):
            if stop is not None:
                break
            if phase is not None and own > phase:
                idle = 0
            phase = own if phase is None else max(phase, own)
            seen = [step if v == v else s for v, s in zip(row, seen)]
            if value == value and (best is None or self.sign * value > self.sign * best):
                best, best_step, idle = value, step, 0
                at_best, seen_at_best = [v if v == v else None for v in row], seen
            else:
                idle += 1
            if phase >= self.stops_from and idle >= self.patience:
                stop = step
        state = (best, best_step, idle, phase, stop, at_best, seen_at_best, seen)
        out = {"last_step": [int(new["step"][-1])], "best": [best], "best_step": [best_step], "idle": [idle], "stop_step": [stop], "at_best": [at_best], "seen_at_best": [seen_at_best]}
        return out, state

    def frame(self, columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame(columns).astype({"best": "float64", "best_step": "Int64", "stop_step": "Int64"})


class Rolling(_Ordered):
    """Sums over the last rows of a run; all but one of them are the state."""

    def __init__(self, columns: list[str], width: int, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.columns, self.width = columns, width
        self.schema = "last_step bigint, " + ", ".join(f"{c} array<double>" for c in columns)

    def follow(self, new: dict[str, np.ndarray], old) -> tuple[dict, tuple]:
        out, state = {"step": new["step"]}, []
        front = np.full(self.width - 1, np.nan)
        for i, c in enumerate(self.columns):
            line = np.concatenate([front, np.array(old[i + 1] if old else [], float), new[c].astype(float)])
            none = np.isnan(line)
            windows = lambda x: np.lib.stride_tricks.sliding_window_view(x, self.width)[-len(new["step"]):]
            # each sum on its own, so that a value that has left leaves no rounding behind
            out[f"sum_{c}"] = np.where(windows(none).all(axis=1), np.nan, windows(np.where(none, 0.0, line)).sum(axis=1))
            have = len(line) - len(front)
            state.append(line[len(line) - min(have, self.width - 1):].tolist())
        return out, tuple(state)


class Deltas(_Ordered):
    """Difference to the run's last defined value."""

    schema = "last_step bigint, value double"

    def follow(self, new: dict[str, np.ndarray], old) -> tuple[dict, tuple]:
        line = np.r_[np.nan if old is None or old[1] is None else old[1], new["value"].astype(float)]
        # the place of the last defined value up to each row; the one in front may be undefined
        at = np.maximum.accumulate(np.where(np.isnan(line), 0, np.arange(len(line))))
        delta, end = line[1:] - line[at[:-1]], float(line[at[-1]])
        return {"step": new["step"], "delta": delta}, (None if end != end else end,)


class Counters(_Ordered):
    """What each cumulative counter gained since the run's row before; a smaller reading has started again from zero."""

    def __init__(self, columns: list[str], ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.columns = columns
        self.schema = "last_step bigint, " + ", ".join(f"{c} double" for c in columns)

    def follow(self, new: dict[str, np.ndarray], old) -> tuple[dict, tuple]:
        out, state = {"step": new["step"]}, []
        for i, c in enumerate(self.columns):
            own = new[c].astype(float)
            before = np.concatenate([[old[i + 1] if old else 0.0], own[:-1]])
            out[c] = np.where(own < before, own, own - before)
            state.append(float(own[-1]))
        return out, tuple(state)
