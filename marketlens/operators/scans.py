"""Sequential scans over series of any length: smoothing, hysteresis, greedy event choice and a contrarian back-test.

A series is cut into segments by time.  Each segment first says what it does to any state that could enter it (an affine map, or a
table of the few states that differ); one small pass over these, a row a segment, carries the state of each series from segment to
segment; then every segment runs from the state that enters it.  So a task holds one segment's rows, whatever the length of a series,
and results equal those of one loop over the whole series.

Rows of a segment are taken in the order of ``order`` (equal ones as they come, nulls last, in a segment of their own); null keys are a
series too.  Extra columns are kept.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

Width = str | float | None


class Scan:
    """What a segment does: ``start`` is the state before the first row; states and folded segments are plain JSON values."""

    start: Any = None

    def fold(self, rows: pd.DataFrame) -> Any:
        """What the segment does to any state that enters it."""
        raise NotImplementedError

    def carry(self, state: Any, folded: Any) -> Any:
        """The state behind a segment that ``state`` enters."""
        raise NotImplementedError

    def run(self, rows: pd.DataFrame, state: Any, last: bool) -> pd.DataFrame:
        """The segment's result; ``last`` if no segment of the series follows."""
        raise NotImplementedError


def _ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if not names or f.name in names)


def segmented(df: DataFrame, scan: Scan, key: str | Sequence[str], order: str, schema: str, width: Width = None) -> DataFrame:
    """Runs ``scan`` over each series of ``df``; segments are units of ``date_trunc`` (a year), or ``width`` wide where ``order`` is a number."""
    keys = [key] if isinstance(key, str) else list(key)
    width = width or (10_000 if isinstance(df.schema[order].dataType, NumericType) else "year")
    slot = F.date_trunc(width, order).cast("timestamp_ntz") if isinstance(width, str) else F.floor(F.col(order) / width)
    cut = df.withColumn("_slot", slot)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[*keys, "_slot"]].iloc[:1].assign(_folded=json.dumps(scan.fold(rows.sort_values(order, kind="stable"))))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, entering = rows.sort_values("_slot", kind="stable"), scan.start, []
        for folded in rows["_folded"]:
            entering.append(json.dumps(state))
            state = scan.carry(state, json.loads(folded))
        return rows[[*keys, "_slot"]].assign(_state=entering, _last=np.arange(len(rows)) == len(rows) - 1)

    def run(rows: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        return scan.run(rows.sort_values(order, kind="stable").drop(columns="_slot"), json.loads(entering["_state"].iloc[0]), bool(entering["_last"].iloc[0]))

    at = _ddl(cut, *keys, "_slot")
    folded = cut.groupBy(*keys, "_slot").applyInPandas(fold, f"{at}, _folded string")
    states = folded.groupBy(*keys).applyInPandas(carry, f"{at}, _state string, _last boolean")
    return cut.groupBy(*keys, "_slot").cogroup(states.groupBy(*keys, "_slot")).applyInPandas(run, schema)


class Smoothing(Scan):
    """s = alpha x + (1 - alpha) s; a segment multiplies the state by a power and adds its own part."""

    def __init__(self, col: str, alpha: float, out: str, first: float | None):
        self.col, self.alpha, self.out, self.start = col, alpha, out, first

    def _over(self, xs: pd.Series, state: float | None) -> pd.Series:
        xs = xs.astype("float64")
        before = pd.Series([np.nan if state is None else state])
        return pd.concat([before, xs], ignore_index=True).ewm(alpha=self.alpha, adjust=False, ignore_na=True).mean().iloc[1:]

    def fold(self, rows):
        xs = rows[self.col]
        if not xs.notna().any():
            return None
        return [(1 - self.alpha) ** int(xs.notna().sum()), float(self._over(xs, 0.0).iloc[-1]), float(self._over(xs, None).iloc[-1])]

    def carry(self, state, folded):
        if folded is None:
            return state
        decay, added, alone = folded
        return alone if state is None else decay * state + added

    def run(self, rows, state, last):
        return rows.assign(**{self.out: self._over(rows[self.col], state).to_numpy()})


def ewma(df: DataFrame, col: str, alpha: float, key: str = "symbol", order: str = "date", out: str = "ewma", first: float | None = None, width: Width = None) -> DataFrame:
    """s = alpha x + (1 - alpha) s, from ``first`` or else the first value; nulls keep the state."""
    smoothed = segmented(df, Smoothing(col, alpha, out, first), key, order, f"{_ddl(df)}, `{out}` double", width)
    return smoothed.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


class Hysteresis(Scan):
    """State and steps in it.  What follows depends on the state and on whether it has lasted, so a segment's table has an entry
    for each state it may meet and each number of steps below ``hold``; any longer stay acts alike."""

    def __init__(self, candidate: str, hold: int, override: str, names: tuple[str, ...], out: str, steps: str | None):
        self.candidate, self.hold, self.override, self.names, self.out, self.steps = candidate, hold, override, names, out, steps
        self.start = [names[0], 0]

    def _take(self, state: str, steps: int, candidate: str) -> tuple[str, int]:
        taken = candidate if candidate == self.override or steps >= self.hold else state
        return taken, steps + 1 if taken == state else 1

    def fold(self, rows):
        table = {}
        candidates = rows[self.candidate].tolist()
        # entries that came to the same state go on as one
        live = {(s, n, False): [(s, n)] for s in {*self.names, *candidates} for n in range(self.hold + 1)}
        for c in candidates:
            after: dict = {}
            for (state, steps, switched), entries in live.items():
                taken, n = self._take(state, steps, c)
                after.setdefault((taken, n, switched or taken != state), []).extend(entries)
            live = after
        for (state, steps, switched), entries in live.items():
            for s, n in entries:
                table[f"{s}|{n}"] = [state, steps if switched else None]
        return [len(candidates), table]

    def carry(self, state, folded):
        rows, table = folded
        name, steps = state
        # a state that no segment before could have entered does not occur
        after, since = table.get(f"{name}|{min(steps, self.hold)}", [name, None])
        return [after, steps + rows if since is None else since]

    def run(self, rows, state, last):
        name, steps = state
        taken = []
        for c in rows[self.candidate]:
            name, steps = self._take(name, steps, c)
            taken.append((name, steps))
        out = rows.assign(**{self.out: [t[0] for t in taken]})
        return out if self.steps is None else out.assign(**{self.steps: np.array([t[1] for t in taken], np.int64)})


# The states of the regime detector, the first being where a series starts.
STATES = ("neutral", "bullish", "bearish", "crisis", "regulatory")


def hysteresis(df: DataFrame, candidate: str, hold: int = 3, key: str = "symbol", order: str = "date", out: str = "state", override: str = "crisis", steps: str | None = None, names: tuple[str, ...] = STATES, width: Width = None) -> DataFrame:
    """A new state is taken after at least ``hold`` steps in the present one; the override at once.  Starts neutral with no steps.

    ``names`` are the states that occur; ``steps`` names a column for the steps in the state, this one included."""
    extra = f", `{out}` string" + (f", `{steps}` long" if steps else "")
    return segmented(df, Hysteresis(candidate, hold, override, names, out, steps), key, order, _ddl(df) + extra, width)


class Spacing(Scan):
    """Greedy choice; a segment's table tells, for each distance of its first row from the last chosen one, which is chosen last."""

    def __init__(self, gap: int, row: str):
        self.gap, self.row = gap, row

    def _chosen(self, at: np.ndarray, least: int) -> list[int]:
        """Places chosen, the first at or after row ``least``."""
        out = []
        i = int(np.searchsorted(at, least))
        while i < len(at):
            out.append(i)
            i = int(np.searchsorted(at, at[i] + self.gap))
        return out

    def fold(self, rows):
        at = rows[self.row].to_numpy(np.int64)
        lasts = []
        for distance in range(1, self.gap + 1):
            chosen = self._chosen(at, int(at[0]) + self.gap - distance)
            lasts.append(int(at[chosen[-1]]) if chosen else None)
        return [int(at[0]), lasts]

    def carry(self, state, folded):
        first, lasts = folded
        last = lasts[self.gap - 1 if state is None else max(1, min(self.gap, first - state)) - 1]
        return state if last is None else last

    def run(self, rows, state, last):
        at = rows[self.row].to_numpy(np.int64)
        return rows.iloc[self._chosen(at, int(at[0]) if state is None else state + self.gap)]


def spaced_events(events: DataFrame, gap: int, row: str = "n", key: str | list[str] = "symbol", width: float = 50_000) -> DataFrame:
    """Greedy choice of events at least ``gap`` rows apart, per key; ``row`` is an event's row number, different for each."""
    return segmented(events, Spacing(gap, row), key, row, _ddl(events), width)


class Contrarian(Scan):
    """A position or none.  A position acts by the rows it was held alone, so a segment's table has an entry for none and for each
    number of rows below ``hold``; when and at what price it was entered travels with the state."""

    def __init__(self, key: str, hold: int, cost: float):
        self.key, self.hold, self.cost = key, hold, cost

    def _trades(self, rows: pd.DataFrame, state: list | None, last: bool) -> tuple[list | None, list[tuple]]:
        """(position after the rows, trades closed in them); a position is [rows held, day entered, price]."""
        out, n = [], len(rows)
        for i, (d, c, r) in enumerate(zip(rows["date"], rows["close"], rows["regime"])):
            if state is None:
                state = [0, str(d), float(c)] if r == "extreme_fear" else None
                continue
            state = [state[0] + 1, *state[1:]]
            if r not in ("extreme_fear", "fear") or state[0] >= self.hold or (last and i == n - 1):
                out.append((state[1], str(d), state[0], float(c) / state[2] - 1 - self.cost))
                state = None
        return state, out

    def fold(self, rows):
        entered = [None, *[[h, None, 1.0] for h in range(self.hold)]]
        return [self._trades(rows, e, False)[0] for e in entered]

    def carry(self, state, folded):
        after = folded[0 if state is None else state[0] + 1]
        return [after[0], *state[1:]] if after is not None and after[1] is None else after

    def run(self, rows, state, last):
        out = pd.DataFrame(self._trades(rows, state, last)[1], columns=["entered", "exited", "held", "net"])
        return out.assign(**{self.key: rows[self.key].iloc[0]})[[self.key, "entered", "exited", "held", "net"]]


def contrarian_trades(df: DataFrame, hold: int = 10, cost: float = 0.002, key: str = "symbol", width: Width = None) -> DataFrame:
    """Enter on extreme fear, leave outside the fear zone, after ``hold`` rows or at the last one; one row per closed trade."""
    rows = df.select(key, "date", "close", "regime")
    out = segmented(rows, Contrarian(key, hold, cost), key, "date", f"{_ddl(rows, key)}, entered string, exited string, held long, net double", width)
    return out.withColumns({c: F.col(c).cast("date") for c in ("entered", "exited")})
