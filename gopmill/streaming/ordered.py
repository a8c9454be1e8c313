"""State processors: rows of a key are held back until the watermark passes them, then folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows of a chunk in the state, and about as many as are Python objects or results at a time.
ROWS = 10_000
TYPES = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def millis(stamps: pd.Series) -> pd.Series:
    return stamps.astype("datetime64[ms]").astype("int64")


class InOrder(StatefulProcessor):
    """Folds a key's rows in (time, tie) order however they arrive within the watermark.

    Subclasses name the columns: ``columns`` are kept per pending row after its time in ms, ``pending_schema``
    and ``state_schema`` describe them and the folded state, ``outputs`` the rows they give back. Rows that wait go into the
    state as Arrow chunks of up to ROWS rows while they arrive, and come back as such once the watermark has reached the chunk; so
    memory per key is that of the columns, not of Python rows, of what one watermark step releases. With ``keep_ms`` a key is forgotten once the watermark is that far past its
    last row; rows that come later start it anew. Without it only ``fold`` and ``idle`` forget keys.
    """

    keep_ms: int | None = None
    columns: tuple[str, ...] = ()
    pending_schema = ""
    state_schema = ""
    outputs: tuple[str, ...] = ()

    def start(self, key: tuple) -> tuple:
        """State before the first row."""
        raise NotImplementedError

    def fold(self, key: tuple, state: tuple, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """New state (None to forget the key) and output rows for the next row in order."""
        raise NotImplementedError

    def idle(self, key: tuple, state: tuple, now_ms: int) -> tuple[tuple | None, list[tuple]]:
        """Called once rows up to the watermark are folded."""
        return state, []

    def expired(self, key: tuple, state: tuple) -> list[tuple]:
        """Rows to give back for a key that is forgotten for its age."""
        return []

    def before_rows(self, key: tuple, facts: dict) -> tuple | None:
        """State of a key named by the initial state's row, and the time it counts from; None for no state."""
        return None

    def wake_at(self, state: tuple) -> int | None:
        """When, in ms of event time, ``idle`` should be called even without rows."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "first bigint, rows binary")
        # the time of the last row folded stands before the state
        self.folded = handle.getValueState("folded", f"seen bigint, {self.state_schema}")
        kinds = [TYPES[field.split()[1]] for field in self.pending_schema.split(", ")]
        self.schema = pa.schema(list(zip(("ts", *self.columns), kinds, strict=True)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for facts in initialState.astype(object).where(initialState.notna(), None).to_dict("records"):
            found = self.before_rows(key, facts)
            if found is not None:
                self._keep(*found, [], timerValues.getCurrentWatermarkInMs(), True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, iter(()), timerValues)

    def _table(self, batch: pd.DataFrame) -> pa.Table:
        columns = [millis(batch["ts"]), *[batch[c] for c in self.columns]]
        arrays = [pa.array(c, field.type, from_pandas=True) for c, field in zip(columns, self.schema, strict=True)]
        return pa.Table.from_arrays(arrays, schema=self.schema)

    def _chunks(self, waiting: pa.Table) -> Iterator[tuple[int, bytes]]:
        """The rows in order of time, cut into chunks: time of the first row and the rows."""
        times = waiting.column("ts").to_numpy()
        order = np.argsort(times, kind="stable")
        for at in range(0, len(order), ROWS):
            part = order[at : at + ROWS]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as stream:
                stream.write_table(waiting.take(part))
            yield int(times[part[0]]), sink.getvalue().to_pybytes()

    def _split(self, table: pa.Table, now: int) -> tuple[pa.Table, pa.Table]:
        """Rows that the watermark has passed, and the others."""
        passed = table.column("ts").to_numpy() <= now
        return table.filter(pa.array(passed)), table.filter(pa.array(~passed))

    def _ready(self, tables: list[pa.Table]) -> Iterator[tuple]:
        """Their rows in (time, tie) order, of which about ROWS are Python objects at a time."""
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        tables.clear()
        times = table.column("ts").to_numpy()
        order = np.argsort(times, kind="stable")
        times, at = times[order], 0
        while at < len(order):
            to = int(np.searchsorted(times, times[min(at + ROWS, len(order)) - 1], side="right"))
            rows = list(zip(*(c.to_pylist() for c in table.take(order[at:to]).columns), strict=True))
            if (times[at + 1 : to] == times[at : to - 1]).any():
                rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
            yield from rows
            at = to

    def _advance(self, key: tuple, arrived: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        held = list(self.pending.get()) if self.pending.exists() else []
        ready, waiting = [], [(first, rows) for first, rows in held if first > now]
        if len(waiting) < len(held):
            for first, rows in held:
                if first <= now:
                    passed, later = self._split(pa.ipc.open_stream(rows).read_all(), now)
                    ready.append(passed)
                    waiting += self._chunks(later)
            if waiting:
                self.pending.put(waiting)
            else:
                self.pending.clear()
        known = bool(held)
        wakes = [first for first, _ in waiting]
        del held, waiting
        for batch in arrived:
            passed, later = self._split(self._table(batch), now)
            if passed.num_rows:
                ready.append(passed)
            if later.num_rows:
                chunks = list(self._chunks(later))
                self.pending.appendList(chunks)
                wakes += [first for first, _ in chunks]
        found = self.folded.get()
        known = known or found is not None
        seen, *before = found if found is not None else (None, *self.start(key))
        state = tuple(before)
        given: list[tuple] = []
        for row in self._ready(ready):
            state, out = self.fold(key, state, row)
            given += out
            state = self.start(key) if state is None else state
            seen = row[0]
            if len(given) >= ROWS:
                yield pd.DataFrame(given, columns=list(self.outputs))
                given = []
        state, out = self.idle(key, state, now)
        given += out
        if state is not None and seen is not None and self.keep_ms is not None and not wakes and now >= seen + self.keep_ms:
            given += self.expired(key, state)
            state = None
        self._keep(state, seen, wakes, now, known)
        if given:
            yield pd.DataFrame(given, columns=list(self.outputs))

    def _keep(self, state: tuple | None, seen: int | None, wakes: list[int], now: int, known: bool) -> None:
        """Writes the state and the next time to wake; a key that was not ``known`` has neither yet."""
        if known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if state is not None:
            self.folded.update((seen, *state))
            ends = None if seen is None or self.keep_ms is None else seen + self.keep_ms
            wakes = wakes + [own for own in (self.wake_at(state), ends) if own is not None and own > now]
        elif known:
            self.folded.clear()
        if wakes:
            self.handle.registerTimer(min(wakes))

    def close(self) -> None:
        pass
