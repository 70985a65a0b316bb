"""Streams with state of their own: transport reassembly, count windows and rolling frame features.

Each processor keeps its state in Spark's state store, per conversation or per bus, and gives what its batch form gives
(``protocol.reassemble``, ``windows.sliding_windows``, ``windows.add_features``) however the rows are cut into
micro-batches, and after a restart from the checkpoint. Rows of one key must come in order from one micro-batch to the
next; within a micro-batch they are put in order here. One key is one sequence, so one task handles it; keys are
spread over tasks, and a micro-batch's size is the reader's to bound (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(digits: str) -> int:
    try:
        return int(digits, 16)
    except ValueError:
        return 0


class Reassembler(StatefulProcessor):
    """Messages of one conversation. State: number of the message, frames after its first, size, hex so far, what became of it.

    A message is given out when it is complete or broken, or when no frame came for ``wait_ms`` of processing time. Such
    timers make Spark run batches without data for ever, so a run over what is available must turn those off.
    """

    NONE, OPEN, DONE, BROKEN, STRAY = range(5)

    def __init__(self, key: str, order: str, frame: str, wait_ms: int):
        self.key, self.order, self.frame, self.wait_ms = key, order, frame, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", "message long, n int, size int, body string, status int")

    def _frames(self, key, frames: Iterable[str], state: list) -> Iterator[Row]:
        """Moves ``state`` on by the frames and gives what they end."""
        out = lambda payload, error: Row(**{self.key: key, "message": state[0], "payload": payload, "error": error})
        for f in frames:
            kind = f[:1]
            if kind == "3":
                continue
            if kind in ("0", "1"):
                if state[4] == self.OPEN:
                    yield out(None, "incomplete")
                state[:] = [state[0] + 1, 0, _number(f[1:2] if kind == "0" else f[1:4]), "", self.OPEN]
                body = f[2:16] if kind == "0" else f[4:16]
            else:
                state[1] += 1
                body, fault = f[2:16], None
                if kind != "2":
                    fault = "unknown frame type"
                elif state[4] == self.NONE:
                    fault = "no first frame"
                elif _number(f[1:2]) != state[1] % 16:
                    fault = "bad sequence"
                if state[4] == self.DONE:
                    yield out(None, "no first frame")
                    state[4] = self.STRAY
                elif state[4] in (self.NONE, self.OPEN) and fault:
                    yield out(None, fault)
                    state[4] = self.BROKEN
            if state[4] == self.OPEN:
                state[3] += body
                if len(state[3]) >= 2 * state[2]:
                    yield out(state[3][: 2 * state[2]], None)
                    state[3:] = ["", self.DONE]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = list(self.state.get() or (0, -1, 0, "", self.NONE)) if self.state.exists() else [0, -1, 0, "", self.NONE]
        inputs = sorted((r for r in rows if r[self.frame] is not None), key=lambda r: r[self.order])
        yield from self._frames(key[0], (r[self.frame] for r in inputs), state)
        self.state.update(tuple(state))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state[4] == self.OPEN:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = list(self.state.get())
        if state[4] == self.OPEN:
            self.state.update((state[0], state[1], state[2], "", self.BROKEN))
            yield Row(**{self.key: key[0], "message": state[0], "payload": None, "error": "incomplete"})


class CountWindows(StatefulProcessor):
    """Windows of ``size`` rows every ``stride`` rows of one bus. State: how many rows came, and those that a window to come needs."""

    def __init__(self, bus: str, order: str, columns: list[str], schema: str, size: int, stride: int):
        self.bus, self.order, self.columns, self.schema, self.size, self.stride = bus, order, columns, schema, size, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        ring: deque = deque(self.kept.get() if self.kept.exists() else ())
        for r in sorted(rows, key=lambda r: r[self.order]):
            ring.append(tuple(r[c] for c in self.columns))
            n += 1
            start = n - self.size  # of the window that ends here
            if start >= 0 and start % self.stride == 0:
                for pos, values in enumerate(ring):
                    yield Row(**{self.bus: key[0], "window_id": start // self.stride, "pos": pos, "frame_idx": start + pos}, **dict(zip(self.columns, values, strict=True)))
            first = -(-max(start + 1, 0) // self.stride) * self.stride  # of the earliest window to come
            while ring and n - len(ring) < first:
                ring.popleft()
        self.count.update((n,))
        self.kept.put(list(ring)) if ring else self.kept.clear()


class RollingFeatures(StatefulProcessor):
    """Gap to the last frame of the bus, and share of a frame's identifier in the last ``window`` frames.

    State: how many frames came and when the last one did; for each identifier the indices of its frames in the window. Only
    identifiers that occur are read and written; once a window the ones that have left it are removed.
    """

    def __init__(self, bus: str, order: str, time: str, ident: str, columns: list[str], window: int):
        self.bus, self.order, self.time, self.ident, self.columns, self.window = bus, order, time, ident, columns, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, time double, swept long")
        self.places = handle.getMapState("places", "ident string", "places array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        from math import log1p

        n, last, swept = self.last.get() if self.last.exists() else (0, None, 0)
        used: dict[str, deque] = {}
        for r in sorted(rows, key=lambda r: r[self.order]):
            now, ident = r[self.time], r[self.ident] or ""
            if ident not in used:
                used[ident] = deque(self.places.getValue((ident,))[0] if self.places.containsKey((ident,)) else ())
            mine = used[ident]
            mine.append(n)
            while mine[0] <= n - self.window:
                mine.popleft()
            gap = now - last if now is not None and last is not None else 0.0
            yield Row(
                **{self.bus: key[0], "frame_idx": n}, **{c: r[c] for c in self.columns},
                inter_arrival=log1p(max(gap, 0.0)), id_freq=len(mine) / min(n + 1, self.window),
            )
            n, last = n + 1, now
        for ident, mine in used.items():
            self.places.updateValue((ident,), (list(mine),))
        if n - swept >= self.window:
            for (ident,), (places,) in list(self.places.iterator()):
                if places[-1] <= n - self.window:
                    self.places.removeKey((ident,))
            swept = n
        self.last.update((n, last, swept))


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: str = "none") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.groupBy(key).transformWithState(processor, schema, "append", timers)


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def reassemble(frames: DataFrame, key: str, order: str, frame: str = "frame", wait_ms: int = 5000) -> DataFrame:
    """The stream form of ``protocol.reassemble``: (key, message, payload, error), each message as soon as it is decided."""
    slim = frames.select(key, order, frame)
    return _run(slim, key, Reassembler(key, order, frame, wait_ms), f"{_types(frames, [key])}, message long, payload string, error string", "processingTime")


def count_windows(frames: DataFrame, bus: str, order: str, size: int = 64, stride: int = 32) -> DataFrame:
    """The stream form of ``windows.sliding_windows``, per bus: each row once per full window, with window_id, pos and frame_idx."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    columns = [c for c in frames.columns if c not in (bus, "window_id", "pos", "frame_idx")]
    kept = _types(frames, columns)
    return _run(frames.select(bus, *columns), bus, CountWindows(bus, order, columns, kept, size, stride), f"{_types(frames, [bus])}, window_id long, pos long, frame_idx long, {kept}")


def rolling_features(frames: DataFrame, bus: str, order: str, time: str = "timestamp", ident: str = "can_id", window: int = 1000) -> DataFrame:
    """The stream form of ``windows.add_features``, per bus: frame_idx, inter_arrival and id_freq of every frame."""
    if window < 1:
        raise ValueError("window must be positive")
    columns = [c for c in frames.columns if c not in (bus, "frame_idx", "inter_arrival", "id_freq")]
    made = f"{_types(frames, [bus])}, frame_idx long, {_types(frames, columns)}, inter_arrival double, id_freq double"
    return _run(frames.select(bus, *columns), bus, RollingFeatures(bus, order, time, ident, columns, window), made)
