"""The file state machine, as an ordered fold of a batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructType

from lumenfold.operators.groups import lean, written

MAX_RETRIES = 3
# States, and where each may go.
TRANSITIONS = {
    "discovered": ("processing", "needs_user", "completed", "failed_retryable", "failed_terminal", "archived"),
    "processing": ("processing", "completed", "needs_user", "failed_retryable", "failed_terminal", "archived"),
    "needs_user": ("processing", "needs_user", "completed", "archived", "failed_terminal"),
    "completed": ("processing", "needs_user", "completed", "failed_retryable", "failed_terminal", "archived"),
    "failed_retryable": ("processing", "needs_user", "completed", "failed_retryable", "failed_terminal", "archived"),
    "failed_terminal": ("processing", "needs_user", "completed", "failed_terminal", "archived"),
    "archived": ("discovered", "processing", "completed"),
}
#: What an event asks for.
TARGETS = {"signup": "processing", "view": "completed", "click": "needs_user", "purchase": "archived", "error": "failed_retryable"}


def target_of(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])[event_type]


def step(state: str | None, failures: int, target: str | None) -> tuple[str | None, int]:
    """One move: an illegal or unknown one changes nothing; the third failure is terminal."""
    if target is None or (state is not None and target not in TRANSITIONS[state]):
        return state, failures
    if target == "failed_retryable":
        failures += 1
        if failures >= MAX_RETRIES:
            target = "failed_terminal"
    return target, failures


_PIECES = "key {kind}, piece int, a string, fa int, b string, fb int, failures long, n long"


def fold(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, state, failures, moves) of columns key, seq, target. failures: all that counted; the third is terminal.

    Events are dealt by ranges of (key, seq) and folded in one pass over each sorted range; of ties in seq the smaller target goes first. Only the first and the last key of a range may go on in others: their
    events are reduced to maps from each state, with the failures before it as far as they matter, to the outcome. Moves compose, so a key of any size is many ranges' work, and its maps, one set a range, are
    composed at the end. Null keys are a key of their own."""
    place = [F.col("key"), F.col("seq"), F.col("target")]
    dealt = events.select("key", "seq", "target")
    dealt = (dealt.repartitionByRange(ranges, *place) if ranges else dealt.repartitionByRange(*place)).sortWithinPartitions(*place)
    kind = events.schema["key"].dataType.simpleString()
    starts = [(None, 0)] + [(s, f) for s in TRANSITIONS for f in range(MAX_RETRIES + 1)]

    def folded(state: str | None, failures: int, targets: list) -> tuple[str | None, int]:
        for target in targets:
            state, failures = step(state, failures, target)
        return state, failures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId(), []
        # Of the range's first key, and of any that may be its last, the outcome from every start is kept up to date; other keys only need one.
        now, maps, n, first, any_row = None, {}, 0, True, False

        def given() -> pa.RecordBatch:
            types = (key_type, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            rows = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["key", "piece", "a", "fa", "b", "fb", "failures", "n"])

        def close(last: bool) -> None:
            whole = not (first or last)
            for (state, failures), (s, f) in maps.items():
                if not whole or state is None:
                    out.append((now, None if whole else number, state or "", failures, s or "", min(f, MAX_RETRIES), f - failures, n))

        for batch in batches:
            key_type = batch.column(0).type
            keys, targets = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if not any_row or keys[at] != now:
                    if any_row:
                        close(False)
                        first = False
                    now, maps, n, any_row = keys[at], {x: x for x in starts}, 0, True
                # A key that ends inside this batch, and isn't the first, has one start.
                inside = to < len(keys) and not first and n == 0
                if inside:
                    maps = {(None, 0): (None, 0)}
                run_of = targets[at:to]
                maps = {start: folded(*seen, run_of) for start, seen in maps.items()}
                n += to - at
                at = to
            if out:
                yield given()
        if any_row:
            close(True)
            yield given()

    folds = written(dealt.mapInArrow(lean(run), _PIECES.format(kind=kind)), "folds")
    whole = folds.where("piece is null").select("key", "b", "failures", "n")

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        maps: dict[int, dict] = {}
        for r in group.itertuples():
            maps.setdefault(r.piece, {})[r.a, r.fa] = (r.b, r.fb, r.failures, r.n)
        now, counted, n = ("", 0), 0, 0
        for piece in sorted(maps):
            b, fb, more, moves = maps[piece][now]
            now, counted, n = (b, fb), counted + more, n + moves
        return pd.DataFrame([(group["key"].iloc[0], now[0], counted, n)], columns=["key", "b", "failures", "n"])

    parts = folds.where("piece is not null").groupBy("key").applyInPandas(compose, f"key {kind}, b string, failures long, n long")
    return whole.unionByName(parts).select("key", F.nullif("b", F.lit("")).alias("state"), "failures", F.col("n").alias("moves"))


class StateMachine(StatefulProcessor):
    """The same moves on a stream: state is kept by key and expires after a day without events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", StructType().add("state", StringType()).add("failures", IntegerType()), ttlDurationMs=86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, failures = self._state.get() if self._state.exists() else (None, 0)
        for frame in rows:
            for target in frame.sort_values("seq")["target"]:
                state, failures = step(state, failures, target)
        self._state.update((state, failures))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "failures": [failures]})

    def close(self) -> None:
        pass


def stream_states(events: DataFrame) -> DataFrame:
    """events: a stream of key, seq, target. Needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(StateMachine(), "key long, state string, failures int", "Update", "processingTime")


def debounced(changes: DataFrame, time: str, key: str, gap: str = "4 seconds", late: str = "5 minutes") -> DataFrame:
    """A stream's changes of a key that follow each other within the gap, as one; failures younger than ``late`` aren't final."""
    return changes.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def first_seen(messages: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Incremental sync: a message that comes again is dropped."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
