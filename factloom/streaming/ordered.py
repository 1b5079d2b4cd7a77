"""State machines over a key's messages in event-time order, as a stream and over stored tables.

A machine is a small object whose ``step(state, message)`` gives the new state and what the
message leads to; ``idle(state, now)`` what the mere passing of time leads to, and
``wake(state)`` when it should be asked. The stream holds messages until the watermark has
passed them, so the outcome doesn't depend on how they were split into batches or in what
order they came, as long as none is later than the watermark allows (those are dropped by the
engine). Over a stored table the same machine reads a key's messages in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from factloom.session import shared_folder


class Machine:
    """What a machine has to give; times are microseconds since 1970."""

    #: DDL of what it gives out, but for the key; ``at`` long is when.
    result: str

    def step(self, state: dict, message: dict) -> Iterator[dict]:
        raise NotImplementedError

    def idle(self, state: dict, now: int) -> Iterator[dict]:
        return iter(())

    def wake(self, state: dict) -> int | None:
        return None


#: Groups that a stream's keys are dealt into. A call to the state costs far more than a message, and a group needs a few.
GROUPS = 1024


class _Ordered(StatefulProcessor):
    """Runs a machine for each key of a group as the watermark moves on.

    The earliest message or wake of a group has a timer, the others wait with it: what is due then is worked off at once.
    """

    def __init__(self, machine: Machine, keys: list[str], types: list[str], chained: bool):
        self.machine, self.keys, self.chained = machine, keys, chained
        self.ddl = ", ".join(f"{k} {t}" for k, t in zip(keys, types))

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("states", f"{self.ddl}, held string, wake long")
        self.waiting = handle.getListState("waiting", f"{self.ddl}, at long, seq string, message string")

    def handleInputRows(self, key, rows, timerValues):
        new = [(*(row[k] for k in self.keys), row.at, row.seq, row.message) for row in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(w[-3] for w in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, n = timerValues.getCurrentWatermarkInMs() * 1000, len(self.keys)
        ready, rest = {}, []
        for w in map(tuple, self.waiting.get()):
            if w[n] <= now:
                ready.setdefault(w[:n], []).append(w[n:])
            else:
                rest.append(w)
        states = {h[:n]: h[n:] for h in map(tuple, self.held.get())}
        due = dict.fromkeys([*ready, *(k for k, (_, wake) in states.items() if wake is not None and wake <= now)])
        out = []
        for k in due:
            state, rows = json.loads(states[k][0]) if k in states else {}, []
            for at, seq, message in sorted(ready.get(k, ())):
                rows += self.machine.idle(state, at)
                rows += self.machine.step(state, {"at": at, "seq": seq} | json.loads(message))
            rows += self.machine.idle(state, now + 1)
            states[k] = (json.dumps(state), self.machine.wake(state))
            out += [(k, row) for row in rows]
        if due:
            self.held.put([(*k, *state) for k, state in states.items()])
            if rest:
                self.waiting.put(rest)
            elif ready:
                self.waiting.clear()
            later = [w[n] for w in rest] + [wake for _, wake in states.values() if wake is not None and wake > now]
            if later:
                self.handle.registerTimer(min(later) // 1000 + 1)
        known = {"time": datetime.fromtimestamp(now // 1000 / 1000 + 0.001, timezone.utc)} if self.chained else {}
        for k, row in out:
            yield Row(**dict(zip(self.keys, k)), **row, **known)

    def close(self) -> None:
        pass


class _AtOnce(StatefulProcessor):
    """Runs a machine on rows that come round by round, each round later than the one before it."""

    def __init__(self, machine: Machine, keys: list[str]):
        self.machine, self.keys = machine, keys

    def init(self, handle) -> None:
        self.held = handle.getValueState("state", "held string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.held.get()
        state = json.loads(held[0]) if held else {}
        for at, seq, message in sorted((row.at, row.seq, row.message) for row in rows):
            for row in self.machine.step(state, {"at": at, "seq": seq} | json.loads(message)):
                yield Row(**dict(zip(self.keys, key)), **row)
        self.held.update((json.dumps(state),))

    def close(self) -> None:
        pass


def _messages(rows: DataFrame, keys: list[str], at: str, seq: str, columns: list[str]) -> DataFrame:
    """Key columns, time in microseconds, order among equal times, and the columns that a machine reads, as text."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    times = [c for c, t in rows.dtypes if t == "timestamp"]  # a watermark stays with its column
    return rows.select(*keys, (F.col(at) if dict(rows.dtypes)[at] == "bigint" else F.unix_micros(at)).alias("at"), F.col(seq).cast("string").alias("seq"), body.alias("message"), *[F.col(c).alias(f"_{c}") for c in times])


def _schema(rows: DataFrame, keys: list[str], machine: Machine) -> str:
    return ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), machine.result])


def stream(rows: DataFrame, machine: Machine, keys: list[str], at: str, seq: str, columns: list[str], delay: str | None, chained: bool = False) -> DataFrame:
    """A stream's outcome, in append mode; messages may come ``delay`` late (None: the rows have a watermark).

    ``chained`` adds ``time``, when an outcome was known, as the event time of a machine that reads this one's rows.
    """
    held = _messages(rows.withWatermark(at, delay) if delay else rows, keys, at, seq, columns)
    types = [rows.schema[k].dataType.simpleString() for k in keys]
    return held.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).groupBy("_group").transformWithState(
        statefulProcessor=_Ordered(machine, keys, types, chained), outputStructType=_schema(rows, keys, machine) + (", time timestamp" if chained else ""),
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="time" if chained else "",
    )


def follow(outcomes: DataFrame, machine: Machine, keys: list[str], at: str, seq: str, columns: list[str]) -> DataFrame:
    """The outcome of a machine that reads another's chained outcomes: they come when the watermark has passed them,
    so each round of them is later than the last, and none has to wait again."""
    held = _messages(outcomes, keys, at, seq, columns)
    return held.groupBy(*keys).transformWithState(
        statefulProcessor=_AtOnce(machine, keys), outputStructType=_schema(outcomes, keys, machine), outputMode="Append", timeMode="None"
    )


def batch(rows: DataFrame, machine: Machine, keys: list[str], at: str, seq: str, columns: list[str], now: int | None = None, cut: list[str] = ()) -> DataFrame:
    """The same outcome over a stored table, up to ``now`` (microseconds; None: no time passes after the last message).

    A task reads the messages of its keys in a stream and holds one state. ``cut`` names further columns that
    split a key where its state is empty anyway, so that one key's messages can be spread over tasks.
    """
    names = [f.split()[0] for f in machine.result.split(", ")]
    group = [*keys, *cut]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out, schema = None, {}, [], None

        def close() -> None:
            if last is not None and now is not None:
                out.extend((last, row) for row in machine.idle(state, now))

        def written() -> pa.RecordBatch:
            columns = [pa.array([k[n] for k, _ in out], schema.field(name).type) for n, name in enumerate(keys)]
            columns += [pa.array([row[n] for _, row in out], t) for n, t in zip(names, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

        for part in it:
            schema = part.schema
            for *key, at, seq, message in zip(*(part.column(c).to_pylist() for c in [*group, "at", "seq", "message"])):
                if key != last:
                    close()
                    last, state = key, {}
                out.extend((key, row) for row in machine.idle(state, at))
                out.extend((key, row) for row in machine.step(state, {"at": at, "seq": seq} | json.loads(message)))
            if out:
                yield written()
        close()
        if out:
            yield written()

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in machine.result.split(", ")]
    held = _messages(rows, group, at, seq, columns).select(*group, "at", "seq", "message")
    dealt = held.repartition(*group).sortWithinPartitions(*group, "at", "seq")
    return dealt.mapInArrow(run, _schema(rows, keys, machine))


def run_to_end(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Work off all that a stream's source holds now, and read the result."""
    spark = out.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}"
    query = (
        out.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def settings(spark: SparkSession) -> SparkSession:
    """State in RocksDB, on the executors' disks and in the checkpoint, so it isn't bounded by memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
