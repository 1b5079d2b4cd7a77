import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.streaming import machines, ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FAR = START + timedelta(days=4000)
MESSAGES = "case_id string, evidence_id string, seq string, status string, run_id string, at timestamp"


def _when(seconds):
    return START + timedelta(seconds=seconds)


def _micros(seconds):
    return round(START.timestamp() * 1_000_000) + round(seconds * 1_000_000)


def _streamed(spark, batches, schema):
    """Each batch as a file, in order, and a clock at the end."""
    ordered.settings(spark)
    path = f"{session.shared_folder(spark)}/in-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ended(out, key):
    return ordered.run_to_end(out, f"out-{uuid.uuid4().hex}").where(F.col(key).isNotNull())


def _clock(schema, at="at"):
    names = [c.split()[0] for c in schema.split(", ")]
    return [tuple(FAR if n == at else None for n in names)]


def test_lifecycle_by_hand():
    machine = machines.Lifecycle(300)
    state, out = {}, []
    for at, status, run in [
        (0, "READY", "r0"), (1, "QUEUED", None), (2, "QUEUED", None), (10, "EXTRACTING", "r1"), (20, "EXTRACTING", "r2"), (30, "STRUCTURING", "r1"),
        (330, "ANALYZING", "r1"), (631, "READY", "r1"), (700, "EXTRACTING", "r3"), (710, "QUEUED", None), (720, "READY", "r1"), (2000, "QUEUED", None),
    ]:
        at *= machines.SECOND
        out += machine.idle(state, at)
        out += machine.step(state, {"at": at, "seq": "s", "status": status, "run_id": run})
    got = [(r["at"] // machines.SECOND, r["outcome"], r["status"], r["retry_count"]) for r in out]
    assert got == [
        (0, "NOT_FOUND", None, 0), (1, "APPLIED", "QUEUED", 0), (2, "REFUSED", "QUEUED", 0), (10, "APPLIED", "EXTRACTING", 0),
        (20, "REFUSED", "EXTRACTING", 0), (30, "APPLIED", "STRUCTURING", 0), (330, "APPLIED", "ANALYZING", 0),
        (630, "TIMED_OUT", "INTERRUPTED", 0), (631, "APPLIED", "READY", 0), (700, "REFUSED", "READY", 0), (710, "REFUSED", "READY", 0),
        (720, "APPLIED", "READY", 0), (2000, "REFUSED", "READY", 0),
    ]


def test_lifecycle_stream_equals_batch(spark):
    """Messages come in any order within the delay; heartbeats that come late still count, later ones are dropped."""
    rng = random.Random(1)
    statuses = ["QUEUED", "EXTRACTING", "STRUCTURING", "ANALYZING", "READY", "FAILED", "EXTRACTING"]
    rows = [
        (f"c{e % 3}", f"e{e}", str(k), rng.choice(statuses), f"r{e}", _when(rng.uniform(0, 5000)))
        for e in range(12) for k in range(rng.randint(1, 15))
    ]
    rows.sort(key=lambda r: r[5].timestamp() + rng.uniform(0, 900))  # up to 15 minutes late
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :], _clock(MESSAGES)]
    too_late = ("c0", "e0", "late", "QUEUED", "r0", _when(-5000))
    stream = _streamed(spark, [*cut, [too_late]], MESSAGES)
    got = sorted(map(str, _ended(machines.lifecycle(stream, "1 hour", 300), "evidence_id").collect()))
    stored = spark.createDataFrame(rows, MESSAGES)
    now = _micros(10_000_000)
    want = sorted(map(str, machines.lifecycle_batch(stored, now, 300).collect()))
    assert got == want and any("TIMED_OUT" in w for w in want)
    states = sorted(map(str, _ended(machines.case_states(_streamed(spark, cut, MESSAGES), "1 hour", 300), "case_id").collect()))
    assert states == sorted(map(str, machines.case_states_batch(stored, now, 300).collect())) and states
    final = {}
    for r in machines.lifecycle_batch(stored, now, 300).orderBy("at", "seq").collect():
        final[r.evidence_id] = (r.case_id, r.status)
    last = {r.case_id: (r.status, r.evidence_count) for r in machines.case_states_batch(stored, now, 300).orderBy("at", "seq").collect()}
    for case, (status, count) in last.items():
        held = [s for c, s in final.values() if c == case and s]
        busy = any(s in ("QUEUED", "EXTRACTING", "STRUCTURING", "ANALYZING") for s in held)
        assert count == len(held) and status == ("PROCESSING" if busy else "REVIEW_NEEDED" if any(s != "READY" for s in held) else "READY")


def _plain_throttle(rows, most, window):
    """rows: (key, id, seconds); a list of accepted times for each key."""
    held, out = {}, {}
    for key, name, at in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in held.get(key, []) if t > at - window]
        if 0 < most <= len(recent):
            out[name] = (False, max(1, (recent[0] + window - at) // 1_000_000))
        else:
            recent.append(at)
            out[name] = (True, None)
        held[key] = recent
    return out


@pytest.mark.parametrize("most", [0, 1, 4])
def test_throttle(spark, most):
    rng = random.Random(2)
    schema = "action string, user_id string, ip string, request_id string, at timestamp"
    rows = []
    for k in range(600):  # one address is hot
        user = rng.choice(["u1", " u1 ", "u2", "", None])
        rows.append((rng.choice(["up", "get"]), user, rng.choice(["1.1.1.1", None]), f"{k:04d}", _when(rng.choice([rng.uniform(0, 9000), 60 * rng.randint(0, 150)]))))
    plain = []
    for action, user, ip, name, at in rows:
        key = f"{action}:user:{user.strip()}" if user and user.strip() else f"{action}:ip:{ip or 'unknown'}"
        plain.append((key, name, _micros(0) + round((at - START).total_seconds() * 1_000_000)))
    want = _plain_throttle(plain, most, 60 * 1_000_000)
    got = machines.throttle_batch(spark.createDataFrame(rows, schema), most, 60).collect()
    assert {r.seq: (r.accepted, r.retry_after) for r in got} == want and len(got) == 600
    if most == 4:
        rows.sort(key=lambda r: r[4].timestamp() + rng.uniform(0, 300))
        stream = _streamed(spark, [rows[:200], rows[200:], _clock(schema)], schema)
        got = _ended(machines.throttle(stream, "10 minutes", most, 60), "seq").collect()
        assert {r.seq: (r.accepted, r.retry_after) for r in got} == want


def test_uploads_in_any_order(spark):
    rng = random.Random(3)
    schema = "case_id string, user_id string, sha256_hash string, evidence_id string, created_at timestamp"
    rows = [(f"c{rng.randint(0, 2)}", "u", f"h{rng.randint(0, 9)}", f"e{k:03d}", _when(rng.randint(0, 3000))) for k in range(150)]
    first = {}
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        first.setdefault(r[:3], r[3])
    for seed in (4, 5):
        random.Random(seed).shuffle(rows)
        batches = [rows[:40], rows[40:90], rows[90:], _clock(schema, "created_at")]
        got = _ended(machines.first_uploads(_streamed(spark, batches, schema), "1 hour"), "case_id").collect()
        assert len(got) == 150
        assert {(r.case_id, r.user_id, r.sha256_hash, r.canonical_evidence_id) for r in got} == {(*k, v) for k, v in first.items()}
        assert all(r.is_duplicate == (r.evidence_id != r.canonical_evidence_id) for r in got)
    stream = machines.drop_repeats(_streamed(spark, batches[:3], schema), "1 hour")
    got = ordered.run_to_end(stream, f"out-{uuid.uuid4().hex}").collect()
    assert len(got) == len(first) and {(r.case_id, r.user_id, r.sha256_hash) for r in got} == set(first)
    stored = spark.createDataFrame([("c0", "u", "h1")], "case_id string, user_id string, sha256_hash string")
    assert machines.new_uploads(spark.createDataFrame(rows, schema), stored).where("case_id = 'c0' and sha256_hash = 'h1'").count() == 0


def test_findings_kept_up_to_date(spark):
    """Whatever the order and the cut of the batches, and if one comes twice, the table is what all events give."""
    from factloom.streaming import incremental

    def detect(evidence, events):
        # a reference that two events of a case share; and documents without events
        pairs = events.groupBy("case_id", "ref").agg(F.count("*").alias("n")).where("n > 1")
        silent = evidence.join(events.select("case_id", "evidence_id"), ["case_id", "evidence_id"], "left_anti")
        return pairs.select("case_id", F.concat(F.lit("f-"), "ref").alias("finding_id"), "n").unionByName(
            silent.select("case_id", F.concat(F.lit("s-"), "evidence_id").alias("finding_id"), F.lit(0).cast("long").alias("n"))
        )

    rng = random.Random(6)
    events = [(f"c{rng.randint(0, 7)}", f"d{rng.randint(0, 3)}", f"e{k}", f"r{rng.randint(0, 9)}") for k in range(90)]
    evidence = spark.createDataFrame([(f"c{c}", f"d{d}") for c in range(8) for d in range(5)], "case_id string, evidence_id string")
    schema = "case_id string, evidence_id string, event_id string, ref string"
    want = {tuple(r) for r in detect(evidence, spark.createDataFrame(events, schema)).collect()}
    for seed, cuts in ((1, (30, 60)), (2, (1, 80))):
        random.Random(seed).shuffle(events)
        store = f"{session.shared_folder(spark)}/store-{uuid.uuid4().hex}"
        assert incremental.current(spark, store) is None
        parts = [events[: cuts[0]], events[cuts[0] : cuts[1]], [], events[cuts[1] :] + events[:3]]
        for number, part in enumerate(parts):
            for _ in range(2 if number == 1 else 1):
                incremental.update(spark.createDataFrame(part, schema), number, evidence, store, detect, 4)
        got = incremental.current(spark, store).select("case_id", "finding_id", "n").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


class _Handle:
    """State of one group that counts the calls to it, as each is a message between processes."""

    def __init__(self):
        self.calls, self.timers, self.lists = 0, [], {}

    def getListState(self, name, schema):
        handle, held = self, self.lists.setdefault(name, [])

        class State:
            def get(self):
                handle.calls += 1
                return iter(list(held))

            def appendList(self, rows):
                handle.calls += 1
                held.extend(rows)

            def put(self, rows):
                handle.calls += 1
                held[:] = rows

            def clear(self):
                handle.calls += 1
                held.clear()

        return State()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_group_of_keys_needs_few_calls_to_the_state(spark):
    handle = _Handle()
    processor = ordered._Ordered(machines.Lifecycle(300), ["case_id", "evidence_id"], ["string", "string"], False)
    processor.init(handle)
    rows = [("c", f"e{k % 40}", str(k), "QUEUED" if k < 40 else "EXTRACTING", f"r{k % 40}", _when(k * 10)) for k in range(400)]
    stored = spark.createDataFrame(rows, MESSAGES)
    sent = ordered._messages(stored, ["case_id", "evidence_id"], "at", "seq", ["status", "run_id"]).collect()
    random.Random(8).shuffle(sent)
    got = []
    for part in (sent[:150], sent[150:]):
        assert list(processor.handleInputRows((1,), iter(part), None)) == []
    for seconds in (2000, 3000, 5000):
        ms = _micros(seconds) // 1000
        assert min(handle.timers) <= ms
        got += processor.handleExpiredTimer((1,), _Watermark(ms), None)
        handle.timers = [t for t in handle.timers if t > ms]
    want = machines.lifecycle_batch(stored, _micros(90000), 300).collect()
    assert sorted(str(sorted(r.asDict().items())) for r in got) == sorted(str(sorted(r.asDict().items())) for r in want)
    assert handle.calls < 20
