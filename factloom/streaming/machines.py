"""The machines: documents' lifecycles, states of cases, request throttles, first uploads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import rules
from factloom.streaming import ordered

SECOND = 1_000_000


class Lifecycle(ordered.Machine):
    """A document's status from status messages; a running one that is silent for longer than the timeout is interrupted.

    A message names the status it asks for and its run. Unknown documents can only be queued; a retry queues what
    can be retried; a claim (EXTRACTING) starts a run where a document may be claimed; what a run reports counts
    only while it is the document's current run, after an interruption, too. Every message has an outcome:
    APPLIED, REFUSED, STALE_RUN or NOT_FOUND; an interruption is TIMED_OUT, at the end of the timeout.
    """

    result = "at long, seq string, asked string, run_id string, outcome string, before string, status string, retry_count int"

    def __init__(self, timeout_seconds: int = 300):
        self.timeout = timeout_seconds * SECOND

    def _row(self, state: dict, at: int, seq: str | None, asked: str | None, run: str | None, outcome: str, before: str | None) -> dict:
        return {
            "at": at, "seq": seq, "asked": asked, "run_id": run, "outcome": outcome, "before": before,
            "status": state.get("status"), "retry_count": state.get("retries", 0),
        }

    def _outcome(self, state: dict, asked: str, run: str | None) -> str:
        status = state.get("status")
        if asked == "QUEUED":
            return "APPLIED" if status is None or status in rules.RETRYABLE_STATUSES else "REFUSED"
        if status is None:
            return "NOT_FOUND"
        own = run is not None and run == state.get("run")
        if asked == "EXTRACTING":
            return "APPLIED" if status in rules.CLAIMABLE_STATUSES or (own and status == asked) else "REFUSED"
        return "APPLIED" if own else "STALE_RUN"

    def step(self, state: dict, message: dict) -> Iterator[dict]:
        asked, run, before = message["status"], message["run_id"], state.get("status")
        outcome = self._outcome(state, asked, run)
        if outcome == "APPLIED":
            if asked == "QUEUED":
                state["retries"] = state.get("retries", 0) + (before is not None)
            elif asked == "EXTRACTING":
                state["run"] = run
            state["status"], state["beat"] = asked, message["at"]
        yield self._row(state, message["at"], message["seq"], asked, run, outcome, before)

    def idle(self, state: dict, now: int) -> Iterator[dict]:
        end = self.wake(state)
        if end is not None and now > end:
            before, state["status"] = state["status"], "INTERRUPTED"
            yield self._row(state, end, None, None, state.get("run"), "TIMED_OUT", before)

    def wake(self, state: dict) -> int | None:
        return state["beat"] + self.timeout if state.get("status") in rules.RUNNING_STATUSES else None


class CaseState(ordered.Machine):
    """A case's status and number of documents from its documents' changes of status; a row whenever either changes.

    Three counts are held, whatever the number of documents: all, in flight, and in need of attention.
    """

    result = "at long, seq string, status string, evidence_count long"

    def step(self, state: dict, message: dict) -> Iterator[dict]:
        before, after = message["before"], message["status"]
        seen = (state.get("shown"), state.get("all", 0))
        state["all"] = state.get("all", 0) + (before is None and after is not None)
        for name, statuses in (("busy", rules.IN_FLIGHT_STATUSES), ("due", rules.ATTENTION_STATUSES)):
            state[name] = state.get(name, 0) + (after in statuses) - (before in statuses)
        state["shown"] = "PROCESSING" if state["busy"] else "REVIEW_NEEDED" if state["due"] else "READY"
        if state["all"] and seen != (state["shown"], state["all"]):
            yield {"at": message["at"], "seq": message["seq"], "status": state["shown"], "evidence_count": state["all"]}


class Throttle(ordered.Machine):
    """At most ``most`` accepted requests of a key in any window; refused ones don't count. ``most`` under 1: no limit."""

    result = "at long, seq string, accepted boolean, retry_after long"

    def __init__(self, most: int = 60, window_seconds: int = 60):
        self.most, self.window = most, window_seconds * SECOND

    def step(self, state: dict, message: dict) -> Iterator[dict]:
        at, wait = message["at"], None
        recent = [t for t in state.get("accepted", []) if t > at - self.window]
        if 0 < self.most <= len(recent):
            wait = max(1, (recent[0] + self.window - at) // SECOND)
        elif self.most > 0:
            recent.append(at)
        state["accepted"] = recent
        yield {"at": at, "seq": message["seq"], "accepted": wait is None, "retry_after": wait}


class FirstUpload(ordered.Machine):
    """The first upload of a content is the document; later ones are duplicates of it."""

    result = "at long, evidence_id string, canonical_evidence_id string, is_duplicate boolean"

    def step(self, state: dict, message: dict) -> Iterator[dict]:
        first = state.setdefault("first", message["seq"])
        yield {"at": message["at"], "evidence_id": message["seq"], "canonical_evidence_id": first, "is_duplicate": first != message["seq"]}


def lifecycle(messages: DataFrame, delay: str, timeout_seconds: int = 300, chained: bool = False) -> DataFrame:
    """Outcomes of a stream of messages(case_id, evidence_id, seq, status, run_id, at)."""
    return ordered.stream(messages, Lifecycle(timeout_seconds), ["case_id", "evidence_id"], "at", "seq", ["status", "run_id"], delay, chained)


def lifecycle_batch(messages: DataFrame, now: int | None, timeout_seconds: int = 300) -> DataFrame:
    return ordered.batch(messages, Lifecycle(timeout_seconds), ["case_id", "evidence_id"], "at", "seq", ["status", "run_id"], now)


def _changes(outcomes: DataFrame) -> DataFrame:
    """Changes of status as messages to cases; those of one instant go by document and message."""
    return outcomes.where("status is not null and (before is null or before != status)").withColumn("key", F.concat_ws(":", "evidence_id", "seq"))


def case_states(messages: DataFrame, delay: str, timeout_seconds: int = 300) -> DataFrame:
    """States of cases from the same messages: two stateful operators, one after the other."""
    outcomes = lifecycle(messages, delay, timeout_seconds, chained=True)
    return ordered.follow(_changes(outcomes), CaseState(), ["case_id"], "at", "key", ["before", "status"])


def case_states_batch(messages: DataFrame, now: int | None, timeout_seconds: int = 300) -> DataFrame:
    outcomes = lifecycle_batch(messages, now, timeout_seconds)
    return ordered.batch(_changes(outcomes), CaseState(), ["case_id"], "at", "key", ["before", "status"])


def throttle_key(action: Column, user: Column, ip: Column) -> Column:
    """A named user's requests are counted together, others by address."""
    return F.when(F.trim(user) != "", F.concat(action, F.lit(":user:"), F.trim(user))).otherwise(F.concat(action, F.lit(":ip:"), F.coalesce(ip, F.lit("unknown"))))


def throttle(requests: DataFrame, delay: str, most: int = 60, window_seconds: int = 60) -> DataFrame:
    """Accepted and refused requests of a stream(action, user_id, ip, request_id, at)."""
    keyed = requests.withColumn("key", throttle_key(F.col("action"), F.col("user_id"), F.col("ip")))
    return ordered.stream(keyed, Throttle(most, window_seconds), ["key"], "at", "request_id", ["action"], delay)


def throttle_batch(requests: DataFrame, most: int = 60, window_seconds: int = 60) -> DataFrame:
    """The same over a stored table.

    Where a whole window passes without a request, nothing before it counts any more, so a key's requests are
    cut there and spread over tasks. The cuts come from the windows that hold requests at all, which are
    few and counted before they are moved.
    """
    keyed = requests.withColumn("key", throttle_key(F.col("action"), F.col("user_id"), F.col("ip")))
    keyed = keyed.withColumn("slot", F.floor(F.unix_micros("at") / (window_seconds * SECOND)))
    slots = keyed.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy("slot")
    start = F.when(F.coalesce(F.col("slot") - F.lag("slot").over(order), F.lit(9)) > 1, F.col("slot"))
    slots = slots.withColumn("start", start).withColumn("run", F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = keyed.join(slots.select("key", "slot", "run"), ["key", "slot"])
    return ordered.batch(runs, Throttle(most, window_seconds), ["key"], "at", "request_id", ["action"], cut=["run"])


def first_uploads(uploads: DataFrame, delay: str) -> DataFrame:
    """Every upload of a stream(case_id, user_id, sha256_hash, evidence_id, created_at) with the document it stands for.

    The first is the earliest by created_at, whatever the order of arrival within the delay.
    """
    return ordered.stream(uploads, FirstUpload(), ["case_id", "user_id", "sha256_hash"], "created_at", "evidence_id", ["sha256_hash"], delay)


def drop_repeats(uploads: DataFrame, delay: str) -> DataFrame:
    """Uploads without those whose content came before within the delay: nothing waits, the first to arrive stays."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["case_id", "user_id", "sha256_hash"])


def new_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads of a stream whose content no stored document has; goes before the others for what came long ago."""
    return uploads.join(stored.select("case_id", "user_id", "sha256_hash").distinct(), ["case_id", "user_id", "sha256_hash"], "left_anti")
