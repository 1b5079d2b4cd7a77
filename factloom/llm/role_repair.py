"""Operator 13: conversation structure repair by generalised LR parsing.

The roles of a conversation's rows should be a sentence of a role grammar. Its LR automaton is
run over the rows with weighted edits: a row is kept, reroled or deleted, and rows without text
are inserted. Stacks share their lower parts (a graph-structured stack: a node is a state over
another node), and where two ways end in an equal stack, the one with the least (cost, audit)
stays. The audit is the string of the edits' initials. What an edit can do to a stack is worked
out once and looked up afterwards.

After a row all audits hold as many rows' letters and end in one, so none begins another, and
comparing them is comparing where they first differ: the order of the audits so far and the
letters since decide, without reading the audits again.

Rows are dealt out by ranges of (conversation, order), so a conversation of any size is cut
over tasks. A task gives for each of its conversations the least (cost, audit) from every stack
it may be entered with to every stack it is left with; these maps are put together afterwards.
The repaired text is hashed in a second pass that streams a conversation's rows in order, as
SHA-256 must read them; only its audit is held. A result row has a conversation's whole audit,
a letter an edit.

Defined results: a null role or text counts as one space; rows of a conversation go by turn,
nulls first, those of one turn by role and then by the text's SHA-256 (equal rows may change
places); rows with a null conversation are one conversation; a role is legal by its first
letter; blank and repeated rows are always deleted; a conversation without rows that count is
legal as it is, with an empty audit; an empty table gives an empty result; texts are whole;
other columns aren't used.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches
from factloom.session import materialize

#: Costs of edits; a truncated row that isn't deleted costs as much as an insertion more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of texts, and what a whole text ends in.
SPACE, STOPS = " \t\n\x0b\f\r", ".!?"
#: What rows can become, by the terminal of the grammar.
ROLES = {"u": "user", "a": "assistant"}
#: ( s? (ua)+ )? : an optional system row, then pairs of user and assistant; or nothing.
DIALOGUE = (("dialogue", ()), ("dialogue", ("pairs",)), ("dialogue", ("s", "pairs")), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
#: Faults of rows; the first that holds counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
_LEGAL_NEIGHBOURS = ("su", "ua", "au")
#: Rows after which ways back are written as strings.
BLOCK = 1024


class Grammar:
    """The stacks of a grammar's LR automaton. A stack is a number; 0 is the empty one."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...], most: int = 64):
        self.rules = (("", (rules[0][0],)), *rules)
        self.names = {left for left, _ in rules}
        self._automaton()
        self.nodes = [(0, -1)]  # state, node below
        self.number = {self.nodes[0]: 0}
        self.terminals = sorted({x for _, right in rules for x in right} - self.names)
        self.shifts: dict[tuple[int, str], tuple[int, ...]] = {}
        reached = [0]
        for node in reached:
            for terminal in self.terminals:
                for to in self.shift(node, terminal):
                    if to not in reached:
                        reached.append(to)
            if len(reached) > most:
                raise ValueError("the grammar needs stacks without bound, so a conversation can't be cut")
        self.reached = reached
        self.next = {n: [t for t in ROLES if self.shift(n, t)] for n in reached}
        if any(len(t) > 1 for t in self.next.values()):
            raise ValueError("what a row is reroled to must follow from the stack")

    def _automaton(self) -> None:
        """Item sets with their steps, and the symbols that can follow a name."""
        rules = self.rules

        def closed(items: frozenset) -> frozenset:
            out = list(items)
            for rule, dot in out:
                right = rules[rule][1]
                if dot < len(right):
                    out += [(k, 0) for k, (left, _) in enumerate(rules) if left == right[dot] and (k, 0) not in out]
            return frozenset(out)

        self.sets, self.step = [closed(frozenset({(0, 0)}))], {}
        for k, items in enumerate(self.sets):
            for symbol in {rules[r][1][d] for r, d in items if d < len(rules[r][1])}:
                into = closed(frozenset((r, d + 1) for r, d in items if d < len(rules[r][1]) and rules[r][1][d] == symbol))
                if into not in self.sets:
                    self.sets.append(into)
                self.step[k, symbol] = self.sets.index(into)
        empty: set[str] = set()
        first = {n: set() for n in self.names}
        follow = {n: set() for n in (*self.names, "")}
        follow[""].add("")  # the end
        size = -1
        while size != (size := len(empty) + sum(map(len, (*first.values(), *follow.values())))):
            for left, right in rules:
                ahead = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= ahead
                        ahead = first[symbol] | (ahead if symbol in empty else set())
                    else:
                        ahead = {symbol}
                if left:
                    if all(s in empty for s in right):
                        empty.add(left)
                    for symbol in right:
                        first[left] |= first[symbol] if symbol in self.names else {symbol}
                        if symbol not in empty:
                            break
        self.follow = follow

    def _node(self, state: int, below: int) -> int:
        node = (state, below)
        if node not in self.number:
            self.number[node] = len(self.nodes)
            self.nodes.append(node)
        return self.number[node]

    def _reduced(self, node: int, ahead: str | None) -> list[int]:
        """The stacks that reductions give, the stack itself first; ahead None: only where nothing else can be done."""
        out = [node]
        for at in out:
            items = self.sets[self.nodes[at][0]]
            for rule, dot in items:
                left, right = self.rules[rule]
                if dot < len(right) or not rule or (len(items) > 1 if ahead is None else ahead not in self.follow[left]):
                    continue
                below = at
                for _ in right:
                    below = self.nodes[below][1]
                to = self._node(self.step[self.nodes[below][0], left], below)
                if to not in out:
                    out.append(to)
        return out

    def shift(self, node: int, terminal: str) -> tuple[int, ...]:
        """The stacks after a terminal."""
        if (node, terminal) not in self.shifts:
            out = []
            for at in self._reduced(node, terminal):
                state = self.step.get((self.nodes[at][0], terminal))
                if state is not None and terminal not in self.names:
                    out.append(self._reduced(self._node(state, at), None)[-1])
            self.shifts[node, terminal] = tuple(dict.fromkeys(out))
        return self.shifts[node, terminal]

    @functools.cache
    def accepts(self, node: int) -> bool:
        return any((0, 1) in self.sets[self.nodes[at][0]] for at in self._reduced(node, ""))

    @functools.cache
    def inserted(self, node: int) -> list[tuple[int, int, str]]:
        """Stacks that insertions lead to, with cost and letters; each the shortest way."""
        out = {node: (0, "")}
        for at in (order := [node]):
            for terminal in self.next[at]:
                for to in self.shift(at, terminal):
                    if to not in out:
                        out[to] = (out[at][0] + INSERT, out[at][1] + "I")
                        order.append(to)
        return [(to, *way) for to, way in out.items()]

    @functools.cache
    def moves(self, node: int, initial: str, fault: int) -> list[tuple[int, int, str]]:
        """What a row can do to a stack, insertions before it included: (stack, cost, letters), the least of each stack."""
        best: dict[int, tuple[int, str]] = {}

        def offer(to: int, cost: int, letters: str) -> None:
            if to not in best or (cost, letters) < best[to]:
                best[to] = (cost, letters)

        more = TRUNCATED if fault == CUT else 0
        for at, cost, letters in self.inserted(node):
            offer(at, cost + DELETE, letters + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            for to in self.shift(at, initial) if initial in self.terminals else ():
                offer(to, cost + KEEP + more, letters + "K")
            for terminal in self.next[at]:
                for to in self.shift(at, terminal):
                    offer(to, cost + REROLE + more, letters + "R")
        return [(to, *way) for to, way in best.items()]


grammar = functools.cache(lambda rules: Grammar(rules))


class Ways:
    """The least way from one stack to each stack, over rows that are added one by one."""

    def __init__(self, rules: Grammar, entry: int):
        self.rules = rules
        self.tops = {entry: (0, 0)}  # stack -> cost, place of its audit among all
        self.done = {entry: ""}  # audits up to the last block
        self.back: list[dict[int, tuple[int, str]]] = []

    def add(self, initial: str, fault: int) -> None:
        best: dict[int, tuple] = {}
        for at, (cost, place) in self.tops.items():
            for to, more, letters in self.rules.moves(at, initial, fault):
                way = (cost + more, place, letters, at)
                if to not in best or way < best[to]:
                    best[to] = way
        places = {x: k for k, x in enumerate(sorted({way[1:3] for way in best.values()}))}
        self.tops = {to: (way[0], places[way[1:3]]) for to, way in best.items()}
        self.back.append({to: (way[3], way[2]) for to, way in best.items()})
        if len(self.back) == BLOCK:
            self._write()

    def _write(self) -> None:
        audits = {}
        for top in self.tops:
            at, letters = top, []
            for step in reversed(self.back):
                at, new = step[at]
                letters.append(new)
            audits[top] = self.done[at] + "".join(reversed(letters))
        self.done, self.back = audits, []

    def all(self) -> dict[int, tuple[int, str]]:
        """Each stack's cost and audit."""
        self._write()
        return {top: (cost, self.done[top]) for top, (cost, _) in self.tops.items()}


def finished(rules: Grammar, ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) that ends in a sentence."""
    return min(
        (cost + more, audit + letters)
        for top, (cost, audit) in ways.items() for to, more, letters in rules.inserted(top) if rules.accepts(to)
    )


_CHUNK = (
    "part long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, "
    "turns long, ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
)
_FIELDS = [c.split()[0] for c in _CHUNK.split(", ")]


def _chunks(it: Iterator[pa.RecordBatch], rules: tuple) -> Iterator[pa.RecordBatch]:
    """A row for each run of one conversation's rows in this task."""
    parser, part = grammar(rules), TaskContext.get().partitionId()
    kind, conv, ways, seen = pa.null(), None, None, None
    convs, out = [], []
    entered = False  # the first conversation may have begun in another task

    def close() -> None:
        convs.append(conv)
        out.append(seen | {"ways": [
            {"entry": e, "exit": x, "cost": c, "audit": a} for e, w in ways.items() for x, (c, a) in w.all().items()
        ]})

    def written() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(convs, kind), *(pa.array([o[f] for o in out], t) for f, t in _TYPES.items())], names=["conv", *_FIELDS]
        )
        convs.clear()
        out.clear()
        return batch

    for batch in it:
        kind = batch.schema.field("conv").type
        columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "there"))
        for key, turn, initial, fault, there in zip(*columns):
            if seen is None or key != conv:
                if seen is not None:
                    close()
                conv = key
                ways = {e: Ways(parser, e) for e in ([0] if entered else parser.reached)}
                entered = True
                seen = dict.fromkeys(_FIELDS) | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"part": part}
            if not there:
                continue
            if fault:
                seen[("", "blank", "duplicate", "truncated")[fault]] += 1
            if seen["last"] is not None:
                seen["illegal"] += seen["last"] + initial not in _LEGAL_NEIGHBOURS
            else:
                seen["first"] = initial
            seen["last"] = initial
            if turn is not None and turn != seen["last_turn"]:
                seen["turns"] += 1
                seen["last_turn"] = turn
                if seen["first_turn"] is None:
                    seen["first_turn"] = turn
            for way in ways.values():
                way.add(initial, fault)
        if out:
            yield written()
    if seen is not None:
        close()
        yield written()


_TYPES = {f: pa.string() if f in ("first", "last") else pa.int64() for f in _FIELDS[:-1]} | {
    "ways": pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
}
_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """One conversation in the second pass: its chunks' maps come first, then its rows."""

    def __init__(self, parser: Grammar, conv):
        self.parser, self.conv = parser, conv
        self.ways, self.seen, self.audit = {0: (0, "")}, None, None

    def chunk(self, new: dict) -> None:
        best: dict[int, tuple[int, str]] = {}
        for w in new["ways"]:
            if w["entry"] in self.ways:
                cost, audit = self.ways[w["entry"]]
                if w["exit"] not in best or cost + w["cost"] < best[w["exit"]][0] or (
                    cost + w["cost"] == best[w["exit"]][0] and audit + w["audit"] < best[w["exit"]][1]
                ):
                    best[w["exit"]] = (cost + w["cost"], audit + w["audit"])
        self.ways = best
        if self.seen is None:
            self.seen = new
            return
        old = self.seen
        self.seen = {k: old[k] + new[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        if old["last"] is not None and new["first"] is not None:
            self.seen["illegal"] += old["last"] + new["first"] not in _LEGAL_NEIGHBOURS
        if None not in (old["last_turn"], new["first_turn"]) and old["last_turn"] == new["first_turn"]:
            self.seen["turns"] -= 1
        for name, a, b in (("first", old, new), ("last", new, old), ("first_turn", old, new), ("last_turn", new, old)):
            self.seen[name] = b[name] if a[name] is None else a[name]

    def start(self) -> None:
        self.cost, self.audit = finished(self.parser, self.ways)
        self.at, self.stack, self.sha, self.rows = 0, 0, hashlib.sha256(), 0

    def _emit(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.rows else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.rows += 1

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            terminal = self.parser.next[self.stack][0]
            self._emit(ROLES[terminal], "")
            self.stack = self.parser.shift(self.stack, terminal)[0]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        terminal = role[:1] if letter == "K" else self.parser.next[self.stack][0]
        self._emit(role if letter == "K" else ROLES[terminal], text)
        self.stack = self.parser.shift(self.stack, terminal)[0]

    def result(self) -> tuple:
        if self.audit is None:
            self.start()
        self._insert()
        s = self.seen
        gaps = 0 if s["first_turn"] is None else s["last_turn"] - s["first_turn"] + 1 - s["turns"]
        return (self.conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], self.cost, self.audit, self.sha.hexdigest())


def _repaired(it: Iterator[pa.RecordBatch], rules: tuple) -> Iterator[pa.RecordBatch]:
    parser, now, kind, out = grammar(rules), None, pa.null(), []

    def written() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])],
            names=["conv", *_RESULT, "audit", "repaired_sha256"],
        )

    for batch in it:
        kind = batch.schema.field("conv").type
        for key, chunk, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "role", "text"))):
            if now is None or key != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Repair(parser, key)
            if chunk is not None:
                now.chunk(chunk)
            else:
                if now.audit is None:
                    now.start()
                now.row(role, text)
        if out:
            yield written()
    if now is not None:
        out.append(now.result())
        yield written()


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None,
    rules: tuple = DIALOGUE,
) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``there`` names a boolean column; rows for which it isn't true only name their conversation.
    """
    spark = batches.ready(rows.sparkSession)
    grammar(rules)
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)).alias("there"),
    )
    named = named.withColumn("digest", F.unhex(F.sha2("text", 256)))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*STOPS), SOUND).otherwise(CUT)
    facts = named.select("conv", "turn", "role", "digest", "there", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    facts = materialize(facts.withColumn("row", F.monotonically_increasing_id()), "rows")

    same = ["conv", "role", "digest"]
    several = (
        facts.where(F.col("there") & (F.col("fault") != BLANK)).groupBy(*same)
        .agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(*[F.col(c).alias(f"of_{c}") for c in same], F.col("first.row").alias("first"))
    )
    alike = F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    repeated = F.col("first").isNotNull() & (F.col("row") != F.col("first")) & (F.col("fault") != BLANK)
    judged = facts.join(several, alike, "left").withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("fault")))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "digest", "row"]
    ranged = judged.select("conv", "turn", "role", "digest", "row", "initial", "fault", "there").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = facts.schema["conv"].dataType.simpleString()
    chunks = ranged.select("conv", "turn", "initial", "fault", "there").mapInArrow(lambda it: _chunks(it, rules), f"conv {kind}, {_CHUNK}")
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))}
    first = chunks.select("conv", F.struct(*_FIELDS).alias("chunk"), "part", *[v.alias(c) for c, v in none.items()])
    rest = named.where("there").select(
        "conv", F.lit(None).cast(first.schema["chunk"].dataType).alias("chunk"), F.lit(None).cast("long").alias("part"), *none
    )
    met = first.unionByName(rest).repartition("conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), F.asc_nulls_last("part"), F.asc_nulls_first("turn"), "role", "digest"
    )
    schema = f"conv {kind}, {', '.join(f'{c} long' for c in _RESULT)}, audit string, repaired_sha256 string"
    return met.select("conv", "chunk", "role", "text").mapInArrow(lambda it: _repaired(it, rules), schema).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str = "there") -> DataFrame:
    """Rows with known faults, chosen by crc32 of ``conv:turn`` modulo 20; nulls count as one space.

    0 takes a row away (``there`` is false), 1 empties its text, 2 removes . ! ? from it, 3 repeats it, 4 makes it the user's.
    """

    def plain(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    new_text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate(plain(text), STOPS, "")).otherwise(plain(text))
    rows = rows.select(conv, turn, role, text, lot.alias("lot"))
    rows = rows.select(
        conv, turn, F.when(F.col("lot") == 4, "user").otherwise(plain(role)).alias(role), new_text.alias(text), (F.col("lot") != 0).alias(there), "lot"
    )
    return rows.withColumn("lot", F.explode(F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1)))).drop("lot")
