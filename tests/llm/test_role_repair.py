import hashlib
import itertools
import random
import re
import zlib

import pytest

from factloom import session
from factloom.llm import role_repair as rr

SPACE = " \t\n\x0b\f\r"


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = rr.BLANK if not bare else rr.DUPLICATE if (role, text) in seen else rr.SOUND if bare[-1] in ".!?" else rr.CUT
        seen.add((role, text))
        out.append(fault)
    return out


def _by_trial(rows):
    """Every edit of a few rows, at most two insertions in a place."""
    best = None
    places = [["", "I", "II"]] * (len(rows) + 1)
    for letters in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(*places):
            audit = "".join(g + x for g, x in zip(gaps, (*letters, "")))
            got = _applied(rows, audit)
            if got and (best is None or (got[0], audit) < best[:2]):
                best = (got[0], audit, got[1])
    return best


def _applied(rows, audit):
    """Cost and text of an audit, or None where it isn't legal; roles follow from what stands before."""
    roles, out, cost, k = "", [], 0, 0
    faults = _faults(rows)
    for x in audit:
        wanted = "user" if not roles or roles[-1] in "sa" else "assistant"
        if x == "I":
            roles, cost = roles + wanted[0], cost + 5
            out.append(wanted + ":")
            continue
        (role, text), fault = rows[k], faults[k]
        k += 1
        if x == "D":
            cost += 2
            continue
        if fault in (rr.BLANK, rr.DUPLICATE):
            return None
        cost += (x == "R") + 5 * (fault == rr.CUT)
        name = role if x == "K" else wanted
        roles += name[:1] or "?"
        out.append(f"{name}:{text}")
    return (cost, "\n".join(out)) if re.fullmatch("(s?(ua)+)?", roles) else None


def _by_states(rows):
    """Dijkstra's way over (rows done, last role), audits written out."""
    faults, best = _faults(rows), {"": (0, "", "")}

    def step(ways, target, new):
        if target not in ways or new < ways[target]:
            ways[target] = new

    def inserted(ways):
        for _ in range(3):
            for last, (cost, audit, text) in list(ways.items()):
                role = "assistant" if last == "u" else "user"
                step(ways, role[0], (cost + 5, audit + "I", text + f"\n{role}:"))
        return ways

    for (role, text), fault in zip(rows, faults):
        new = {}
        for last, (cost, audit, done) in inserted(best).items():
            step(new, last, (cost + 2, audit + "D", done))
            if fault in (rr.BLANK, rr.DUPLICATE):
                continue
            more = 5 * (fault == rr.CUT)
            wanted = "assistant" if last == "u" else "user"
            step(new, wanted[0], (cost + 1 + more, audit + "R", done + f"\n{wanted}:{text}"))
            if role[:1] == wanted[0] or (role[:1] == "s" and last == ""):
                step(new, role[:1], (cost + more, audit + "K", done + f"\n{role}:{text}"))
        best = new
    ended = [way for last, way in inserted(best).items() if last in ("", "a")]
    cost, audit, text = min(ended)
    return cost, audit, text[1:]


def _plain(rows):
    """rows: (turn, role, text) of one conversation in order."""
    pairs = [(r, t) for _, r, t in rows]
    faults, turns = _faults(pairs), [t for t, _, _ in rows if t is not None]
    cost, audit, text = _by_states(pairs)
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in (rr.BLANK, rr.DUPLICATE, rr.CUT)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]
TEXTS = ["One.", "Two!", "cut", " ", "", "Yes? \n", "x"]


def test_against_every_edit():
    rng = random.Random(1)
    parser = rr.grammar(rr.DIALOGUE)
    for _ in range(250):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 4))]
        ways = rr.Ways(parser, 0)
        for (role, _), fault in zip(rows, _faults(rows)):
            ways.add(role[:1], fault)
        got = rr.finished(parser, ways.all())
        want = _by_trial(rows)
        assert got == want[:2] and _by_states(rows) == want


def test_long_ways_and_blocks(monkeypatch):
    monkeypatch.setattr(rr, "BLOCK", 7)
    rng = random.Random(2)
    parser = rr.grammar(rr.DIALOGUE)
    for rows in [[("user", f"{k}.") for k in range(101)]] + [
        [(rng.choice(ROLES), rng.choice(TEXTS) + str(k) * rng.randint(0, 1)) for k in range(rng.randint(20, 90))] for _ in range(40)
    ]:
        ways = rr.Ways(parser, 0)
        for (role, _), fault in zip(rows, _faults(rows)):
            ways.add(role[:1], fault)
        assert rr.finished(parser, ways.all()) == _by_states(rows)[:2]


def test_grammars():
    with pytest.raises(ValueError):
        rr.Grammar((("all", ("u", "all", "a")), ("all", ())))  # stacks without bound
    with pytest.raises(ValueError):
        rr.Grammar((("all", ("u",)), ("all", ("a",))))
    parser = rr.Grammar((("all", ("u", "a")), ("all", ("s",))))
    ways = rr.Ways(parser, 0)
    ways.add("u", rr.SOUND)
    ways.add("u", rr.SOUND)
    assert rr.finished(parser, ways.all()) == (1, "KR")


def _collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_frames(spark, monkeypatch):
    monkeypatch.setitem(session.SETTINGS, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS) + rng.choice(["", str(t)])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "First."), (7, 3, "user", "Same turn."), (7, 3, "user", "Same turn."), (None, 1, "user", "Hm."), (None, None, None, None)]
    rows += [(99, k, ROLES[k % 7], TEXTS[k % 7] + str(k % 500)) for k in range(4000)]  # a hot conversation over many tasks
    rows += [(98, k % 50, "user", "Again.") for k in range(900)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    held = {}
    for c, t, role, text in rows:
        held.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    want = sorted(((c, *_plain(_ordered(rs))) for c, rs in held.items()), key=str)
    assert _collected(rr.repair(frame)) == want
    assert rr.repair(frame.limit(0)).count() == 0


def test_damage_and_the_query(spark, tmp_path):
    from factloom.llm import queries

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"Text {t}. More!") for c in range(300) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "A."), (5, None, None, None), (1000, 1, "user", "long " * 50_000 + "end.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held = {}
    for c, t, role, text in rows:
        kept = held.setdefault(c, [])
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        kept += [(t, role, text)] * ((lot != 0) + (lot == 3))
    want = sorted(((c, *_plain(_ordered(rs))) for c, rs in held.items()), key=str)
    got = _collected(queries.op13_glr_repair(spark, str(tmp_path)))
    assert got == want
    assert any(r[-2] == "" and r[-1] == hashlib.sha256(b"").hexdigest() for r in got)
