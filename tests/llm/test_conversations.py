"""Conversation repair against every edit of short conversations, and blocks against whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prismdex.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def every_edit(rows):
    """(cost, audit, roles) of the best of all edit sequences with up to two insertions at each place; rows: (initial, must go, truncated)."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(goes and e != "D" for e, (_, goes, _) in zip(edits, rows, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""], strict=True))
            cost = sum(COSTS[c] for c in audit) + sum(5 for e, (_, _, cut) in zip(edits, rows, strict=True) if cut and e != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            choices = ["I" in part and "ua" or part for part in audit if part != "D"]
            kept = iter([i for e, (i, _, _) in zip(edits, rows, strict=True) if e == "K"])
            choices = [next(kept) if c == "K" else "ua" for c in choices]
            for roles in itertools.product(*[c if c == "ua" else (c,) for c in choices]):
                if re.fullmatch("(s?(ua)+)?", "".join(roles)):
                    best = cost, audit, roles
                    break
    return best


def by_hand(rows, solve=every_edit):
    """The report of one table: rows of (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        none = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{none(c)}:{none(turn)}".encode()) % 20
        role, text = none(role), none(text)
        groups[c] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, counts, states = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in turns:
            words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, roles = solve(states)
        left, texts, kept = iter(turns), [], iter(roles)
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, None, "")
            if e != "D":
                initial = next(kept)
                texts.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[c] = gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()
    return out


def table(seed, conversations=60, longest=4):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice((1, 1, 1, 2))
            rows.append((c, turn, rng.choice(("user", "assistant", "system", "tool", "user", "assistant")), rng.choice(("Yes.", "No", " \t", "Why? ", "And é!", "it is so.\n"))))
    rng.shuffle(rows)
    return rows


def found(frame):
    rows = frame.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_short_conversations_against_every_edit(spark):
    rows = table(5)
    got = found(cv.report(cv.repair(cv.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))))
    assert got == by_hand(rows)
    assert {"D", "K", "R"} == set("".join(x[-2] for x in got.values())) and max(x[0] for x in got.values()) > 0


def chain(states):
    """The same by one pass from the end over whole conversations, keeping full label strings."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ""), 3: (0, "", "")}

    def with_inserts(best):
        for _ in range(2):
            for g in step:
                for role in "ua":
                    if role in step[g] and step[g][role] in best:
                        cost, audit, roles = best[step[g][role]]
                        best[g] = min(best.get(g, (1 << 40,)), (cost + 5, "I" + audit, role + roles))
        return best

    best = with_inserts(best)
    for initial, goes, cut in reversed(states):
        before = {}
        for g in step:
            ways = [(best[g][0] + 2, "D" + best[g][1], best[g][2])] if g in best else []
            for role, h in step[g].items():
                if h in best and not goes:
                    cost, audit, roles = best[h]
                    if role == initial:
                        ways.append((cost + 5 * cut, "K" + audit, role + roles))
                    if role != "s":
                        ways.append((cost + 1 + 5 * cut, "R" + audit, role + roles))
            if ways:
                before[g] = min(ways)
        best = with_inserts(before)
    return best[0]


@pytest.mark.parametrize(("block", "fan"), [(1024, 256), (3, 2), (1, 3)])
def test_long_conversations_in_blocks(spark, block, fan):
    rows = [(c + 100 * (n > 3), t, r, x) for n in (4, 60) for c, t, r, x in table(n, 8, n)] + [(999, t, "user" if t % 3 else "assistant", f"Turn {t % 40}" + "." * (t % 5 > 0)) for t in range(500)]
    rows += [(999, None, "user", "odd.")] * 4 + [(999, 7, "system", f"{k}.") for k in range(5)]
    got = found(cv.report(cv.repair(cv.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)), block=block, fan=fan)))
    assert got == by_hand(rows, chain)


def test_both_hands_agree():
    rows = table(11, 80)
    assert by_hand(rows) == by_hand(rows, chain)


def test_segments_hold_the_repaired_turns(spark):
    turns = spark.createDataFrame([(1, t, r, x, 1) for t, r, x in [(0, "assistant", "Hello."), (1, "user", "Hi."), (2, "user", "And?"), (3, "assistant", "Yes."), (4, "assistant", " ")]], f"{SCHEMA}, n long")
    segments = sorted(cv.repair(turns).collect(), key=lambda x: x.part)
    assert [(y.role, y.text) for x in segments for y in x.turns] == [("user", "Hello."), ("assistant", "Hi."), ("user", "And?"), ("assistant", "Yes.")]
    assert "".join(x.audit for x in segments) == "RRKKD" and sum(x.cost for x in segments) == 4


@pytest.mark.parametrize("costs", [{"K": 0, "R": 1, "D": 2, "I": 5}, {"K": 0, "R": 4, "D": 9, "I": 2}, {"K": 0, "R": 3, "D": 3, "I": 3}])
def test_machine_against_every_edit_at_other_costs(monkeypatch, costs):
    monkeypatch.setattr(sys.modules[__name__], "COSTS", costs)
    machine, audits = cv.Machine(cv.Costs(costs["R"], costs["D"], costs["I"])), set()
    for n in range(4):
        for symbols in itertools.product("suaoxSUAO", repeat=n) if n < 3 else ("aua", "uuS", "oxa", "uoU", "sua", "Axu"):
            wanted = every_edit([(x.lower(), x == cv.GOES, x.isupper()) for x in symbols])
            assert machine.solve("".join(symbols)) == wanted[:2]
            audits |= set(wanted[1])
    assert ("I" in audits) == (costs["I"] < 5)


def test_odd_rows(spark):
    gone = [(c, t, "user", "Hi.") for c in range(400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, None, "Ho."), (7000, None, "assistant", None), (7000, None, "", "x."), *gone, *[(8000, 3, "user", "Same.")] * 70, (8001, 1, "user", "word " * 400_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "later": F.lit("x"), "n": F.lit(5), "a.b": F.lit(0), "low": F.lit(2), "whole": F.lit(True)})
    got = found(cv.report(cv.repair(cv.damaged(frame), block=16, fan=2)))
    assert got == by_hand(rows, chain)
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone)
    empty = cv.report(cv.repair(cv.damaged(frame.limit(0))))
    assert empty.collect() == [] and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
