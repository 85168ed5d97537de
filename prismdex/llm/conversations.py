"""Conversation structure repair by weighted finite-state composition.

The turns of a conversation are an input acceptor, one symbol a turn; the edit transducer keeps, reroles or deletes a turn and inserts
empty ones; the grammar acceptor takes the role initials ``(s?(ua)+)?``.  Their composition is expanded on demand: a state is
(place, grammar state), and arcs are made the first time their symbol is met.  Weights are pairs (cost, labels), compared in that order
and joined by adding costs and putting labels after each other; a pass in topological order (place by place) finds the least.

Insertions go in front of the turn that follows them, so labels over the same turns end in another letter and none is a proper prefix of another.
Two paths therefore compare as they do whatever follows, and blocks of turns can be solved apart: a block is
a 4 x 4 table of least weights from each grammar state to each.  A conversation of any length is dealt over tasks by turn; its blocks keep
only costs and the ranks of their labels, which meet in a tree of ``FAN`` to one, and the best path then goes down the tree to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismdex.llm.tables import release, table, written

#: Grammar state: role initial to next state; the final states; the states.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = tuple(GRAMMAR)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\v\f\r"
#: Symbols and bytes of a block, blocks of a node of the tree, bytes of an output batch.
BLOCK, BLOCK_BYTES, FAN, BATCH = 1024, 1 << 20, 256, 1 << 22
#: The symbol of a turn that must go; others are the role initial (o: none of s, u, a), upper case if truncated.
GOES = "x"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Of a truncated turn that stays.
    truncated: int = 5


class Machine:
    """The composed machine: arcs of a symbol are expanded when it is first met."""

    def __init__(self, costs: Costs = Costs()) -> None:
        self.costs = costs
        self.inserted = {g: self._inserted(g) for g in STATES}
        self._arcs: dict[str, dict[int, list[tuple[int, int, str]]]] = {}
        self.solved = lru_cache(1 << 14)(self._solved)

    def __reduce__(self):
        return Machine, (self.costs,)

    def _inserted(self, state: int) -> dict[int, int]:
        """States that insertions lead to and how many it takes; going round costs more, so each is reached once."""
        found, edge = {state: 0}, [state]
        for at in edge:
            for role in NAMES:
                to = GRAMMAR[at].get(role)
                if to is not None and to not in found:
                    found[to] = found[at] + 1
                    edge.append(to)
        return found

    def _edits(self, symbol: str) -> Iterator[tuple[str, str, int]]:
        """(label, role initial that comes out or none, cost) of the edits of a turn."""
        yield "D", "", self.costs.delete
        if symbol != GOES:
            extra = self.costs.truncated if symbol.isupper() else 0
            yield "K", symbol.lower(), extra
            for role in NAMES:
                yield "R", role, self.costs.rerole + extra

    def arcs(self, symbol: str) -> dict[int, list[tuple[int, int, str]]]:
        """Grammar state to (next state, cost, labels) over one turn of the symbol and what is inserted before it."""
        if symbol not in self._arcs:
            self._arcs[symbol] = {g: [] for g in STATES}
            for g in STATES:
                best: dict[int, tuple[int, str]] = {}
                for at, n in self.inserted[g].items():
                    for label, role, cost in self._edits(symbol):
                        to = GRAMMAR[at].get(role) if role else at
                        if to is not None:
                            found = n * self.costs.insert + cost, "I" * n + label
                            best[to] = min(best.get(to, found), found)
                self._arcs[symbol][g] = [(to, *found) for to, found in best.items()]
        return self._arcs[symbol]

    def least(self, symbols: str, start: int) -> dict[int, tuple[int, str]]:
        """Least (cost, labels) over all the symbols from the state to each state that can be reached."""
        best = {start: (0, "")}
        for symbol in symbols:
            arcs, after = self.arcs(symbol), {}
            for g, (cost, labels) in best.items():
                for to, more, label in arcs[g]:
                    found = cost + more, labels + label
                    if to not in after or found < after[to]:
                        after[to] = found
            best = after
        return best

    def ends(self, state: int) -> int | None:
        """How many insertions lead from the state to a final one."""
        return min((n for g, n in self.inserted[state].items() if g in FINAL), default=None)

    def _solved(self, symbols: str) -> tuple[int, str]:
        found = [(cost + n * self.costs.insert, labels + "I" * n) for g, (cost, labels) in self.least(symbols, 0).items() if (n := self.ends(g)) is not None]
        return min(found)

    def solve(self, symbols: str) -> tuple[int, str]:
        """(cost, labels) of a whole conversation; those of short ones are remembered."""
        return self.solved(symbols) if len(symbols) <= 32 else self._solved(symbols)


def edited(labels: str, turns: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits; from a grammar state each label has one possible role."""
    out, at = [], 0
    for label in labels:
        role, text = turns[at] if label != "I" else ("", "")
        at += label != "I"
        if label == "D":
            continue
        if label != "K":
            role = NAMES["a" if state == 2 else "u"]
        state = GRAMMAR[state][role[0]]
        out.append((role, text))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of the rows, damaged by the checksum of ``conv_id:turn``: n is how often the row stands there (0: dropped).

    A null role or text is one space, and so is a null conv_id or turn in the checksum.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(part("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, later) by conversation and turn, equal rows as one; later: role and text stand at an earlier turn too.

    Only rows whose role and text occur again in their conversation are grouped; the others are shuffled once, by ranges of turns.
    """
    key = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(key).alias("least"), F.count("*").alias("often"))
    seen = written(seen.where("often > 1").drop("often"), "seen")
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    once = joined.where("least IS NULL").select("conv_id", "turn", "role", "text", "digest", "n", F.lit(False).alias("later"))
    again = joined.where("least IS NOT NULL").withColumn("later", key > F.col("least")).groupBy("conv_id", "turn", "role", "text", "digest", "later").agg(F.sum("n").alias("n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return once.unionByName(again).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "later")


def _schema(turns: DataFrame, *more: str) -> T.StructType:
    """Columns of a segment, and of a block where costs and ranks are asked for."""
    ids = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, task int, part long, whole boolean, low {(turn := turns.schema['turn'].dataType.simpleString())}, high {turn}"
    return T.StructType.fromDDL(", ".join([ids, "n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, turns array<struct<role:string,text:string>>", *more]))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ranked(best: dict[tuple[int, int], tuple[int, object]]) -> tuple[list[int], list[int]]:
    """(costs, ranks) of 16 pairs of states: the ranks order their labels; a cost below 0: no path."""
    order = {x: k for k, x in enumerate(sorted({labels for _, labels in best.values()}))}
    pairs = [best.get((g, h)) for g in STATES for h in STATES]
    return [-1 if x is None else x[0] for x in pairs], [0 if x is None else order[x[1]] for x in pairs]


def _blocks(machine: Machine, schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size = TaskContext.get().partitionId(), [], 0
        names = schema.names
        inner = False  # whether the conversation began in this task
        seq, conv, begun = 0, None, False

        def empty() -> dict:
            return dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "n_turns"], 0) | dict.fromkeys(["low", "high", "first", "last", "cost", "audit", "costs", "ranks"]) | {"turns": [], "symbols": []}

        def finish(x: dict, whole: bool) -> dict:
            symbols = "".join(x["symbols"])
            x |= {"conv_id": conv, "task": task, "part": 0 if whole else seq, "whole": whole, "symbols": symbols}
            if whole:
                x["cost"], x["audit"] = machine.solve(symbols)
                x["turns"], x["symbols"] = edited(x["audit"], x["turns"]), None
            else:
                x["costs"], x["ranks"] = ranked({(g, h): found for g in STATES for h, found in machine.least(symbols, g).items()})
            x["turns"] = [{"role": r, "text": t} for r, t in x["turns"]]
            return x

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: [x[k] for x in out] for k in names}, schema)

        block, bytes_ = empty(), 0
        for batch in batches:
            for c, turn, role, text, n, later in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(finish(block, inner and not seq))
                        size += bytes_ + 200
                        inner = True
                    block, bytes_, seq, conv, begun = empty(), 0, 0, c, True
                if size > BATCH:
                    yield sent()
                    out, size = [], 0
                if not n:
                    continue
                words = text.rstrip(SPACES)
                initial = role[:1]
                kind = "blank" if not words else "duplicate" if later else "truncated" if words[-1] not in ".!?" else None
                symbol = initial if initial and initial in "sua" else "o"
                for k in range(n):
                    if len(block["symbols"]) >= most or bytes_ >= BLOCK_BYTES:
                        out.append(finish(block, False))
                        size += bytes_ + 200
                        block, bytes_, seq = empty(), 0, seq + 1
                        if size > BATCH:
                            yield sent()
                            out, size = [], 0
                    fault = "duplicate" if k and kind != "blank" else kind
                    if fault:
                        block[fault] += 1
                    block["symbols"].append(GOES if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
                    block["turns"].append((role, text))
                    bytes_ += len(text)
                    if block["first"] is None:
                        block["first"] = initial
                    elif block["last"] + initial not in LEGAL:
                        block["illegal"] += 1
                    block["last"] = initial
                    if turn is not None and turn != block["high"]:
                        block["n_turns"] += 1
                        block["low"] = turn if block["low"] is None else block["low"]
                        block["high"] = turn
        if begun:
            out.append(finish(block, False))
            yield sent()

    return run


def _states(nodes: list[dict], start: int) -> dict[int, tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """Least (cost, ranks) from the state over the nodes to each state, with the states on the way."""
    best = {start: (0, (), (start,))}
    for node in nodes:
        after = {}
        for g, (cost, ranks, way) in best.items():
            for h in STATES:
                more = node["costs"][g * len(STATES) + h]
                if more >= 0:
                    found = cost + more, (*ranks, node["ranks"][g * len(STATES) + h]), (*way, h)
                    if h not in after or found < after[h]:
                        after[h] = found
        best = after
    return best


def _joined(schema: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes = rows.sort_by("part").to_pylist()
        costs, ranks = ranked({(g, h): found[:2] for g in STATES for h, found in _states(nodes, g).items()})
        return pa.Table.from_pydict({"conv_id": [nodes[0]["conv_id"]], "part": [nodes[0]["up"]], "costs": [costs], "ranks": [ranks]}, schema)

    return run


def _parted(schema: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes = rows.sort_by("part").to_pylist()
        start, end, tail = nodes[0]["start"], nodes[0]["end"], nodes[0]["tail"]
        way = _states(nodes, start)[end][2]
        tails = [0] * (len(nodes) - 1) + [tail]
        return pa.Table.from_pydict({"conv_id": [x["conv_id"] for x in nodes], "part": [x["part"] for x in nodes], "start": list(way[:-1]), "end": list(way[1:]), "tail": tails}, schema)

    return run


def _paths(machine: Machine, schema: pa.Schema):
    """The best state at both ends of each whole conversation, from its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, tails = [], []
            for costs, ranks in zip(batch.column("costs").to_pylist(), batch.column("ranks").to_pylist(), strict=True):
                best = min((costs[h] + n * machine.costs.insert, ranks[h], h, n) for h in STATES if costs[h] >= 0 and (n := machine.ends(h)) is not None)
                ends.append(best[2])
                tails.append(best[3])
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "part": batch.column("part"), "start": [0] * len(ends), "end": ends, "tail": tails}, schema)

    return run


def _walked(machine: Machine, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # blocks are of about a megabyte
                x = batch.slice(at, 1).to_pylist()[0]
                cost, labels = machine.least(x["symbols"], x["start"])[x["end"]]
                x["cost"], x["audit"] = cost + x["tail"] * machine.costs.insert, labels + "I" * x["tail"]
                x["turns"] = [{"role": r, "text": t} for r, t in edited(x["audit"], [(y["role"], y["text"]) for y in x["turns"]], x["start"])]
                yield pa.RecordBatch.from_pydict({k: [x[k]] for k in schema.names}, schema)

    return run


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def repair(turns: DataFrame, costs: Costs = Costs(), block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Segments of repaired conversations: (conv_id, part, whole, counts, cost, audit, turns array of (role, text)), parts in order.

    turns: (conv_id, turn, role, text, n), as ``damaged`` makes them: n copies of the row stand there; a row with n 0 only names its conversation.
    Turns are taken in order, nulls first, those of equal turns by role and the SHA-256 of the text.  A null conv_id is a conversation of its own;
    a conversation without rows has one segment, without turns; other columns are ignored; an empty table gives an empty one.  Most conversations are one segment
    (whole); one that is long, or lies at the edge of a task, has more, however many turns it has.  block: turns of a segment; fan: nodes of the tree that meet in one.
    """
    machine = Machine(costs)
    schema = _schema(turns, "symbols string, costs array<long>, ranks array<int>")
    segment = _schema(turns)
    blocks = written(_ordered(turns).mapInArrow(_blocks(machine, _arrow(schema), block), schema), "blocks")
    open_ = blocks.where("NOT whole")
    # Blocks of a conversation are numbered through: at most two conversations of a task are open.
    counts = open_.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = written(counts.select("conv_id", "task", before.alias("base")), "base")
    placed = open_.alias("b").join(base.alias("c"), _same("b", "c") & (F.col("b.task") == F.col("c.task")))
    number = (F.col("b.part") + F.col("c.base")).alias("part")
    node = T.StructType.fromDDL(f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, part long, costs array<long>, ranks array<int>")
    path = T.StructType.fromDDL(f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, part long, start int, end int, tail int")
    levels = [written(placed.select("b.conv_id", number, "costs", "ranks"), "nodes")]
    up = F.expr(f"part div {fan}")
    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        levels.append(written(levels[-1].withColumn("up", up).groupBy("conv_id", "up").applyInArrow(_joined(_arrow(node)), node), "nodes"))
    way = levels[-1].mapInArrow(_paths(machine, _arrow(path)), path)
    for nodes in levels[-2::-1]:
        below = nodes.withColumn("up", up).alias("n").join(way.alias("w"), _same("n", "w") & (F.col("n.up") == F.col("w.part"))).select("n.*", "start", "end", "tail")
        way = written(below.groupBy("conv_id", "up").applyInArrow(_parted(_arrow(path)), path), "ways")
    way = written(way, "ways") if len(levels) == 1 else way
    solved = placed.select(*[number if c == "part" else F.col(f"b.{c}") for c in schema.names]).alias("b").join(way.alias("w"), _same("b", "w") & (F.col("b.part") == F.col("w.part")))
    solved = solved.select("b.*", "start", "end", "tail").mapInArrow(_walked(machine, _arrow(segment)), segment)
    release(*levels)
    return blocks.where("whole").select(*segment.names).union(solved)


def _told(schema: pa.Schema):
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def closed() -> dict:
            gaps = held["high"] - held["low"] + 1 - held["n_turns"] if held["low"] is not None else 0
            return {k: held[k] for k in ("conv_id", *sums)} | {"gaps": gaps, "audit": "".join(held["audit"]), "repaired_sha256": held["sha"].hexdigest()}

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in batch.slice(at, 256).to_pylist():
                    if held is None or x["whole"] or x["conv_id"] != held["conv_id"]:
                        if held is not None:
                            out.append(closed())
                        held = dict.fromkeys(sums, 0) | {"conv_id": x["conv_id"], "low": None, "high": None, "n_turns": 0, "last": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                    for k in sums:
                        held[k] += x[k]
                    if x["first"] is not None:
                        held["illegal"] += held["last"] is not None and held["last"] + x["first"] not in LEGAL
                        held["last"] = x["last"]
                    if x["low"] is not None:
                        held["n_turns"] += x["n_turns"] - (held["high"] == x["low"])
                        held["low"] = x["low"] if held["low"] is None else held["low"]
                        held["high"] = x["high"]
                    held["audit"].append(x["audit"])
                    for y in x["turns"]:
                        held["sha"].update((("\n" if held["any"] else "") + f"{y['role']}:{y['text']}").encode())
                        held["any"] = True
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist([*out, *([closed()] if held is not None else [])], schema)

    return run


def report(segments: DataFrame) -> DataFrame:
    """One row a conversation from its segments: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Whole conversations are told where they are read; the segments of the others meet in order, a task holding one at a time, as a digest of a whole text goes in order.
    """
    schema = T.StructType.fromDDL(f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    tell = _told(_arrow(schema))
    others = segments.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return segments.where("whole").mapInArrow(tell, schema).union(others.mapInArrow(tell, schema))


def op11_conversations(spark, sf_dir) -> DataFrame:
    return report(repair(damaged(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i : list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c : CAST(ascii(c) AS BIGINT)),
    lambda acc, b : xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM conversations, tab),
turns AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, LATERAL (SELECT unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END))) WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM turns),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS o,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
goes(g, r, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
filled(g, h, ins) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
edits AS (
  SELECT f.g, f.h, 'x' AS r, ins || 'D' AS labels, 2 + 5 * length(ins) AS cost FROM filled f
  UNION ALL SELECT f.g, a.h, a.r, ins || 'K', 5 * length(ins) FROM filled f JOIN goes a ON a.g = f.h
  UNION ALL SELECT f.g, a.h, 'R', ins || 'R', 1 + 5 * length(ins) FROM filled f JOIN goes a ON a.g = f.h AND a.r <> 's'),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS g, {'cost': 0, 'labels': ''} AS w FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT m.conv_id, m.i, e.h, min({'cost': w.w.cost + e.cost + CASE WHEN fault = 'truncated' AND e.r <> 'x' THEN 5 ELSE 0 END, 'labels': w.w.labels || e.labels})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN edits e ON e.g = w.g AND (e.r = 'x' OR fault NOT IN ('blank', 'duplicate') AND e.r IN (m.o, 'R')) GROUP BY m.conv_id, m.i, e.h),
ended AS (
  SELECT conv_id, min({'cost': w.w.cost + 5 * length(ins), 'labels': w.w.labels || ins}) AS w FROM walk w JOIN filled f ON f.g = w.g AND f.h IN (0, 3)
  WHERE i = (SELECT count(*) FROM placed p WHERE p.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, n, substr(w.labels, CAST(n AS INT), 1) AS e, left(w.labels, CAST(n AS INT)) AS upto, length(replace(w.labels, 'D', '')) % 2 AS odd FROM ended, LATERAL (SELECT unnest(range(1, length(w.labels) + 1)) AS n)),
kept AS (SELECT conv_id, n, e, length(replace(upto, 'I', '')) AS i, CASE WHEN (length(replace(upto, 'D', '')) - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END AS named FROM steps WHERE e <> 'D'),
repaired AS (
  SELECT k.conv_id, string_agg(CASE e WHEN 'K' THEN p.role ELSE named END || ':' || CASE e WHEN 'I' THEN '' ELSE p.text END, chr(10) ORDER BY n) AS t FROM kept k LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.i GROUP BY k.conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || o NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.w.cost, 0) AS BIGINT) AS cost, coalesce(e.w.labels, '') AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
