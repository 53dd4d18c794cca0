"""Structure repair of conversations: the cheapest edits that make turns alternate, and the least of their audit strings.

A conversation is read by turn.  Rows are kept (K), given another role (R), deleted (D), and empty turns are
inserted (I) so that roles read: system or not, then user and assistant in turn, or nothing at all.

Method.  A macro edit is a run of inserts and the edit of the turn after them; its letters form a prefix-free
code, so of two audit strings the one with the lesser first differing code is the lesser.  A layer for each row
holds, for each state (nothing yet, after system, user, assistant), the least cost and, in place of the string,
the rank of that string among the layer's; ranks of the next layer come from pairs (rank before, code).  Parent
pointers give the edits back.

How it scales.  Rows are dealt by ranges of (conv_id, turn, role, hash of the text, row number) and sorted, so a
conversation of any length, or one row repeated without end, spreads over tasks.  A conversation that lies whole
in a partition and has at most ``block_rows`` rows is repaired where it is read: one shuffle for nearly all.  The
others (and the first and last of each partition) become blocks: a block's costs and ranks from every state to
every state; blocks are chained in order by the same ranking, a few numbers for thousands of rows; the states so
found lead back into the blocks.  Texts are hashed in order, as a digest demands, from a sorted stream.

Defined results.  Nulls count as one space, also in the key of the damage; a null conv_id is a conversation of
its own.  Null turns come first; rows of one turn are ordered by role and MD5 of the text.  A role without a first
letter fits nowhere.  Repeated rows are duplicates of the first.  Conversations without rows give zeros, an empty
audit and the hash of the empty string; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where an inserted or re-roled turn leads from each state.
TURN = (USER, USER, ASSISTANT, USER)
#: What is inserted after the last row.
LAST = ("", "II", "I", "")
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: More inserts before a turn lead where two fewer do.
CODES = sorted("I" * m + e for m in range(3) for e in "DKR")
BLOCK_ROWS = 4096
BLOCK_CHARS = 4_000_000


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``copies`` 0 for dropped rows (kept so that their conversation is), 2 for repeated ones."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


@lru_cache(maxsize=None)
def edges(initial: str, gone: bool, truncated: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, code) of the best macro edit of a row between each two states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a in STATES:
        at = a
        for m in range(3):
            steps = [("D", at, DELETE)]
            if not gone:
                extra = TRUNCATED * truncated
                steps.append(("R", TURN[at], REROLE + extra))
                if initial == "s" and at == START:
                    steps.append(("K", SYSTEM, KEEP + extra))
                if (initial, TURN[at]) in (("u", USER), ("a", ASSISTANT)):
                    steps.append(("K", TURN[at], KEEP + extra))
            for letter, to, cost in steps:
                found = (cost + m * INSERT, CODES.index("I" * m + letter))
                best[a, to] = min(best.get((a, to), found), found)
            at = TURN[at]
    return tuple((a, b, cost, code) for (a, b), (cost, code) in sorted(best.items()))


def layers(steps: list[tuple[tuple[int, int, int, int], ...]], starts: tuple[int, ...]) -> tuple[dict[tuple[int, int], tuple[int, int]], list[dict[tuple[int, int], tuple[int, int]]]]:
    """Cost and rank of each (start, state) after all steps, and each layer's (parent state, code).

    Ranks are those of the least strings of codes among all of a layer, of all starts.
    """
    now = {(s, s): (0, 0) for s in starts}
    back = []
    for step in steps:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for s in starts:
            for a, b, cost, code in step:
                if (here := now.get((s, a))) is not None:
                    found = (here[0] + cost, here[1], code, a)
                    if (old := best.get((s, b))) is None or found < old:
                        best[s, b] = found
        rank = {k: n for n, k in enumerate(sorted({f[1:3] for f in best.values()}))}
        now = {k: (f[0], rank[f[1:3]]) for k, f in best.items()}
        back.append({k: (f[3], f[2]) for k, f in best.items()})
    return now, back


def path(back: list[dict], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, code) of each step on the way from ``start`` to ``end``."""
    out, at = [], end
    for layer in reversed(back):
        at, code = layer[start, at]
        out.append((at, code))
    return out[::-1]


def final(now: dict[tuple[int, int], tuple[int, int]], start: int = START) -> tuple[int, int]:
    """Least cost with what is inserted at the end, and the state before that."""
    cost, _, state = min((c + INSERT * len(LAST[e]), r, e) for (s, e), (c, r) in now.items() if s == start)
    return cost, state


class Rows:
    """Rows of a conversation or of a block of it, in order, each copy by itself."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.kinds = [], [], [], []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        """Kinds: b blank, t truncated, empty else."""
        bare = text.rstrip(SPACE)
        kind = "b" if not bare else "" if bare[-1] in ".!?" else "t"
        for _ in range(copies):
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append("" if kind == "b" else text)
            self.kinds.append(kind)
            self.chars += len(text)

    def mark(self, first: set[int] | None = None) -> None:
        """Duplicates become kind d; ``first`` are the places of first occurrences, found here if not given."""
        if first is None:
            seen: dict[tuple[str, str], int] = {}
            for i, k in enumerate(zip(self.roles, self.texts)):
                seen.setdefault(k, i)
            first = set(seen.values())
        self.kinds = [k if k == "b" or i in first else "d" for i, k in enumerate(self.kinds)]

    def steps(self) -> list:
        return [edges(r[:1], k in ("b", "d"), k == "t") for r, k in zip(self.roles, self.kinds)]

    def counts(self) -> dict[str, int]:
        first = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return {
            "blank": self.kinds.count("b"), "duplicate": self.kinds.count("d"), "truncated": self.kinds.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "turns": len(set(turns)),
            "least": min(turns, default=None), "most": max(turns, default=None),
        }

    def repaired(self, way: list[tuple[int, int]]) -> tuple[str, list[str]]:
        """Audit and repaired lines for a way through the states."""
        audit, lines = [], []
        for role, text, (at, code) in zip(self.roles, self.texts, way):
            letters = CODES[code]
            audit.append(letters)
            for letter in letters:
                if letter == "D":
                    continue
                to = SYSTEM if letter == "K" and role[:1] == "s" else TURN[at]
                lines.append(f"{ROLE[to]}:" if letter == "I" else f"{role if letter == 'K' else ROLE[to]}:{text}")
                at = to
        return "".join(audit), lines


def last_lines(state: int) -> list[str]:
    return {SYSTEM: ["user:", "assistant:"], USER: ["assistant:"]}.get(state, [])


RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK = "part long, number long, turns array<long>, roles array<string>, texts array<string>, kinds array<string>, keys array<binary>"
COUNTED = ("blank", "duplicate", "truncated", "illegal")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "nth"]
    keyed = rows.withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("nth", F.monotonically_increasing_id())
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def read_conversations(rows: DataFrame, id_type: str, block_rows: int) -> DataFrame:
    """Results of whole conversations, and blocks (``number`` is set) of those that are cut or long."""
    text = RESULT.format(id=id_type) + ", " + BLOCK
    schema = _schema(text)

    def whole(conv, held: Rows) -> dict:
        held.mark()
        now, back = layers(held.steps(), (START,))
        cost, state = final(now)
        audit, lines = held.repaired(path(back, START, state))
        c = held.counts()
        gaps = c["most"] - c["least"] + 1 - c["turns"] if c["turns"] else 0
        done = "\n".join(lines + last_lines(state)).encode("utf-8", "surrogatepass")
        return {"conv_id": conv, "gaps": gaps, "cost": cost, "audit": audit + LAST[state], "repaired_sha256": hashlib.sha256(done).hexdigest(), **{k: c[k] for k in COUNTED}}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, held, number, cut = None, Rows(), 0, True  # the first conversation may have begun in the partition before
        begun, out = False, []

        def block() -> None:
            nonlocal number, held
            keys = [hashlib.sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() for r, t in zip(held.roles, held.texts)]
            out.append({"conv_id": conv, "part": part, "number": number, "turns": held.turns, "roles": held.roles, "texts": held.texts, "kinds": held.kinds, "keys": keys})
            number, held = number + 1, Rows()

        for b in batches:
            for c, turn, role, text, copies in zip(*(b.column(i).to_pylist() for i in range(5))):
                if begun and c != conv:
                    if cut:
                        block()
                    else:
                        out.append(whole(conv, held))
                    held, cut = Rows(), False
                conv, begun = c, True
                held.add(turn, role, text, copies)
                if len(held.kinds) >= block_rows or held.chars >= BLOCK_CHARS:
                    block()
                    cut = True
                if len(out) >= 500 or out and "keys" in out[-1]:
                    yield _batch(schema, out)
                    out.clear()
        if begun:
            block()  # the last one may go on in the next partition
            yield _batch(schema, out)

    return _sorted_rows(rows).mapInArrow(read, text)


def _rows_of(block: dict, first: list[int] | None) -> Rows:
    rows = Rows()
    rows.turns, rows.roles, rows.texts, rows.kinds = block["turns"], block["roles"], block.get("texts") or [""] * len(block["roles"]), block["kinds"]
    rows.mark(set(first or ()))
    return rows


def _streamed(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` on the rows (as dicts) of each partition, which it yields dicts for."""
    arrow = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, len(b), 64) for r in b.slice(i, 64).to_pylist())
        held = []
        for made in fn(rows):
            held.append(made)
            if len(held) >= 256 or any(isinstance(v, str) and len(v) > 100_000 for v in made.values()):
                yield _batch(arrow, held)
                held = []
        if held:
            yield _batch(arrow, held)

    return df.mapInArrow(run, schema)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")


def repair_blocks(blocks: DataFrame, id_type: str) -> DataFrame:
    """Results of conversations that lie in several blocks."""
    # the first of equal rows, by place: at most block_rows numbers for a block
    keys = blocks.select("conv_id", "part", "number", F.posexplode("keys").alias("place", "key"))
    firsts = keys.groupBy("conv_id", "key").agg(F.min(F.struct("part", "number", "place")).alias("f"))
    firsts = firsts.groupBy(F.col("f.part").alias("part"), F.col("f.number").alias("number")).agg(F.collect_list("f.place").alias("first"))
    light = blocks.drop("texts", "keys").join(firsts, ["part", "number"], "left")

    def matrix(rows: Iterator[dict]) -> Iterator[dict]:
        for b in rows:
            held = _rows_of(b, b["first"])
            now, _ = layers(held.steps(), tuple(STATES))
            cells = [(s, e, c, r) for (s, e), (c, r) in sorted(now.items())]
            known = [t for t in b["turns"] if t is not None]
            ends = {"head": held.roles[0][:1], "tail": held.roles[-1][:1]} if held.roles else {}
            yield {"conv_id": b["conv_id"], "part": b["part"], "number": b["number"], "first": b["first"], "cells": [x for c in cells for x in c], "low": min(known, default=None), "high": max(known, default=None), "n_rows": len(held.roles), **ends, **held.counts()}

    at = f"conv_id {id_type}, part long, number long, "
    table = at + "first array<int>, cells array<int>, low long, high long, turns long, n_rows long, head string, tail string, blank long, duplicate long, truncated long, illegal long"
    summed = _streamed(light, table, matrix)

    def chain(rows: Iterator[dict]) -> Iterator[dict]:
        """States between the blocks of each conversation; its last block carries the sums."""
        held: list[dict] = []

        def close() -> Iterator[dict]:
            steps = [tuple(zip(*[iter(b["cells"])] * 4)) for b in held]
            now, back = layers(steps, (START,))
            cost, state = final(now)
            states = [a for a, _ in path(back, START, state)] + [state]
            sums = dict.fromkeys(COUNTED, 0)
            turns, low, high, tail = 0, None, None, None
            for b in held:
                for k in COUNTED:
                    sums[k] += b[k]
                if b["low"] is not None:
                    turns += b["turns"] - (b["low"] == high)
                    low = b["low"] if low is None else low
                    high = b["high"]
                if b["n_rows"]:
                    sums["illegal"] += tail is not None and tail + b["head"] not in LEGAL
                    tail = b["tail"]
            gaps = high - low + 1 - turns if turns else 0
            for n, b in enumerate(held):
                last = n == len(held) - 1
                yield {"part": b["part"], "number": b["number"], "first": b["first"], "begin": states[n], "end": states[n + 1], **({"gaps": gaps, "cost": cost, **sums} if last else {})}

        for r in rows:
            if held and held[0]["conv_id"] != r["conv_id"]:
                yield from close()
                held = []
            held.append({k: r[k] for k in ("conv_id", "part", "number", "first", "cells", "low", "high", "turns", "n_rows", "head", "tail", *COUNTED)})
        if held:
            yield from close()

    ways = _streamed(_by_conversation(summed), "part long, number long, first array<int>, begin int, end int, gaps long, cost long, blank long, duplicate long, truncated long, illegal long", chain)

    def edit(rows: Iterator[dict]) -> Iterator[dict]:
        for b in rows:
            held = _rows_of(b, b["first"])
            _, back = layers(held.steps(), (b["begin"],))
            audit, lines = held.repaired(path(back, b["begin"], b["end"]))
            if b["cost"] is not None:
                audit, lines = audit + LAST[b["end"]], lines + last_lines(b["end"])
            yield {**{k: b[k] for k in ("conv_id", "part", "number", "gaps", "cost", *COUNTED)}, "audit": audit, "some": bool(lines), "lines": "\n".join(lines)}

    edited = at + "gaps long, cost long, blank long, duplicate long, truncated long, illegal long, audit string, some boolean, lines string"
    done = _streamed(blocks.drop("keys").join(ways, ["part", "number"]), edited, edit)

    def digest(rows: Iterator[dict]) -> Iterator[dict]:
        sha, audit, some = hashlib.sha256(), [], False
        for r in rows:
            audit.append(r["audit"])
            if r["some"]:
                sha.update(("\n" * some + r["lines"]).encode("utf-8", "surrogatepass"))
                some = True
            if r["cost"] is not None:
                yield {**{k: r[k] for k in ("conv_id", "gaps", "cost", *COUNTED)}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                sha, audit, some = hashlib.sha256(), [], False

    return _streamed(_by_conversation(done), RESULT.format(id=id_type), digest)


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cost, audit and digest of each conversation after damage (``rows`` are taken as they are, if given)."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    read = materialize(read_conversations(damaged(conversations) if rows is None else rows, id_type, block_rows), "conversations")
    names = [c.split()[0] for c in RESULT.format(id=id_type).split(", ")]
    blocks = read.where("number IS NOT NULL").select("conv_id", *[c.split()[0] for c in BLOCK.split(", ")])
    cut = materialize(repair_blocks(blocks, id_type), "cut_conversations")
    whole = materialize(read.where("number IS NULL").select(names), "whole_conversations")
    discard(read)
    out = whole.unionByName(cut)
    return out
