"""Conversation repair against exhaustive search over all edits."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import islice

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wellspring.llm import queries, turns

WS = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(t, role, text)] * (1 + (k == 3))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit, lines) by a search over whole strings, states are the roles so far in a short form."""
    best = {"": (0, "", ())}

    def insert(found):
        for _ in range(3):
            for s, (c, a, lines) in list(found.items()):
                for r in ("user", "assistant"):
                    step(found, s, r[0], (c + 2, a + "I", (*lines, f"{r}:")))
        return found

    def step(found, s, initial, new):
        for end in "su":
            if (s, initial) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                found[initial] = min(found.get(initial, new), new)

    for (_, role, text), kind in zip(rows, kinds):
        best, after = insert(best), {}
        for s, (c, a, lines) in best.items():
            new = (c + 3, a + "D", lines)
            after[s] = min(after.get(s, new), new)
            if kind not in ("b", "d"):
                extra = kind == "t"
                step(after, s, role[:1], (c + extra, a + "K", (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    step(after, s, r[0], (c + 2 + extra, a + "R", (*lines, f"{r}:{text}")))
        best = after
    return min(v for s, v in insert(best).items() if s in ("", "a"))


def expected(rows):
    """One row a conversation of raw (conv_id, turn, role, text) rows."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return [(c, *result(damage(of))) for c, of in by.items()]


def result(rows):
    kinds = faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    firsts = [r[1][:1] for r in rows]
    cost, audit, lines = cheapest(rows, kinds)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(kinds.count(k) for k in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, sha


def table(df):
    return sorted((None if pd.isna(r[0]) else r[0], *r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").toPandas().itertuples(index=False))


order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def same(got, want):
    assert order(tuple(r) for r in got) == order(want)


def test_query(spark, sf):
    df = pd.read_parquet(f"{sf}/conversations.parquet")
    want = expected(df[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    got = queries.op11_turns(spark, sf).collect()
    same(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got), want)


ROLE = st.sampled_from(["user", "assistant", "system", "tool", " ", "", "u"])
TEXT = st.sampled_from(["a.", "b!", "c", "", " \n", "d?"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 5), ROLE, TEXT), max_size=9), st.data())
def test_cost_audit_and_text_are_those_of_exhaustive_search(rows, data):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    kinds = faults(rows)
    cost, audit, lines = cheapest(rows, kinds)
    held = turns.Rows()
    for r in rows:
        held.add(*r, 1)
    held.mark()
    assert held.kinds == kinds
    now, back = turns.layers(held.steps(), (0,))
    got, state = turns.final(now)
    a, some = held.repaired(turns.path(back, 0, state))
    assert (got, a + turns.LAST[state], tuple(some + turns.last_lines(state))) == (cost, audit, lines)
    # chained in blocks: same cost, and the path through the blocks is the same
    steps, cut = held.steps(), sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=3)))
    blocks = [steps[x:y] for x, y in zip([0, *cut], [*cut, len(steps)])]
    cells = [tuple((s, e, c, r) for (s, e), (c, r) in turns.layers(b, (0, 1, 2, 3))[0].items()) for b in blocks]
    now, back = turns.layers(cells, (0,))
    total, end = turns.final(now)
    states = [s for s, _ in turns.path(back, 0, end)] + [end]
    way = [w for b, s, e in zip(blocks, states, states[1:]) for w in turns.path(turns.layers(b, (s,))[1], s, e)]
    assert (total, held.repaired(way)[0] + turns.LAST[end]) == (cost, audit)


def test_audits_are_legal_sequences(spark, sf):
    for rows in islice(pd.read_parquet(f"{sf}/conversations.parquet").groupby("conv_id"), 30):
        damaged = damage(rows[1][["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
        lines = cheapest(damaged, faults(damaged))[2]
        assert GOOD.fullmatch("".join(x[:1] for x in lines))


def odd_rows():
    rows = []
    for c in (None, 0, 1, 2, 7):
        rows += [(c, t, r, x) for t, r, x in ((None, "user", "hi."), (None, None, None), (3, "system", "s"), (3, "assistant", "ok?"), (5, "", "x."), (5, "user", " \t"), (1, "user", None), (9, "assistant", "long " * 50 + "end."))]
    rows += [(3, t, ("user", "assistant", "system")[t * 7 % 3], f"text {t % 11}" + "." * (t % 2)) for t in range(400)]
    rows += [(4, 1, "user", "same.")] * 120
    rows += [(5, t, "user", f"only user {t}.") for t in range(90)]
    rows += [(6, t, "assistant", "again!") for t in range(90)]
    return rows


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_long_cut_and_odd_conversations(spark, block_rows):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(6)
    got = turns.repaired(df, block_rows=block_rows).collect()
    same(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got), expected(rows))


def test_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, "user", "q?"), ("b", 0, "user", "w.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in turns.repaired(df).collect()}
    assert got == {r[0]: (r[6], r[7]) for r in expected([("a", 0, "user", "q?"), ("b", 0, "user", "w.")])}
    assert turns.repaired(df.limit(0)).count() == 0


def test_sql_on_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] in (None, 0, 1, 2, 4, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    sql = con.sql(queries.ORACLES["op11_turns"])
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    same(sql.select(", ".join(cols)).fetchall(), expected(rows))
