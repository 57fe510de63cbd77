"""Repair of conversations against the least of all edit sequences, and of cut conversations against whole ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sievestone.llm import conversations as c
from sievestone.llm import queries

GOOD = re.compile(r"(s?(ua)+)?")


def faults(turns):
    """First faults of turns (role, text) in order."""
    out, seen = [], set()
    for role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(c.BLANK if not last else c.DUPLICATE if (role, text) in seen else c.TRUNCATED if last[-1] not in ".!?" else c.SOUND)
        seen.add((role, text))
    return out


def brute(turns):
    """(cost, edits, repaired turns) from every choice of edits with up to two insertions before each turn and at the end."""
    found = faults(turns)
    best = None
    runs = [[""]] + [[*map("".join, itertools.product("ua", repeat=n))] for n in (1, 2)]
    runs = [x for r in runs for x in r]
    choices = []
    for (role, text), fault in zip(turns, found, strict=True):
        own = [("D", 2, None)]
        if fault not in (c.BLANK, c.DUPLICATE):
            more = 5 * (fault == c.TRUNCATED)
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append([(run, *x) for run in runs for x in own])
    full = {"u": "user", "a": "assistant"}
    for picked in itertools.product(*choices, runs):
        cost, edits, kept = 0, "", []
        for run, edit, own, turn in picked[:-1]:
            cost += 5 * len(run) + own
            edits += "I" * len(run) + edit
            kept += [(full[x], "") for x in run] + ([turn] if turn else [])
        cost += 5 * len(picked[-1])
        edits += "I" * len(picked[-1])
        kept += [(full[x], "") for x in picked[-1]]
        if GOOD.fullmatch("".join(r[:1] for r, _ in kept)) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, kept)
    return best


def by_layers(turns):
    """The same by the dynamic programme on one chunk."""
    chunk = c.Chunk()
    for (role, text), fault in zip(turns, faults(turns), strict=True):
        chunk.add(role[:1], fault, 1, role, text)
    cost, layer, pointers = chunk.solve(c.NOTHING)
    more, state, inserts = c.ending(layer)
    codes = chunk.edits(pointers, state)
    return cost + more, "".join(codes) + "I" * inserts, [(r, t) for _, r, t in chunk.apply(codes, c.NOTHING, inserts)]


def random_turns(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " "]), rng.choice(["", " \n", "Hi.", "Yes!", "what", "Go on? ", "ok"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_edits_with_the_least_string(seed):
    turns = random_turns(random.Random(seed), seed % 4)
    assert by_layers(turns) == brute(turns)


def expected(rows):
    """The query's row for one conversation's turns (turn, role, text), in order."""
    turns = [(r, t) for _, r, t in rows]
    cost, edits, kept = by_layers(turns)
    known = [n for n, _, _ in rows if n is not None]
    found = faults(turns)
    illegal = sum(a[0][:1] + b[0][:1] not in c.LEGAL for a, b in zip(turns, turns[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(k) for k in (c.BLANK, c.DUPLICATE, c.TRUNCATED)), illegal, cost, edits, sha)


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def make(spark, table):
    rows = [(conv, n, r, t, n, "x") for conv, turns in table.items() for n, r, t in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long, part string")


def test_conversations_cut_into_chunks_are_as_whole_ones(spark, monkeypatch):
    rng = random.Random(5)
    table = {k: [(rng.choice([None, *range(n + 1)]), r, t) for r, t in random_turns(rng, n)] for k, n in enumerate([1, 2, 5, 30, 0, 8, 13, 3, 400])}
    table[None] = [(1, "user", "Null id."), (2, "assistant", "Yes.")]
    table[99] = [(3, "user", "Same again.")] * 250 + [(4, "assistant", "Fine.")]
    want = {k: expected(order(v)) for k, v in table.items() if v}
    assert rows_of(c.repair_conversations(make(spark, table))[0]) == want
    monkeypatch.setattr(c, "COPIES", 60)
    summary, repaired = c.repair_conversations(make(spark, table), keep_turns=True, chunk_turns=7)
    assert rows_of(summary) == want
    turns = {}
    for r in sorted(repaired.collect(), key=lambda r: (str(r.conv_id), r.position)):
        turns.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for conv, own in want.items():
        kept = turns.get(conv, [])
        assert [p for p, _, _ in kept] == list(range(len(kept)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest() == own[-1]


def damaged(rows):
    """Rows (conv_id, turn, role, text) as the query damages them."""
    word = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = word(role), word(text)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def test_registered_query(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, 1, "user", "Hm."), (None, None, None, None), (5000, None, "user", "a"), (5000, None, "user", "a"), (5001, 0, "tool", "x" * 100_000 + ".")]
    odd += [(k, 0, "user", "Only.") for k in range(6000, 6060)]
    spark.createDataFrame(given + odd, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    table = {r[0]: [] for r in given + odd}
    for conv, turn, role, text in damaged(given + odd):
        table[conv].append((turn, role, text))
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    want = {k: expected(order(v)) if v else nothing for k, v in table.items()}
    assert nothing in want.values()
    assert rows_of(queries.op13_conversation_repair(spark, f"file://{tmp_path}")) == want
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repair_conversations(empty)[0].collect() == []
