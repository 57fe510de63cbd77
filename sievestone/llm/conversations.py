"""Repair of the turn structure of conversations by cheapest edits, ties broken by the edits' own text.

A conversation's roles must read ``(s?(ua)+)?``. Every turn is kept, given
another role or deleted, after a run of inserted turns; that run and the turn's
edit are one macro edit, with a code such as ``K`` or ``IR``. Codes are
prefix-free, so edit strings of equally many turns compare code by code, and a
layer of the dynamic programme needs no strings: each state has its cost, the
rank of its string among the layer's, and a pointer to its parent and code. The
strings come back by following the pointers.

Turns are sorted over all tasks by conversation and turn. A conversation that
lies inside one task is solved there. One that crosses tasks, or is longer than
a chunk, is cut into chunks; each gives, for each state it may be entered in,
cost and rank of each state it may be left in, a table of 16 entries. As
different entries have different strings before them, ranks of entries decide
first, and tables combine from left to right without any strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, own_columns, small_side

#: What has been emitted: nothing, a system turn, a user's, an assistant's last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: The state that a turn of this initial leads to from each state; None where the pattern forbids it.
MOVES = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
#: The turn that an insertion or a changed role must bring in each state, and the state after it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
#: Faults of a turn; a blank or repeated one must go.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns and characters of text that a chunk holds, about; copies of one turn that are one row at most.
CHUNK_TURNS, CHUNK_TEXT, COPIES = 10_000, 1 << 20, 10_000
#: White space, as a turn's text counts as blank if it has nothing else.
SPACE = r"\x20\x09-\x0D"

#: (cost above the layer's least, rank) of each state, None where it can't be reached.
Layer = tuple[tuple[int, int] | None, ...]
#: (state before, code) of each state.
Parents = tuple[tuple[int, str] | None, ...]


def entered(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def macro_edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str]]:
    """(cost, state after, code) of a run of insertions and the edit of a turn. A third insertion would only lead where the first does."""
    code, cost = "", 0
    for _ in range(3):
        yield cost + DELETE, state, code + "D"
        if fault not in (BLANK, DUPLICATE):
            stays = cost + (TRUNCATED_STAYS if fault == TRUNCATED else 0)
            if (to := MOVES.get(initial, (None,) * 4)[state]) is not None:
                yield stays, to, code + "K"
            yield stays + REROLE, NEXT_STATE[state], code + "R"
        code, cost, state = code + "I", cost + INSERT, NEXT_STATE[state]


def _advance(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, Parents]:
    """The least cost added, the next layer and its pointers."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, own in enumerate(layer):
        if own is not None:
            for cost, to, code in macro_edits(state, initial, fault):
                found = (own[0] + cost, own[1], code, state)
                if to not in best or found < best[to]:
                    best[to] = found
    base = min(x[0] for x in best.values())
    ranks = {x: r for r, x in enumerate(sorted((rank, code) for _, rank, code, _ in best.values()))}
    after = tuple((best[s][0] - base, ranks[best[s][1], best[s][2]]) if s in best else None for s in STATES)
    return base, after, tuple((best[s][3], best[s][2]) if s in best else None for s in STATES)


_KNOWN: dict[tuple[Layer, str, int], tuple[int, Layer, Parents]] = {}


def advance(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, Parents]:
    """As ``_advance``; layers are few, as costs are relative and ranks below four, so each step is worked out once."""
    key = layer, initial if initial in MOVES else "", fault
    if key not in _KNOWN:
        _KNOWN[key] = _advance(*key)
    return _KNOWN[key]


def ending(layer: Layer) -> tuple[int, int, int]:
    """(cost added, last state, insertions) of the best end."""
    ends = []
    for state, own in enumerate(layer):
        if own is not None:
            more = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
            ends.append((own[0] + INSERT * more, own[1], state, more))
    cost, _, state, more = min(ends)
    return cost, state, more


@dataclass
class Chunk:
    """Turns of one conversation in order, as (initial, fault, copies, role, text); further copies of a turn repeat it."""

    turns: list[tuple[str, int, int, str, str]] = field(default_factory=list)
    n: int = 0
    size: int = 0

    def add(self, *turn) -> None:
        self.turns.append(turn)
        self.n += turn[2]
        self.size += len(turn[4])

    def full(self, turns: int = CHUNK_TURNS) -> bool:
        return self.n >= turns or self.size >= CHUNK_TEXT

    def layers(self) -> Iterator[tuple[str, int]]:
        for initial, fault, copies, _, _ in self.turns:
            yield initial, fault
            for _ in range(copies - 1):
                yield initial, BLANK if fault == BLANK else DUPLICATE

    def solve(self, entry: int) -> tuple[int, Layer, list[Parents]]:
        """Cost, last layer and all pointers, entered in one state."""
        cost, layer, pointers = 0, entered(entry), []
        for initial, fault in self.layers():
            more, layer, parents = advance(layer, initial, fault)
            cost += more
            pointers.append(parents)
        return cost, layer, pointers

    def table(self) -> list[int]:
        """Of each entry and each exit: cost and rank, -1 where there is no way."""
        out = []
        for entry in STATES:
            cost, layer, _ = self.solve(entry)
            for own in layer:
                out += [-1, -1] if own is None else [cost + own[0], own[1]]
        return out

    def edits(self, pointers: list[Parents], last: int) -> list[str]:
        """The codes that lead to ``last``, by following pointers back."""
        codes = []
        for parents in reversed(pointers):
            last, code = parents[last]
            codes.append(code)
        return codes[::-1]

    def apply(self, codes: list[str], state: int, more: int = 0) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stay or are inserted, from a state on, and of ``more`` insertions at the end."""
        at = iter(codes)
        for initial, _, copies, role, text in self.turns:
            for _ in range(copies):
                code = next(at)
                for _ in code[:-1]:
                    yield "I", NEXT_ROLE[state], ""
                    state = NEXT_STATE[state]
                if code[-1] == "K":
                    state = MOVES[initial][state]
                    yield "K", role, text
                elif code[-1] == "R":
                    yield "R", NEXT_ROLE[state], text
                    state = NEXT_STATE[state]
        for _ in range(more):
            yield "I", NEXT_ROLE[state], ""
            state = NEXT_STATE[state]


def combine(tables: list[list[int]]) -> tuple[int, list[tuple[int, int]], int]:
    """Chunks' tables from left to right: the least cost, each chunk's entry and exit, and the insertions at the end."""
    cost, layer, pointers = 0, entered(NOTHING), []
    for table in tables:
        best: dict[int, tuple[int, int, int, int]] = {}
        for entry, own in enumerate(layer):
            if own is None:
                continue
            for leave in STATES:
                more, rank = table[8 * entry + 2 * leave : 8 * entry + 2 * leave + 2]
                if more >= 0:
                    found = (own[0] + more, own[1], rank, entry)
                    if leave not in best or found < best[leave]:
                        best[leave] = found
        base = min(x[0] for x in best.values())
        ranks = {x: r for r, x in enumerate(sorted(x[1:3] for x in best.values()))}
        layer = tuple((best[s][0] - base, ranks[best[s][1:3]]) if s in best else None for s in STATES)
        pointers.append([best[s][3] if s in best else None for s in STATES])
        cost += base
    more, state, inserts = ending(layer)
    ways = []
    for parents in reversed(pointers):
        ways.append((parents[state], state))
        state = parents[state]
    return cost + more, ways[::-1], inserts


def lines(turns) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in turns)


def _text_id(*columns: str) -> Column:
    """A digest of strings that tells them apart."""
    return F.unhex(F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]), 256))


def _marked(turns: DataFrame) -> DataFrame:
    """Distinct turns with their copies and first faults, copies in rows of at most ``COPIES``.

    Copies are counted before the shuffle. A turn repeats an earlier one if a
    lesser turn number has its role and text; the least is an aggregate too.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("own", _text_id("role", "text")).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    again = rows.groupBy(F.col("conv").alias("of"), F.col("own").alias("same")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(again, rows["conv"].eqNullSafe(again["of"]) & (rows["own"] == again["same"]), "left")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    repeated = (F.col("piece") > 0) | F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    fault = F.when(blank, BLANK).when(repeated, DUPLICATE).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(SOUND)
    return rows.select("conv", "turn", "role", "text", "piece", F.least(F.lit(COPIES), F.col("copies") - COPIES * F.col("piece")).cast("int").alias("copies"), fault.cast("int").alias("fault"))


TURN = pa.struct([("initial", pa.string()), ("fault", pa.int32()), ("copies", pa.int32()), ("role", pa.string()), ("text", pa.string())])
KEPT = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")
CHUNK_FIELDS = [
    ("part", pa.int32()), ("k", pa.int32()), ("open", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("least", pa.int64()), ("most", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("table", pa.list_(pa.int64())), ("turns", pa.list_(TURN)), ("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string()), ("kept", pa.list_(KEPT)),
]
CHUNK_DDL = (
    "part int, k int, open boolean, blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first_turn long, last_turn long, first_initial string, last_initial string, table array<long>, "
    "turns array<struct<initial: string, fault: int, copies: int, role: string, text: string>>, cost long, audit string, sha256 string, kept array<struct<edit: string, role: string, text: string>>"
)
LEGAL = ("su", "ua", "au")


def _measures(chunk: Chunk, numbers: list[int | None]) -> dict:
    """Faults, illegal neighbours and turn numbers of a chunk by itself."""
    count = dict.fromkeys(COUNTS, 0)
    last = None
    for initial, fault, copies, _, _ in chunk.turns:
        again = BLANK if fault == BLANK else DUPLICATE
        for f, times in ((fault, 1), (again, copies - 1)):
            if f != SOUND:
                count[COUNTS[f - 1]] += times
        if last is not None:
            count["illegal"] += last + initial not in LEGAL
        count["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        last = initial
    known = [n for n in numbers if n is not None]
    count["distinct"] = sum(a != b for a, b in zip(known, [None, *known], strict=False))
    return count | {"least": min(known, default=None), "most": max(known, default=None), "first_turn": numbers[0], "last_turn": numbers[-1], "first_initial": chunk.turns[0][0], "last_initial": last}


def _chunks(ordered: DataFrame, keep_turns: bool, chunk_turns: int) -> DataFrame:
    """A row for each conversation that lies inside a task, solved, and for each chunk of the others."""
    conv_type = ordered.schema["conv"].dataType.simpleString()

    def make(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema, held, size = None, [], 0
        chunk, numbers, conv, k, opened = Chunk(), [], None, 0, True

        def row(closed: bool) -> dict:
            out = {"conv": conv, "part": part, "k": k, "open": not closed} | _measures(chunk, numbers)
            if not closed:
                return out | {"table": chunk.table(), "turns": [dict(zip(("initial", "fault", "copies", "role", "text"), t, strict=True)) for t in chunk.turns]}
            cost, layer, pointers = chunk.solve(NOTHING)
            more, state, inserts = ending(layer)
            codes = chunk.edits(pointers, state)
            kept = list(chunk.apply(codes, NOTHING, inserts))
            turns = [dict(zip(("edit", "role", "text"), t, strict=True)) for t in kept] if keep_turns else None
            return out | {"cost": cost + more, "audit": "".join(codes) + "I" * inserts, "sha256": hashlib.sha256(lines(kept).encode("utf-8", "surrogatepass")).hexdigest(), "kept": turns}

        def flush():
            nonlocal held, size
            out = pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
            return out

        started = False
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field(0).type), *CHUNK_FIELDS])
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for new_conv, turn, role, text, copies, fault in zip(*columns, strict=True):
                if started and new_conv != conv:
                    held.append(row(closed=not opened))
                    size += chunk.size
                    chunk, numbers, k, opened = Chunk(), [], 0, False
                elif started and chunk.full(chunk_turns):
                    opened = True
                    held.append(row(closed=False))
                    size += chunk.size
                    chunk, numbers, k = Chunk(), [], k + 1
                started, conv = True, new_conv
                chunk.add(role[:1], fault, copies, role, text)
                numbers.append(turn)
                if size > CHUNK_TEXT or len(held) >= 2000:
                    yield flush()
        if started:
            held.append(row(closed=False))
            yield flush()

    return ordered.mapInArrow(make, f"conv {conv_type}, {CHUNK_DDL}")


WAYS = "part int, k int, entry int, leave int, inserts int, cost long, blank long, duplicate long, truncated long, illegal long, gaps long, last boolean"


def _ways(chunks: DataFrame) -> DataFrame:
    """How each chunk of a cut conversation is entered and left, and the conversation's measures, on its last chunk's row."""
    conv_type = chunks.schema["conv"].dataType.simpleString()
    names = ["part", "k", *COUNTS, "least", "most", "first_turn", "last_turn", "first_initial", "last_initial", "table"]
    grouped = chunks.where("open").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("chunks"))

    def find(batches):
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), *((c.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in WAYS.split(", "))])
            for row in batch.to_pylist():
                parts = row["chunks"]
                cost, ways, inserts = combine([c["table"] for c in parts])
                total = {c: sum(p[c] for p in parts) for c in COUNTS}
                for left, right in zip(parts, parts[1:], strict=False):
                    total["illegal"] += left["last_initial"] + right["first_initial"] not in LEGAL
                    total["distinct"] -= left["last_turn"] is not None and left["last_turn"] == right["first_turn"]
                known = [p for p in parts if p["least"] is not None]
                gaps = max(p["most"] for p in known) - min(p["least"] for p in known) + 1 - total["distinct"] if known else 0
                out = []
                for i, (c, (entry, leave)) in enumerate(zip(parts, ways, strict=True)):
                    last = i == len(parts) - 1
                    own = {"cost": cost, "gaps": gaps, **{c: total[c] for c in COUNTS[:4]}} if last else {}
                    out.append({"conv": row["conv"], "part": c["part"], "k": c["k"], "entry": entry, "leave": leave, "inserts": inserts if last else 0, "last": last} | own)
                yield pa.RecordBatch.from_pylist(out, schema)

    return grouped.mapInArrow(find, f"conv {conv_type}, {WAYS}")


def _pieces(chunks: DataFrame, ways: DataFrame) -> DataFrame:
    """The edits, lines and turns of each chunk of the cut conversations."""
    conv_type = chunks.schema["conv"].dataType.simpleString()
    # of few rows: two for each task at most, and one for each ``CHUNK_TURNS`` turns or ``CHUNK_TEXT`` of text
    found = small_side(ways.select(F.col("conv").alias("of"), F.col("part").alias("p"), F.col("k").alias("i"), "entry", "leave", "inserts"))
    joined = chunks.where("open").select("conv", "part", "k", "turns").join(found, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("k") == F.col("i")))

    def build(batches):
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), ("part", pa.int32()), ("k", pa.int32()), ("audit", pa.string()), ("lines", pa.string()), ("kept", pa.list_(KEPT))])
            for row in batch.to_pylist():
                chunk = Chunk()
                for t in row["turns"]:
                    chunk.add(t["initial"], t["fault"], t["copies"], t["role"], t["text"])
                _, _, pointers = chunk.solve(row["entry"])
                codes = chunk.edits(pointers, row["leave"])
                kept = list(chunk.apply(codes, row["entry"], row["inserts"]))
                turns = [dict(zip(("edit", "role", "text"), t, strict=True)) for t in kept]
                own = {"audit": "".join(codes) + "I" * row["inserts"], "lines": lines(kept) if kept else None, "kept": turns}
                yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "part": row["part"], "k": row["k"]} | own], schema)

    ddl = f"conv {conv_type}, part int, k int, audit string, lines string, kept array<struct<edit: string, role: string, text: string>>"
    return joined.select("conv", "part", "k", "turns", "entry", "leave", "inserts").mapInArrow(build, ddl)


def _joined(pieces: DataFrame) -> DataFrame:
    """Edit strings and digests of the cut conversations; a task reads a conversation's pieces in order and holds one at a time, but for the edits."""
    conv_type = pieces.schema["conv"].dataType.simpleString()

    def join(batches):
        schema, started, conv, digest, audit, any_line = None, False, None, None, [], False
        done = lambda: pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "sha256": digest.hexdigest()}], schema)
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.schema.field(0).type), ("audit", pa.string()), ("sha256", pa.string())])
            for row in batch.to_pylist():
                if not started or row["conv"] != conv:
                    if started:
                        yield done()
                    started, conv, digest, audit, any_line = True, row["conv"], hashlib.sha256(), [], False
                audit.append(row["audit"])
                if row["lines"] is not None:
                    digest.update((b"\n" if any_line else b"") + row["lines"].encode("utf-8", "surrogatepass"))
                    any_line = True
        if started:
            yield done()

    ordered = pieces.select("conv", "part", "k", "audit", "lines").repartition("conv").sortWithinPartitions("conv", "part", "k")
    return ordered.select("conv", "audit", "lines").mapInArrow(join, f"conv {conv_type}, audit string, sha256 string")


def repair_conversations(conversations: DataFrame, keep_turns: bool = False, chunk_turns: int = CHUNK_TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations brought to ``(s?(ua)+)?`` by their cheapest edits; equal costs by the least edit string.

    Turns are taken by number, null first, those of one number by role and
    text. A turn's first fault counts: blank, duplicate (role and text of an
    earlier one), truncated (not ended by . ! or ?). Keeping costs nothing, a
    new role (user or assistant) 1, deletion 2, an inserted empty turn 5;
    a truncated turn that stays 5 more. Blank and duplicate turns go.

    First result, a row for each conversation with turns: conv_id, gaps (missing
    turn numbers), blank, duplicate, truncated, illegal (neighbours that are
    none of su, ua, au), cost, audit (initials of the edits), repaired_sha256
    (of lines ``role:text``). Second result, with ``keep_turns``: conv_id,
    position, edit, role, text of the repaired turns, else no rows.

    A chunk of a long conversation has ``chunk_turns`` turns. Null roles and
    texts count as one space; null ids are one conversation; repeated turns are duplicates; other columns are ignored; an empty table
    gives no rows. Neither a long conversation nor copies of a turn are held by
    one task; but its edit string is one value of the result.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "conversations")
    turns = own_columns(conversations, conv=id_col, turn=turn_col, role=role_col, text=text_col)
    turns = turns.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = scratch.save(_marked(turns), "marked")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.substring("text", 1, 64), F.col("piece"))
    ordered = dealt.sortWithinPartitions(*order, "text", "piece").select("conv", "turn", "role", "text", "copies", "fault")
    chunks = scratch.save(_chunks(ordered, keep_turns, chunk_turns), "chunks")
    scratch.drop("marked")
    ways = scratch.save(_ways(chunks), "ways")
    pieces = scratch.save(_pieces(chunks, ways), "pieces")
    measures = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    inside = chunks.where("not open").select("conv", gaps.alias("gaps"), *measures, "audit", "sha256")
    cut = _joined(pieces).join(ways.where("last").select(F.col("conv").alias("of"), "gaps", *measures), F.col("conv").eqNullSafe(F.col("of")))
    summary = inside.unionByName(cut.select("conv", "gaps", *measures, "audit", "sha256"))
    kept = chunks.where("not open").select("conv", "part", "k", "kept").unionByName(pieces.select("conv", "part", "k", "kept"))
    kept = kept if keep_turns else kept.where(F.lit(False))
    before = Window.partitionBy("of").orderBy("p", "i").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("conv").alias("of"), F.col("part").alias("p"), F.col("k").alias("i"), F.size("kept").cast("long").alias("n")).withColumn("start", F.sum("n").over(before))
    kept = kept.join(starts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("k") == F.col("i")), "left")
    kept = kept.select("conv", F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.posexplode("kept").alias("at", "turn"))
    repaired = kept.select(F.col("conv").alias(id_col), (F.col("start") + F.col("at")).alias("position"), F.col("turn.edit").alias("edit"), F.col("turn.role").alias("role"), F.col("turn.text").alias("text"))
    return summary.select(F.col("conv").alias(id_col), "gaps", *measures, "audit", F.col("sha256").alias("repaired_sha256")), repaired
