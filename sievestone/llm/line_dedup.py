"""Near-duplicate lines: MinHash over character shingles, exact checks, one line kept of each component."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, fresh, own_columns, slices, small_side, text_key
from .nearness import Banding, as_long, distinct, finish32, long_lists, near_components

LINE = "doc_id long, text_key long, line int, node long, check long, n int, bands array<long>, sig array<long>"


@dataclass(frozen=True)
class LineDedup:
    chars: int = 5
    banding: Banding = field(default_factory=lambda: Banding(bands=16, rows=5, slack=0.2))


def normal(line: str) -> str:
    """A-Z and other letters in lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.lower().split())


def shingles(line: str, c: int) -> set:
    """Distinct runs of c characters of a normalised line; a shorter line is one run."""
    return {line[i : i + c] for i in range(len(line) - c + 1)} if len(line) >= c else {line} if line else set()


class Runs:
    """``shingles`` of a line as a set with a size and a meet: sorted numbers of twelve bits a character where that tells all apart, else strings."""

    def __init__(self, line: str, c: int):
        self.line, self.c, self.codes = line, c, None
        if c <= 5 and len(line) >= c:
            points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if int(points.max()) < 1 << 12:
                n, codes = len(points) - c + 1, np.uint64(0)
                for i in range(c):
                    codes = codes << np.uint64(12) | points[i : n + i]
                self.codes = distinct(codes)
        self.size = len(shingles(line, c)) if self.codes is None else len(self.codes)

    def __len__(self) -> int:
        return self.size

    def __and__(self, other: "Runs"):
        if self.codes is None or other.codes is None:
            return shingles(self.line, self.c) & shingles(other.line, other.c)
        both = np.sort(np.concatenate([self.codes, other.codes]))
        return both[1:][both[1:] == both[:-1]]


def shingle_hashes(lines: list[str], c: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit hashes of the runs of c characters of many lines, end to end, and how many each line has; a shorter line has one."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    padded = "".join(line if len(line) >= c else line.ljust(c, "\0") for line in lines)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.maximum(size, c)
    total = np.full(max(0, len(points) - c + 1), c, np.uint32)
    for i in range(c):
        total = (total + points[i : len(points) - c + 1 + i]) * np.uint32(0x9E3779B1)
        total ^= total >> np.uint32(15)
    runs, within = size - c + 1, np.ones(len(total), bool)
    for i in range(1, c):  # runs across two lines are left out
        within[np.cumsum(size)[:-1] - i] = False
    found = distinct(np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), runs) | finish32(total[within]))
    return found.astype(np.uint32), np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(lines))


def sketch_lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    """A row for each line that is not blank; bands and signature where its task sees the line for the first time."""
    c, banding = p.chars, p.banding

    def sketch(batches):
        make = banding.sketcher()
        known: dict[str, tuple] = {}
        for batch in slices(batches, 1, size=1 << 18):
            rows, new = [], {}
            for k, text in enumerate(batch.column(1).to_pylist()):
                for i, line in enumerate((text or "").split("\n")):
                    if line := normal(line):
                        if (held := known.get(line)) is None:
                            d = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                            held = known[line] = (as_long(d & 0xFFFFFFFFFFFFFFFF), as_long(d >> 64))
                            new[line] = len(rows)
                        rows.append((k, i, *held))
            if not rows:
                continue
            doc, at, node, check = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            h, n = shingle_hashes(list(new), c)
            big = n >= banding.least_size
            keys, sig = make(h[np.repeat(big, n)], n[big])
            first = np.array(list(new.values()), np.int64)
            size, sketched = np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
            size[first], sketched[first[big]] = n, True
            doc = pa.array(doc)
            columns = [batch.column(0).take(doc), batch.column(2).take(doc), pa.array(at.astype(np.int32)), pa.array(node), pa.array(check), pa.array(size), long_lists(sketched, keys), long_lists(sketched, sig)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "line", "node", "check", "n", "bands", "sig"])
            if len(known) >= 20_000:
                known.clear()

    return docs.mapInArrow(sketch, LINE)


def line_classes(docs: DataFrame, params: LineDedup = LineDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that is not blank with its near-duplicate class.

    Returns doc_id, line (from 0, lines end at a line feed), class_doc_id and
    class_line (the earliest line of the class by doc_id, then line), kept
    (whether it is that line) and text_key (of id and text). Lines are compared
    in lower case with white space collapsed; equal ones are one node, others
    link if their sets of character runs have similarity >= percent / 100,
    confirmed on full lines. Blank lines and null texts have no rows. Null ids
    come after all others; different texts under one id, null included, are
    documents of their own, in the order of text_key, and rows of equal id and
    text are one document. An empty table gives no rows; other columns are
    ignored.
    """
    return _classes(docs, params, id_col, text_col)[0]


def _classes(docs, params, id_col, text_col) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(docs.sparkSession, "lines")
    source = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_key())
    rows = scratch.save(sketch_lines(source, params), "sketches", **{"parquet.enable.dictionary": "false"})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key", "line"))
    classes = scratch.save(rows.groupBy("node", "check").agg(first.alias("first")), "classes")
    c = params.chars

    def texts_for(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(small_side(nodes), "node").select("node", "first.text_key", "first.line")
        wanted = wanted.groupBy("text_key").agg(F.collect_list(F.struct("line", "node")).alias("wanted"))
        wanted = small_side(wanted, width=F.size("wanted"))

        def cut(batches):
            seen: set[int] = set()
            for batch in slices(batches, 0):
                node, text = [], []
                for t, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    lines = t.as_py().split("\n")
                    for w in wanted:
                        if w["node"] not in seen:
                            node.append(w["node"])
                            text.append(normal(lines[w["line"]]))
                if len(seen) < 200_000:  # rows of equal id and text bring a line again, which does no harm
                    seen.update(node)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.string())], ["node", "text"])

        return source.join(wanted, "text_key").select("text", "wanted").mapInArrow(cut, "node long, text string")

    parts = near_components(rows, texts_for, lambda line: Runs(line, c), lambda line: shingle_hashes([line], c)[0], params.banding, scratch)
    linked = small_side(parts.select(F.explode(F.array("node", "component")).alias("node"), "component").distinct())
    near = classes.join(linked, "node")
    joined = near.groupBy("component").agg(F.min("first").alias("best"))
    moved = near.join(small_side(joined), "component").select("node", "check", "best")
    best = scratch.save(classes.join(small_side(moved), ["node", "check"], "left").select("node", "check", F.coalesce("best", "first").alias("best")), "best")
    scratch.drop("classes", "components")
    out = rows.select("doc_id", "text_key", "line", "node", "check").join(best, ["node", "check"])
    kept = (F.col("text_key") == F.col("best.text_key")) & (F.col("line") == F.col("best.line"))
    return out.select("doc_id", "line", F.col("best.doc_id").alias("class_doc_id"), F.col("best.line").alias("class_line"), kept.alias("kept"), "text_key"), scratch


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the numbers given; a null list leaves a text as it is."""
    out = []
    for text, lines in zip(texts, gone, strict=True):
        if text.is_valid and lines.is_valid:
            drop = set(lines.as_py())
            out.append("\n".join(x for i, x in enumerate(text.as_py().split("\n")) if i not in drop))
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, params: LineDedup = LineDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the kept line of each class in every text; columns stay as they are.

    Blank lines stay. A text that loses all its lines is empty, not null; null
    texts are returned as they are. Rows of equal id and text lose the same
    lines; other rows of the same id, or of a null id, are judged by their own
    texts.
    """
    lines, scratch = _classes(docs, params, id_col, text_col)
    gone = lines.where("not kept").groupBy(F.col("text_key").alias("gone_key")).agg(F.collect_set("line").alias("gone"))
    gone = small_side(scratch.save(gone, "gone"), width=F.size("gone"))
    key = fresh(docs, "row_key")
    marked = docs.withColumn(key, F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"]))
    joined = marked.join(gone, marked[key] == gone["gone_key"], "left")
    return joined.select(*[(_without(marked[f"`{c}`"], gone["gone"]) if c == text_col else marked[f"`{c}`"]).alias(c) for c in docs.columns])
