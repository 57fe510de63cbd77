"""Alignment of two tokenizers against whole texts tokenised and linked token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sievestone.llm import queries
from sievestone.llm.alignment import align_documents, align_segment, cut_points, group_texts, merge_path, models, pack, segments, unpack
from sievestone.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Rows as the contract has them, from whole texts, every token against every token it overlaps."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    raw = {letter: byte for byte, letter in byte_letters().items()}
    a_bytes = lambda i: bytes(raw[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ends = []
        for ids, of in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(of(i))))
                at += len(of(i))
            ends.append(out)
        if b"".join(map(a_bytes, x)) != whole or b"".join(map(b_bytes, y)) != whole or not text:
            found.append(None)
            continue
        links = [(i, j) for i, s, e in ends[0] for j, t, f in ends[1] if s < f and t < e]
        cuts = sorted({e for _, _, e in ends[0]} & {e for _, _, e in ends[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= c) for side in ends))
            last = c
        found.append((len(x), len(y), links, groups))
    n = Counter(p for f in found if f for p in set(f[2]))
    most = {}
    for (i, _), k in n.items():
        most[i] = max(most.get(i, 0), k)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[3]), len(f[2]), sum(n[p] == most[p[0]] for p in f[2]), sum(n[p] for p in f[2]), hashlib.sha256(";".join(f[3]).encode()).hexdigest()) for f in found]


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  \n", "\n", "\n\nb", "x \n y\n\n  z", "tab\tand\r\nreturn\r\n", "no break 　wide", "it's we'll DON'T", "<|endoftext|> <s> </s> <unk>", "<0x41>", "lower▁block",
    "日本語 テキスト", "👩‍👩‍👧 family", "é é", "a\u0000b", "x" * 700, "аб" * 400 + " end", "1234567 12,5 €", "  lead and trail  ", "word\n \nword", "\x1c\x1d sep", "a​ b", "ünï cöde\tx  y",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    rows = [(k if k != 3 else None, t, 1, "x") for k, t in enumerate(ODD)] + [(5, "a ", 2, "y"), (5, "other", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segments long, codes string")
    got = sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in align_documents(docs, A, B)[0].collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows]), strict=True)), key=str)
    assert got == want


def test_groups_as_text_and_pairs(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, "two words more"), (3, None)], "doc_id long, text string")
    found, pairs = align_documents(docs, A, B, keep_groups=True)
    rows = {r.doc_id: r for r in found.collect()}
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows.values() if r.groups) and rows[3].groups == ""
    n = {(r.a, r.b): r for r in pairs.collect()}
    first = tuple(map(int, rows[1].groups.split(";")[0].split("|")))
    assert n[first].n == 2 and n[first].best
    assert align_documents(docs.where("doc_id > 3"), A, B)[0].collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 3000]
    want = dict(zip([d.doc_id for d in short], plain([d.text for d in short]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_token_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[d][:4] + got[d][6:] == w[:4] + w[6:] for d, w in want.items())  # counts over documents need all of them


def test_cuts_are_verified_from_the_vocabularies():
    a, b = models(A, B)
    assert cut_points(a, b) == " \n"
    a_like = type("Model", (), {"splits": True, "bytes": [*a.bytes, b"x y"]})()
    assert cut_points(a_like, b) == "\n" and segments("a b\nc", "\n") == [" a b", "\nc"]
    assert segments("a b", "") == [" a b"]
    assert segments("a  b\tc\n\nd ", " \n") == [" a", "  b\tc", "\n\nd", " "]


@pytest.mark.parametrize("sizes", [([1], [1]), ([2, 3], [1, 4]), ([1] * 300, [150, 150]), ([3, 3], [2, 2, 2])])
def test_paths_close_groups_at_common_ends(sizes):
    a_bytes, b_bytes = [[b"x" * n for n in s] for s in sizes]
    ids = [list(range(len(s))) for s in sizes]
    path = merge_path(*ids, a_bytes, b_bytes)
    assert path[-1] == 2 and sum(s != 1 for s in path) == len(sizes[0]) and sum(s != 0 for s in path) == len(sizes[1])
    own = align_segment("x" * sum(sizes[0]), *ids, a_bytes, b_bytes)
    assert own[:2] == (len(sizes[0]), len(sizes[1])) and own[4] == path
    assert align_segment("y", *ids, a_bytes, b_bytes) == (0, 0, b"", b"", b"")
    groups = group_texts(*(np.array(i) for i in ids), np.frombuffer(path, np.uint8), np.array([0, len(path), 0]))
    assert groups[0] == groups[2] == "" and groups[1].count(";") == sum(s == 2 for s in path) - 1


def test_packs():
    assert unpack(pack(b"", b"a", b"bc" * 500)) == [b"", b"a", b"bc" * 500]
