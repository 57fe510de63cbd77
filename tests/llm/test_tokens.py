"""Token ids, Huffman files and packing: exact round trips."""

import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievestone.llm import token_files as files
from sievestone.llm.common import Scratch
from sievestone.llm.packing import Packer, Packing, pack_documents
from sievestone.llm.tokens import Encoder, encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
FRESH = {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}
ODD = ["", None, " ", "\n", "a", "Hello, world!! It's 1999.\nNew  line\t tab", "Éa être ç'est İstanbul ΣΑΣ", "x y z　w \x1c a\x1fb", "word&&& ###token$$$ <|endoftext|> |", "don't we'll I'M 'S it's", "日本語 テスト ok", "é café ́x", " lead trail ", "a\n\nb\n c \nd", "\r\nx\ry"]


def test_kinds_are_told_from_the_files():
    assert (encoder(WORD).kind, encoder(BYTE).kind) == ("dropped", "led")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_tokenizers_ids(path):
    e, fresh = Encoder(path, limit=8), Tokenizer.from_file(path)  # emptied again and again
    for text in [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|STARTOFTEXT|><|startoftext|>y"]:
        assert e.ids(text).tolist() == (fresh.encode(text, add_special_tokens=False).ids if text else [])
    assert 49407 in encoder(WORD).ids("a <|endoftext|> b") and 50256 in encoder(BYTE).ids("a <|endoftext|> b")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_piece_is_encoded_once_however_few_are_kept(path):
    e, asked = Encoder(path, limit=4), []
    tokens = e.tokens
    e.tokens = lambda word: asked.append(word) or tokens(word)
    texts = [" ".join(f"word{chr(97 + k)}" + mark for k in range(20)) for mark in ("", ",", ".", "!", "...")] * 3
    for got, text in zip(e.many([*ODD, *texts]), [*ODD, *texts], strict=True):
        assert got.tolist() == (FRESH[path].encode(text, add_special_tokens=False).ids if text else [])
    assert len(asked) == len(set(asked)) and sum("word" in w for w in asked) < 25 and len(e.size) <= 4


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aZé ß.,'!\n\t  1<|>İσΣ中́ ")), max_size=40))
def test_any_text_gives_the_tokenizers_ids(text):
    for path in (WORD, BYTE):
        e = encoder(path)
        assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most,n", [(16, 300), (9, 300), (4, 16)])
def test_codes_are_canonical_and_limited(most, n):
    counts = (1.6 ** np.minimum(np.arange(n), 60)).astype(np.int64)
    lengths = files.code_lengths(counts, most)
    assert lengths.max() <= most and sum(2.0 ** -lengths.astype(float)) == 1.0
    codes = [format(c, f"0{k}b") for c, k in zip(files.canonical_codes(lengths), lengths, strict=True)]
    assert not any(a != b and b.startswith(a) for a, b in product(codes[:40], codes[:40]))
    assert files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_lengths_are_optimal_without_a_limit_in_the_way():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 100, 40)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        cost += (two := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, two)
    assert int((files.code_lengths(counts) * counts).sum()) == cost


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_TOKENS", 50)
    texts = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(40, "word " * 3000), (None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, part string")
    folder = Scratch(spark, "t").path
    files.write_ids(df.repartition(3), folder, WORD, 2)
    rows = files.read_ids(spark, folder).collect()
    rows.sort(key=lambda r: r.start)
    e = encoder(WORD)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == sorted(-1 if i is None else i for i, _ in texts)
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    ours = sorted((str(r.doc_id), bytes(r.ids)) for r in rows)
    assert ours == sorted((str(i), np.append(e.ids(t).astype("<u4"), 2).astype("<u4").tobytes()) for i, t in texts)
    empty = Scratch(spark, "t").path
    files.write_ids(df.limit(0), empty, WORD, 2)
    assert files.read_ids(spark, empty).count() == 0


def test_packing_places_every_id_once(spark):
    rng = np.random.default_rng(4)
    texts = list(enumerate([*ODD, *("word " * int(n) for n in rng.integers(1, 6000, 30))])) + [(None, "no id"), (1, "again")]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, offset long").repartition(2)
    rows = pack_documents(df, BYTE, 1).collect()
    e = encoder(BYTE)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in sequences.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert total == 2048 or total & (total - 1) == 0  # no padding at all
    one = {r.start: r for r in rows if r.doc_id == len(ODD)}
    whole = b"".join(bytes(one[s].ids) for s in sorted(one))
    assert zlib.crc32(whole) == zlib.crc32(np.append(e.ids(texts[len(ODD)][1]).astype("<u4"), 1).astype("<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(e.ids(t)) + 1 for _, t in texts)
    assert pack_documents(df.limit(0), BYTE, 1).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(6)
    p = Packing(tokens=100, segments=4, loss_tokens=40, window=16)
    packer, examples, out = Packer(p), {}, []
    for k in range(200):
        n = int(rng.integers(1, 150))
        examples[k] = (n, int(rng.integers(0, n)))
        out += packer.add(k, *examples[k])
    out += packer.finish()
    placed = dict.fromkeys(examples, 0)
    for _, pieces in out:
        assert sum(n for _, _, n, _ in pieces) <= 100 and len(pieces) <= 4
        assert sum(max(0, s + n - max(s, examples[k][1])) for k, s, n, _ in pieces) <= 40
        for k, s, n, _ in pieces:
            assert s == placed[k]
            placed[k] += n
    assert placed == {k: n for k, (n, _) in examples.items()}


@pytest.mark.parametrize("vocabulary", [300, 70_000, 140_000])
def test_any_number_of_ids_round_trips(vocabulary):
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(vocabulary), rng.zipf(1.3, 50_000) % vocabulary])
    rng.shuffle(ids)
    lengths = files.code_lengths(np.bincount(ids))
    ends = np.array([0, 10, 10, len(ids) // 2, len(ids)])
    payload, offsets, _ = files.encode_documents(ids, ends, lengths, files.canonical_codes(lengths))
    got = files.decoder(lengths)(payload, 8 * offsets[:-1], np.diff(ends, prepend=0))
    assert (got == ids).all() and lengths.max() <= max(16, int(vocabulary - 1).bit_length() + 1)
