"""Token ids of whole texts by the tokenizers library, with a bounded table of text pieces.

Encoding a corpus word by word costs far less than text by text, since most
words come again and again. Two kinds of tokenizer allow cuts at white space
without any change of the ids; both are told from the tokenizer's own file:

- "led": byte-level with the usual pattern and no normaliser. A piece is a word
  with the single blank before it.
- "dropped": white space is collapsed and removed before the model. A piece is
  a word.

A text with white space that these rules don't cover, one that holds the string
of an added token, and any other tokenizer, is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
WORD, WORD_AND_MARKS = re.compile(LETTERS), f"^\r?{LETTERS}{MARKS}$"
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: White space by its code, and the part of it that ASCII has.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
ASCII_SPACES = [c for c in SPACES if c.isascii()]
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder for a tokenizer file, one for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        give_back()  # what reading the file took
    return _ENCODERS[path]


def byte_letters() -> dict[int, str]:
    """Byte-level models' stand-in for each byte: itself if printable in Latin-1, else the next free letter from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


def spaced(text: str, allowed: str) -> bool:
    """Whether a text has no white space but of the kinds allowed; many times faster than a regular expression."""
    return not any(c in text for c in (ASCII_SPACES if text.isascii() else SPACES) if c not in allowed)


def single(text: str) -> bool:
    """Whether blanks and line feeds are the only white space, none beside another one."""
    return spaced(text, " \n") and not any(two in text for two in ("  ", " \n", "\n ", "\n\n"))


def caseless(token: str) -> str:
    """The longest run of ASCII characters without case in a token; a text that lacks it lacks the token, in whatever case."""
    return max(re.findall(r"[!-@\[-`{-~]+", token), key=len, default="")


def latin(text: str) -> bool:
    """Whether a text has letters of Latin-1 alone, whose lower case is a letter of Latin-1 each."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def ragged(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``ids``, end to end."""
    after = np.cumsum(sizes, dtype=np.int32)
    return ids[np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]


class Encoder:
    """``many(texts)``: of each text the ids that the library gives for it whole, without its own special tokens around it, as NumPy arrays.

    Texts are cut at white space by Arrow, and words from the marks after them;
    each distinct piece is looked up once a call among those known, and the
    library is asked for new ones alone. Of more than ``limit`` known pieces the
    half last used stays. In "led" tokenizers a piece has a blank before it, but
    for a line feed and for pieces marked by a carriage return, which start a
    line or follow a word.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))), re.IGNORECASE) if added else None
        self.signs = {caseless(t) for t in added}
        self.kind = self._kind(json.loads(self.tokenizer.to_str()))
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.type is np.uint16 else "I"
        self.tokens = self.tokenizer.model.tokenize
        self.letters = "".join(c for _, c in sorted(byte_letters().items()))
        self.start = "\r" if self.kind == "led" else ""  # marks a piece without a blank before it
        self.limit = limit
        self.pieces = pa.array([], pa.string())
        self.flat = np.zeros(0, self.type)
        self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.calls = 0

    @staticmethod
    def _kind(spec: dict) -> str:
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return "led"
        norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        steps = [s.get("type") for s in before.get("pretokenizers", [])]
        if norms == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("invert") and r"[^\s\p{L}\p{N}]+" in before["pretokenizers"][0]["pattern"].get("Regex", ""):
            return "dropped"
        return "whole"

    def ids(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null one has none. Working arrays are several times the texts, so callers hand over a few MB."""
        out: list = [None] * len(texts)
        cut, places = [], []
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, self.type)
            elif (pieces := self._cuttable(text)) is None:
                out[k] = np.frombuffer(self._whole(text), self.type)
            else:
                cut.append(pieces)
                places.append(k)
        if cut:
            strings = pa.array(cut, pa.string())
            lists = pc.split_pattern(strings, " ") if self.kind == "led" else pc.ascii_split_whitespace(strings)
            words = lists.flatten().dictionary_encode()
            ids, size = self._words(words.dictionary)
            at = words.indices.to_numpy()
            n = size[at]
            flat = ragged(ids, (np.cumsum(size, dtype=np.int32) - size)[at], n)
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
            for k, lo, hi in zip(places, [0, *ends], ends):
                out[k] = flat[lo:hi]
        return out

    def _cuttable(self, text: str) -> str | None:
        """The text as it is to be cut at blanks or at white space, None for one to be encoded whole."""
        if self.added and any(sign in text for sign in self.signs) and self.added.search(text):
            return None
        if self.kind == "dropped" and spaced(text, " \n\t\r"):
            return text.lower() if latin(text) else text
        if self.kind == "led" and single(text):
            return "\r" + text.replace("\n", " \n \r")
        return None

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and how many each has; a word and the marks after it are pieces of their own."""
        marked = pc.less(pc.binary_length(pc.ascii_rtrim(words, SIGNS)), pc.binary_length(words))
        if pc.any(marked).as_py():  # few words, so the expression is run over those alone
            marked = pc.replace_with_mask(marked, marked, pc.match_substring_regex(words.filter(marked), WORD_AND_MARKS))
        both = words.filter(marked)
        stems = pc.replace_with_mask(words, marked, pc.ascii_rtrim(both, SIGNS))
        parts = pa.concat_arrays([stems, pc.replace_substring_regex(both, f"^\r?{LETTERS}", self.start)]).dictionary_encode()
        ids, starts, size = self._known(parts.dictionary)
        at = np.full((len(words), 2), len(size), np.int32)  # no second part: an empty one
        of = parts.indices.to_numpy()
        at[:, 0] = of[: len(words)]
        at[marked.to_numpy(zero_copy_only=False), 1] = of[len(words) :]
        starts, size = np.append(starts, np.int32(0)), np.append(size, np.int32(0))
        n = size[at]
        return ragged(ids, starts[at.ravel()], n.ravel()), n.sum(axis=1, dtype=np.int32)

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many pieces, and where each one's start and how many there are; new pieces become known."""
        self.calls += 1
        place = pc.index_in(pieces, self.pieces)
        new = pieces.filter(place.is_null())
        made = [self._piece(p) for p in new.to_pylist()]
        at = place.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self.size), len(self.size) + len(made), dtype=np.int32)
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), self.type)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, made), np.int32, len(made)) // np.int32(self.flat.itemsize)])
        self.used = np.concatenate([self.used, np.zeros(len(made), np.int32)])
        self.used[at] = self.calls
        ids, starts = self.flat, np.cumsum(self.size, dtype=np.int32) - self.size
        found = ids, starts[at], self.size[at]
        if len(self.size) > self.limit:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            self.flat = ragged(ids, starts[keep], self.size[keep])
            self.pieces, self.size, self.used = self.pieces.take(pa.array(keep)), self.size[keep], self.used[keep]
        return found

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token of letters."""
        if self.kind == "dropped":
            word = word.lower()
        if not word.isascii():
            word = charmap_decode(word.encode(), "strict", self.letters)[0]
        elif word[0] == " ":
            word = self.letters[32] + word[1:]
        return array(self.code, [t.id for t in self.tokens(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        lead = ""
        if self.kind == "led":
            if piece == "\n":
                return self._whole(piece)
            if piece[:1] == "\r":
                piece = piece[1:]
            else:
                lead = " "
        if not lead + piece:
            return b""
        return self._word(lead + piece) if (piece.isalpha() if piece.isascii() else WORD.fullmatch(piece)) else self._whole(lead + piece)
