"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's encoding is found without replaying merges. For every prefix exactly one token can be last: a
token that ends there (an automaton over the vocabulary gives all of them) and that is compatible with
the unique last token of the prefix before it. Two tokens are compatible when no merge across their
border would have come before the merges that made them. Back-pointers then give the ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

#: Added to the code point of a word's last symbol, which the vocabulary writes with its word-end suffix.
LAST = 0x1000
#: Entries of each of a worker's caches; a full one becomes the older of two.
CACHE = 100_000
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\p{White_Space}]+")


def _byte_symbols() -> list[str]:
    """The visible character of each byte value, as byte-level vocabularies write it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PrefixEncoder:
    """The tokens of single words, from a merge list and a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.ids, self.ranks, self.made, self.halves = vocab, {}, {}, {}
        units = {}
        for c in _byte_symbols():
            units[vocab[c]] = c
            if suffix:
                units[vocab[c + suffix]] = chr(ord(c) + LAST)
        self.made = dict.fromkeys(units, -1)
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.ranks[left, right] = rank
            if left in units and right in units and whole not in self.made and self.compatible(left, right, rank):
                units[whole] = units[left] + units[right]
                self.made[whole], self.halves[whole] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for token, text in units.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self.suffix, self.pairs, self.known = bool(suffix), 0, {token: {} for token in units}

    def compatible(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge earlier than `before` joins symbols across the border of two finished tokens."""
        made, halves, ranks = self.made, self.halves, self.ranks
        while True:
            if ranks.get((left, right), before) < before:
                return False
            at_left, at_right = made[left], made[right]
            if at_left > at_right:  # the left token was finished last: look at the border before that
                before, left = at_left, halves[left][1]
            elif at_right >= 0:  # equal merges go from left to right, so one across the border would have won
                before, right = at_right + 1, halves[right][0]
            else:
                return True

    def word(self, symbols: str) -> list[int]:
        """Ids of one word given in visible byte characters."""
        if not symbols:
            return []
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + LAST)
        size = len(symbols)
        last, starts, known = [None] * (size + 1), [0] * (size + 1), self.known
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] is not None:
                continue
            if start := end - length:
                if (left := last[start]) is None:
                    continue
                if (fits := known[token].get(left)) is None:
                    fits = self._fits(left, token)
                if not fits:
                    continue
            last[end], starts[end] = token, start
        out, end = [], size
        while end:
            out.append(last[end])
            end = starts[end]
        return out[::-1]

    def _fits(self, left: int, token: int) -> bool:
        """compatible(), remembered for CACHE pairs at most."""
        if self.pairs >= CACHE:
            self.pairs = 0
            for some in self.known.values():
                some.clear()
        self.pairs += 1
        fits = self.known[token][left] = self.compatible(left, token)
        return fits


class Tokenizer:
    """What a tokenizer file says: special strings, NFC, lower case, a split pattern, byte symbols, BPE."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        pre = spec["pre_tokenizer"]["pretokenizers"] if "pretokenizers" in spec["pre_tokenizer"] else []
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        kinds = [p["type"] for p in pre]
        if kinds != ["Split", "ByteLevel"] or steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("this file's steps are not those that the encoder reproduces")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.names = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        lib = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = lib.normalizer, lib.pre_tokenizer
        self.split = regex.compile(pre[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = _byte_symbols()
        self.values = {s: b for b, s in enumerate(self.bytes)}
        self.chunks, self.words = _Cache(self._chunk), _Cache(self._word)

    def _word(self, word: str) -> bytes:
        return array("I", self.bpe.word(word if word.isascii() and word.isalnum() else "".join([self.bytes[b] for b in word.encode()]))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return self.words[text]
            words = self.split.findall(text)
        else:
            words = self._unusual(chunk)
        return b"".join([self.words[w] for w in words])

    def _unusual(self, chunk: str) -> list[str]:
        if max(chunk) < "\u0250":
            return self.split.findall(unicodedata.normalize("NFC", chunk).lower())
        # Which characters are letters depends on the library's Unicode version, so it is asked.
        symbols = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.values.__getitem__, s)).decode() for s, _ in symbols]

    def encode(self, text: str) -> tuple[bytes, str]:
        """A whole text's ids as little-endian unsigned 32-bit integers, and what they decode to."""
        found = []
        for part in self.cut.split(text) if any(s in text for s in self.special) else (text,):
            if part in self.special:
                found.append(self.special[part].to_bytes(4, "little"))
            else:  # white space ends every pre-token and is dropped
                found += map(self.chunks.__getitem__, (_SPACE.split(part) if _ODD_SPACE.search(part) else part.split()))
        ids = b"".join(found)
        return ids, self.decode(array("I", ids))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([n for n in map(self.names.get, ids) if n is not None])


class _Cache(dict):
    """Results of make by short texts; those not asked for in two generations are forgotten."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        if (out := self.older.get(key)) is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for every row over its whole text.

    Null and empty texts give no ids and an empty decoded text. Repeated rows are encoded each.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [tok.encode(t.as_py() or "") for t in part.column(1)]
                ends = [0]
                for ids, _ in rows:
                    ends.append(ends[-1] + len(ids) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join([r[0] for r in rows]))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([r[1] for r in rows], pa.string())], names=[id_col, "ids", "decoded"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded) of rows of ids; null ids decode to an empty text, unknown ones are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tok.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=[id_col, "decoded"])

    rows = rows.select(id_col, F.col(ids_col).cast("array<int>"))
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode()'s rows as digests, made where they arise; then the columns of docs named in also."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sha = _tokenizer(tokenizer), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1):
                ids, text = tok.encode(t.as_py() or "")
                rows.append((len(ids) // 4, sha(ids), sha(text.encode())))
            n, a, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string()), *b.columns[2:]], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *also])

    rows = docs.select(id_col, F.col(text_col).cast("string"), *also)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
