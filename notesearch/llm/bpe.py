"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A token sequence is the byte-pair encoding of its text exactly when every two neighbours are
compatible: encoding their joined text gives the two back.  Hence every prefix of a word has one
possible last token.  An automaton lists the vocabulary tokens that end at each position, a
compatibility test picks the one that may follow the last token of the prefix before it, and
back-pointers from the end give the ids.  Time is linear in the word, whatever its length.

Defined results.  Null and empty texts have no tokens.  Strings of added tokens inside a text become
those tokens, as the tokenizers library does by default.  Equal rows give equal results; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, ready_workers

#: Words with characters beyond these follow the library's own Unicode tables, which may be of another version.
PLAIN = re.compile("[\\u0250-\U0010ffff]")
#: Moves a character to its form at the end of a word.
LAST = 0x1000
#: Words remembered by each Python worker, in each of two generations, and their most bytes.
MEMO_WORDS = 100_000
MEMO_BYTES = 64
#: Answers of the compatibility test that are remembered.
MOST_PAIRS = 300_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(moved.get(b, b)) for b in range(256)]


class Memo(dict):
    """Remembers make(key) for the keys used lately; holds two generations of `most` keys."""

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_BYTES:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        """Gives the memory back; called when a task ends, as workers live on beside other operators."""
        self.old = {}
        self.clear()


class Vocabulary:
    """A byte-level BPE vocabulary with word ends: its tokens, merges and text rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names.update({i: t for t, i in self.added.items()})
        if any(re.search(r"\s", t) for t in self.added):
            raise ValueError("added tokens that hold white space are not supported")
        self._split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"]).findall
        self._path, self._rules = path, None
        self._of_byte = byte_characters()
        self._byte_of = {c: b for b, c in enumerate(self._of_byte)}
        self.symbols: dict[int, str] = {i: self._symbols_of(t) for t, i in self.vocab.items()}
        self.rank = dict.fromkeys(self.symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merged[a, b] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        missing = [c for c in self._of_byte if c not in self.vocab or c + self.suffix not in self.vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} byte symbols")
        self._compatible: dict[int, bool] = {}

    def _symbols_of(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + LAST) if body else ""
        return token

    def symbols_in(self, piece: str) -> str:
        """The piece as symbols, the last one in its word-end form."""
        text = piece if piece.isalpha() and piece.isascii() else "".join([self._of_byte[b] for b in piece.encode()])
        return text[:-1] + chr(ord(text[-1]) + LAST) if self.suffix else text

    def segments(self, word: str):
        """Yields (added token id, None) and (None, piece) in order; word holds no ASCII white space."""
        parts = self._split_added.split(word) if self._split_added and "<" in word else (word,)
        for part in parts:
            if part in self.added:
                yield self.added[part], None
            elif part:
                for piece in self._split(part):
                    yield None, piece

    def _split(self, part: str) -> list[str]:
        """The pieces that are encoded on their own."""
        if part.isascii():
            return self._pieces(part.lower())
        if not PLAIN.search(part):
            return self._pieces(unicodedata.normalize("NFC", part).lower())
        if self._rules is None:  # most vocabularies of text need it nowhere
            self._rules = Tokenizer.from_file(self._path)
        mapped = self._rules.pre_tokenizer.pre_tokenize_str(self._rules.normalizer.normalize_str(part))
        return [bytes([self._byte_of[c] for c in piece]).decode() for piece, _ in mapped]

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right, next to each other, are what encoding their text gives.

        Takes the two apart in the reverse order of their merges; a merge across the border that
        comes before the one just taken apart would have destroyed it.
        """
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        bound, answer = None, True
        while True:
            crossing = merged.get((left, right))
            if crossing is not None and (bound is None or crossing < bound):
                answer = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                break
            if a > b:  # left was the later merge; at equal ranks the left one is made first
                bound, left = a, parts[left][1]
            else:
                bound, right = b + 1, parts[right][0]
        if len(self._compatible) > MOST_PAIRS:
            self._compatible.clear()
        self._compatible[key] = answer
        return answer


class Encoder:
    """Encodes words by the dynamic programme; decodes as the library does without a decoder."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.matches = ahocorasick.Automaton()
        for token, symbols in vocabulary.symbols.items():
            if symbols:
                self.matches.add_word(symbols, (token, -len(symbols)))
        self.matches.make_automaton()
        size = max(vocabulary.names) + 1
        self.type, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.names = [vocabulary.names.get(i) for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.pieces, self.memo = Memo(self._piece), Memo(self._word)

    def _pack(self, n: int, ids: list[int]) -> bytes:
        return struct.pack(f"={n}{self.code}", *ids)

    def piece(self, piece: str) -> list[int]:
        symbols = self.vocabulary.symbols_in(piece)
        size = len(symbols)
        last, start = [-1] * (size + 1), [0] * (size + 1)
        known, compatible = self.vocabulary._compatible, self.vocabulary.compatible
        for end, (token, begin) in self.matches.iter(symbols):
            end += 1
            if last[end] < 0:
                begin += end
                if begin:
                    before = last[begin]
                    fits = known.get(before << 32 | token)
                    if fits or (fits is None and compatible(before, token)):
                        last[end], start[end] = token, begin
                else:
                    last[end] = token
        ids, at = [], size
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def _word(self, word: bytes) -> bytes:
        """The ids of a word, packed."""
        if word.isalpha():  # ASCII letters only: one piece
            return self.pieces[word.lower().decode()]
        found = [self._pack(1, [added]) if piece is None else self.pieces[piece] for added, piece in self.vocabulary.segments(word.decode())]
        return found[0] if len(found) == 1 else b"".join(found)

    def _piece(self, piece: str) -> bytes:
        ids = self.piece(piece)
        return self._pack(len(ids), ids)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, (text or "").encode().split())), self.type).tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def in_decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each task and vocabulary; path must exist on every executor."""
    return Encoder(Vocabulary(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array, only with_ids), n_tokens, ids_sha256, decoded_sha256."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        used = encoder(path)
        for batch in batches:
            ids, n, of_ids, of_text = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = used.encode(text)
                n.append(len(found))
                of_ids.append(hashlib.sha256(used.in_decimal(found).encode()).hexdigest())
                of_text.append(hashlib.sha256(used.decode(found).encode()).hexdigest())
                if with_ids:
                    ids.append(np.array(found, np.int32))
            columns = {"doc_id": batch.column(0), **({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})}
            yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_text})
        used.memo.forget()
        used.pieces.forget()
        del used
        encoder.cache_clear()
        give_back()  # an encoder and its memories refer to each other

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the text of ids_col, special tokens kept; null ids give null."""

    @F.pandas_udf("string")
    def run(ids):
        text_of = encoder(path).decode
        return ids.map(lambda x: None if x is None else text_of(list(x)))

    return rows.withColumn(out_col, run(F.col(ids_col)))
