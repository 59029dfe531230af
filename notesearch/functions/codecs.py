"""Byte codecs that no built-in expression offers, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType


def vbyte_bytes(numbers: Iterable[int]) -> bytes:
    """Seven bits a byte, low bits first; the last byte of a number has its high bit set."""
    out = bytearray()
    for n in numbers:
        while n > 127:
            out.append(n & 127)
            n >>= 7
        out.append(n | 128)
    return bytes(out)


def vbyte_numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            out.append(n)
            n = shift = 0
    return out


def gaps(docs: Iterable[int]) -> list[int]:
    out, before = [], 0
    for d in docs:
        out.append(d - before)
        before = d
    return out


def running(numbers: Iterable[int]) -> list[int]:
    out, total = [], 0
    for n in numbers:
        total += n
        out.append(total)
    return out


def front_coded(terms: list[str]) -> bytes:
    """A block of sorted terms: the first whole, each other as shared prefix, rest length and rest, in UTF-8 bytes."""
    out, before = bytearray(), b""
    for k, term in enumerate(terms):
        raw = term.encode()
        shared = 0
        if k:
            while shared < min(len(raw), len(before), 255) and raw[shared] == before[shared]:
                shared += 1
            out += vbyte_bytes([shared])
        out += vbyte_bytes([len(raw) - shared]) + raw[shared:]
        before = raw
    return bytes(out)


def front_decoded(data: bytes) -> list[str]:
    out, at, before = [], 0, b""

    def number() -> int:
        nonlocal at
        start = at
        while not data[at] & 128:
            at += 1
        at += 1
        return vbyte_numbers(data[start:at])[0]

    while at < len(data):
        shared = number() if out else 0
        length = number()
        before = before[:shared] + data[at : at + length]
        at += length
        out.append(before.decode())
    return out


def _advance(docs: list[int], at: int, step: int, bound: int) -> int:
    """The next place to look at: along skips that do not pass bound, else one further."""
    landed = at
    while landed % step == 0 and landed + step < len(docs) and docs[landed + step] <= bound:
        landed += step
    return landed if landed > at else at + 1


def skip_comparisons(a: list[int], b: list[int]) -> int:
    """Pairs of doc numbers compared when two sorted lists meet, each with skips of the square root of its length.

    The textbook intersection with skip pointers (Manning, Raghavan, Schuetze: Introduction to Information Retrieval, 2.3).
    """
    step_a, step_b = max(1, int(len(a) ** 0.5)), max(1, int(len(b) ** 0.5))
    i = j = compared = 0
    while i < len(a) and j < len(b):
        compared += 1
        left, right = a[i], b[j]
        if left <= right:
            i = i + 1 if left == right else _advance(a, i, step_a, right)
        if right <= left:
            j = j + 1 if left == right else _advance(b, j, step_b, left)
    return compared


def _run(at: int, end: int, last: int, step: int) -> int:
    """Comparisons from place at to place end of a list, where skips may land on places up to last."""
    first = -(-at // step) * step
    if first >= end:
        return end - at
    landed = first + (last - first) // step * step
    return first - at + (landed > first) + end - landed


def skip_comparisons_at(places: list[int], length: int) -> int:
    """skip_comparisons of a list and one of some length, from the places of its documents in that one.

    A place is twice the number of smaller documents there, and one more if the document is there too.
    """
    step_a, step_b = max(1, int(len(places) ** 0.5)), max(1, int(length**0.5))
    i = j = compared = 0
    while i < len(places) and j < length:
        place = places[i]
        if place >> 1 > j:
            compared += _run(j, place >> 1, (place >> 1) - 1 + (place & 1), step_b)
            j = place >> 1
        elif place == 2 * j + 1:
            compared, i, j = compared + 1, i + 1, j + 1
        else:
            end = i + 1
            while end < len(places) and places[end] <= 2 * j:
                end += 1
            compared += _run(i, end, end if end < len(places) and places[end] == 2 * j + 1 else end - 1, step_a)
            i = end
    return compared


@F.pandas_udf(BinaryType())
def pack_gaps(docs: pd.Series) -> pd.Series:
    return docs.map(lambda x: vbyte_bytes(gaps(map(int, x))))


@F.pandas_udf(ArrayType(LongType()))
def unpack_gaps(data: pd.Series) -> pd.Series:
    return data.map(lambda x: running(vbyte_numbers(x)))


@F.pandas_udf(BinaryType())
def pack_numbers(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: vbyte_bytes(map(int, x)))


@F.pandas_udf(ArrayType(LongType()))
def unpack_numbers(data: pd.Series) -> pd.Series:
    return data.map(vbyte_numbers)


@F.pandas_udf(BinaryType())
def pack_terms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda x: front_coded(list(x)))


@F.pandas_udf(ArrayType(StringType()))
def unpack_terms(data: pd.Series) -> pd.Series:
    return data.map(front_decoded)


@F.pandas_udf(LongType())
def skip_cost(places: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([skip_comparisons_at(x.tolist(), n) for x, n in zip(places, length)], dtype="int64")
