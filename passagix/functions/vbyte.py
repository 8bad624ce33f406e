"""Variable-byte codes: seven bits a byte, low ones first, the top bit set on all but the last."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(n: int) -> bytes:
    if n < 0:
        raise ValueError("negative numbers have no code")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number that begins at a place, and the place after it."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def encode_sorted(numbers: Iterable[int]) -> bytes:
    """Codes of the gaps of an ascending list, the first from 0."""
    last, out = 0, bytearray()
    for n in numbers:
        out += encode(n - last)
        last = n
    return bytes(out)


def decode_sorted(data: bytes) -> list[int]:
    out, at, last = [], 0, 0
    while at < len(data):
        gap, at = decode(data, at)
        last += gap
        out.append(last)
    return out


def size(n: str | Column) -> Column:
    """Bytes of the code of a non-negative long."""
    c = F.col(n) if isinstance(n, str) else n
    return F.lit(1) + sum((c >= 1 << k).cast("int") for k in range(7, 63, 7))


def encode_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of many numbers as bytes, and the bytes that each takes."""
    if len(gaps) and gaps.min() < 0:
        raise ValueError("negative numbers have no code")
    n = np.ones(len(gaps), np.int64)
    for k in range(7, 63, 7):
        n += gaps >= 1 << k
    out, start = np.empty(n.sum(), np.uint8), np.cumsum(n) - n
    for i in range(n.max(initial=0)):
        has = n > i
        out[start[has] + i] = (gaps[has] >> (7 * i) & 127) | np.where(n[has] > i + 1, 128, 0)
    return out, n


def decode_gaps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of many codes, and the place after each."""
    end = np.flatnonzero(data < 128) + 1
    if not len(end):
        return np.empty(0, np.int64), end
    start = np.r_[0, end[:-1]]
    shift = 7 * (np.arange(end[-1]) - np.repeat(start, end - start))
    return np.add.reduceat((data[: end[-1]] & 127).astype(np.int64) << shift, start), end


@F.pandas_udf(T.BinaryType())
def encode_column(lists: pd.Series) -> pd.Series:
    """encode_sorted of an array column, by Arrow batches."""
    return lists.map(lambda x: None if x is None else encode_sorted(x))


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_column(codes: pd.Series) -> pd.Series:
    return codes.map(lambda x: None if x is None else decode_sorted(x))
