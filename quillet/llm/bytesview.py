"""Whole texts as numpy byte arrays, in slices of a bounded size, and hashes of their words.

A slice holds whole texts only; a text longer than the slice size makes a slice of its own. All hashes are fixed functions of
the bytes, alike in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from quillet.session import lean

SLICE_BYTES = 1 << 17  # what numpy makes of it stays in a core's cache
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random odd multiplier for each byte value.
TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


class Texts:
    """Bytes of the texts lo..hi of a batch; text i is buf[offs[i]:offs[i + 1]]."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.buf, self.offs = lo, hi, buf, offs
        self.n = hi - lo


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Texts(lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses an offset."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # where membership changes, runs begin and end in turn
    at = np.flatnonzero(member[1:] != member[:-1]) + 1
    at = np.concatenate([[0] * int(member[0]), at, [len(member)] * int(member[-1])]).astype(np.int64)
    starts, ends = at[::2], at[1::2]
    inner = offs[(offs > 0) & (offs < len(member))]
    cut = np.unique(inner[member[inner] & member[inner - 1]])
    if len(cut):
        k = np.searchsorted(starts, cut)
        starts, ends = np.insert(starts, k, cut), np.insert(ends, k - 1, cut)
    return starts, ends


#: Bytes that end a word: the space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~IS_SPACE


def filled(buf: np.ndarray) -> np.ndarray:
    """NOT_SPACE of each byte."""
    return (buf != 0x20) & (buf - np.uint8(0x09) > 0x04)


#: Digits, a-z (after lower-casing) and all bytes of characters beyond ASCII.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(buf) + 1)
    total, each = np.zeros(len(buf) + 1, U), np.take(table, buf)
    np.cumsum(np.multiply(each, up[: len(buf)], out=each), out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U))


LOWER_TABLE = TABLE[LOWER]


def words(t: Texts, member: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and text numbers of the words of a slice; A-Z count as a-z."""
    starts, ends = runs(np.take(member[LOWER] if lower else member, t.buf), t.offs)
    hashes = hash_ranges(t.buf, starts, ends, LOWER_TABLE if lower else TABLE)
    return starts, ends, hashes, np.searchsorted(t.offs, starts, "right") - 1


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive words; the last length-1 places hold windows that run over the end."""
    n = len(hashes)
    h = np.zeros(n, U)
    for j in range(length):
        h *= BASE
        h[: n - j] += hashes[j:] if j else hashes
    return mix(h + U(length))


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each text's words begin, with the end: text i has the words bounds[i]..bounds[i + 1]."""
    return np.searchsorted(doc, np.arange(n + 1))


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and edges."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def earlier(rows: np.ndarray) -> np.ndarray:
    """rows: a digest in two columns, then columns by which equal ones are ordered. Which rows have an equal digest before them."""
    order = np.argsort(rows[0], kind="stable")
    key = rows[0][order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    some = order[same]
    some = some[np.lexsort(rows[::-1, some])]
    found = np.zeros(len(key), bool)
    a, b = some[:-1], some[1:]
    found[b] = (rows[0][a] == rows[0][b]) & (rows[1][a] == rows[1][b])
    return found


def map_texts(df: DataFrame, text: str, added: list[StructField], work: Callable[[Texts], list[pa.Array]], keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Keep the columns of df (or `keep`) and add those that `work` computes for each slice of texts.

    A column of df that has the name of an added one gives way to it.
    """
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(kept)], df[text].alias("text"))
    schema = StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(len(kept)), limit):
                part = batch.slice(t.lo, t.n)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *work(t)], names=[f"c{i}" for i in range(len(kept))] + [f.name for f in added])

    return source.mapInArrow(lean(run), schema).toDF(*kept, *[f.name for f in added])
