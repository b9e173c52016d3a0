"""An order of tokens by rarity that every task shares.

Tokens (64-bit hashes) fall into 2**BITS buckets by their upper bits. All buckets share the rare tokens about evenly, so the median bucket shows what these amount to; by how much a bucket exceeds the
median and its chance variation is taken for the count of a frequent token, and gives the bucket's class (in quarters of a doubling, from MIN_COUNT on); others have class 0. So the
frequent tokens stand out however large the corpus is. A key holds the class in its upper 8 bits and the upper 56 bits of the hash below, so that sorting keys puts rare tokens first. Set
joins stay exact under any shared order; the counts only decide how short the inverted lists of a prefix are, so it does no harm that a rare token may
share a frequent one's bucket.

Counts cover all tokens of all documents, and none is left out: each task adds up its tokens in an array of 2**BITS counts and sends it in PARTS pieces, a few megabytes a task; the pieces are added up,
piece by piece. The driver gets eight bytes for each bucket, and every task one, whatever the number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.bytesview import U, Texts, slices
from quillet.session import lean

BITS, PARTS = 20, 256
#: Tokens that are counted at once; the least count that has a class.
BLOCK, MIN_COUNT = 1_000_000, 64


class Rarity:
    """Keys of tokens, from the buckets' classes (one byte each). total: how many tokens were counted."""

    def __init__(self, classes: np.ndarray, total: int = 0):
        self.classes, self.total = classes, total

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> U(8) | self.classes[h >> U(64 - BITS)].astype(U) << U(56)


class Counter:
    """Counts a task's tokens by bucket."""

    def __init__(self):
        self.parts, self.size, self.counts = [], 0, np.zeros(1 << BITS, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.parts.append((tokens >> U(64 - BITS)).astype(np.int32))
        self.size += len(tokens)
        if self.size >= BLOCK:
            self._settle()

    def _settle(self) -> None:
        if self.parts:
            self.counts += np.bincount(np.concatenate(self.parts), minlength=1 << BITS)
        self.parts, self.size = [], 0

    def pieces(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the pieces that hold a count, and the pieces as 32-bit numbers (a task has fewer tokens)."""
        self._settle()
        own = np.minimum(self.counts, (1 << 32) - 1).astype("<u4").reshape(PARTS, -1)
        some = np.flatnonzero(own.any(1))
        return some, [own[k].tobytes() for k in some.tolist()]


def class_of(times: np.ndarray | float) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(times, 1)) * 4).astype(np.int64), 1, 126)


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, counts: all pieces of some parts. Gives each part's sums."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
            found[part] = found[part] + own if part in found else own
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "counts"])


def top(pieces: DataFrame, min_count: int = MIN_COUNT) -> Rarity:
    """The order of the tokens from all tasks' pieces (part, counts): 8 MB come to the driver."""
    counts = np.zeros((PARTS, (1 << BITS) // PARTS), np.int64)
    for part, own in zip(*pieces.repartition("part").mapInArrow(lean(sums), "part bigint, counts binary").toArrow().to_pydict().values(), strict=True):
        counts[part] = np.frombuffer(own, np.int64)
    return Rarity(ranks(counts.ravel(), min_count), int(counts.sum()))


def ranks(counts: np.ndarray, min_count: int) -> np.ndarray:
    """The buckets' classes."""
    usual = float(np.median(counts))
    above = counts - usual - 4 * usual**0.5
    return np.where(above >= min_count, class_of(above), 0).astype(np.uint8)


def frequent(docs: DataFrame, text: str, tokens: Callable[[Texts], np.ndarray]) -> Rarity:
    """tokens: the hashes of a slice's tokens, each counted once for each set it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for t in slices(batch.column(0)):
                counter.add(tokens(t))
        numbers, counts = counter.pieces()
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts, pa.binary())], names=["part", "counts"])

    return top(docs.select(text).mapInArrow(lean(run), "part bigint, counts binary"))


def sort_within(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order that sorts values within the groups; group is not decreasing."""
    first = np.argsort(values, kind="stable")
    own = group[first]
    small = own.astype(np.uint16) if len(group) and int(group[-1]) < 65_536 else own
    return first[np.argsort(small, kind="stable")]


def shared_keys(batches: Iterator[pa.RecordBatch], frequent_too: bool = False) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key (the first column), those of keys with two rows or more; and all of frequent keys if frequent_too."""
    pending, last = None, None  # a row that may yet be alone, and the key before
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same, keep = key[1:] == key[:-1], np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if frequent_too:
            keep |= key >> 56 > 0
        if last is not None and key[0] == last:
            keep[0] = True
            if pending is not None:
                yield pending
        pending, last = None if keep[-1] else batch.slice(len(key) - 1), key[-1]
        yield batch.filter(pa.array(keep))
