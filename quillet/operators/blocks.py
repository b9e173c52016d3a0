"""Inversion of documents by blocks: a task turns some MB of documents into rows of terms at once, in place of a row for each term of each document."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from quillet.session import lean, small_batches

#: Bytes of text that a block holds, but for the last document's; tokens of a row, but for the last document's.
BLOCK, PIECE = 8 << 20, 256
#: Bytes of a batch that goes back to Spark, roughly.
OUT = 2 << 20
#: Documents, of least hash, that tell where the ranges of a sorted table begin; rows don't depend on them.
PROBE = 1024

#: Where ranges begin: (key, first doc) in order.
Edges = list[tuple[str, int]]


def _lists(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)


def _coded(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids; terms; and of each word that isn't blank the number of its term, its row and its place."""
    table = pa.Table.from_batches(batches)
    if pa.types.is_integer(table["doc_id"].type) and (np.diff(own := table["doc_id"].to_numpy()) < 0).any():
        table = table.take(pa.array(np.argsort(own, kind="stable")))
    ids = pa.concat_arrays(table["doc_id"].chunks)
    # ASCII white space, as \s is in Spark
    lists = [pc.ascii_split_whitespace(c) for c in table["plain"].chunks]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists]).astype(np.int64)
    coded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    pos = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    blank = terms.index(pa.scalar("", terms.type)).as_py()
    if blank >= 0:
        kept = code != blank
        code, row, pos = code[kept], row[kept], pos[kept]
    return ids, terms, code, row, pos


def _pieces(code: np.ndarray, row: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """code, row in order: where postings begin, and which postings begin a row of `piece` tokens or a new term."""
    term_new = np.ones(len(code), bool)
    term_new[1:] = code[1:] != code[:-1]
    new = term_new.copy()
    new[1:] |= row[1:] != row[:-1]
    at, first = np.flatnonzero(new), np.flatnonzero(term_new)
    share = (at - first[np.cumsum(term_new)[at] - 1]) // piece
    cut = term_new[at]
    cut[1:] |= share[1:] != share[:-1]
    return at, np.flatnonzero(cut)


def invert(batches: list[pa.RecordBatch], piece: int = PIECE) -> pa.RecordBatch:
    """Of (doc_id, plain): term; docs, ascending; positions, those of one doc behind those of another; ends, where each doc's positions end; n (docs) and cf (tokens). A term of more than `piece` tokens has several rows."""
    ids, terms, code, row, pos = _coded(batches)
    order = np.argsort(code, kind="stable")
    code, row, pos = code[order], row[order], pos[order]
    at, rows = _pieces(code, row, piece)
    edges, ends = np.append(rows, len(at)), np.append(at, len(code))
    columns = {
        "term": terms.take(pa.array(code[at[rows]])),
        "docs": _lists(edges, ids.take(pa.array(row[at]))),
        "ends": _lists(edges, pa.array((ends[1:] - np.repeat(ends[rows], np.diff(edges))).astype(np.int32))),
        "positions": _lists(ends[edges], pa.array(pos)),
        "n": pa.array(np.diff(edges)),
        "cf": pa.array(np.diff(ends[edges])),
    }
    return pa.RecordBatch.from_pydict(columns)


def invert_pairs(batches: list[pa.RecordBatch], piece: int = PIECE) -> pa.RecordBatch:
    """Of (doc_id, plain): biword (two words, one behind the other but for blanks), docs (ascending, distinct)."""
    ids, terms, code, row, _ = _coded(batches)
    together = np.flatnonzero(row[1:] == row[:-1])
    key = code[together].astype(np.int64) * len(terms) + code[together + 1]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[together][order]
    at, rows = _pieces(key, row, piece)
    of = key[at[rows]]
    biword = pc.binary_join_element_wise(terms.take(pa.array(of // max(1, len(terms)))), terms.take(pa.array(of % max(1, len(terms)))), " ")
    return pa.RecordBatch.from_pydict({"biword": biword, "docs": _lists(np.append(rows, len(at)), ids.take(pa.array(row[at])))})


def _dealt(batch: pa.RecordBatch, edges: Edges) -> pa.RecordBatch:
    """With `part`, how many edges lie at or before each row's key and first doc."""
    keys, docs = batch.column(0), batch.column(1)
    order = pc.sort_indices(keys)
    own, order = keys.take(order).to_pylist(), order.to_numpy()
    first = docs.values.to_numpy()[docs.offsets.to_numpy()[:-1]][order]
    ends = np.array([bisect_right(own, key) for key, _ in edges], np.int64)
    part = np.searchsorted(ends, np.arange(len(own)), "right").astype(np.int32)
    for (key, doc), end in zip(edges, ends.tolist(), strict=True):
        start = bisect_left(own, key, 0, end)
        part[start:end] += first[start:end] >= doc
    out = np.empty(len(own), np.int32)
    out[order] = part
    return batch.append_column("part", pa.array(out))


def _by_blocks(work: Callable[[list[pa.RecordBatch]], pa.RecordBatch], most: int = BLOCK) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from _slices(work(held))
                held, size = [], 0
        if held:
            yield from _slices(work(held))

    return lean(run)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, len(batch) * OUT // max(OUT, batch.nbytes))
    for k in range(0, len(batch), step):
        yield batch.slice(k, step)


def can_block(analysed: DataFrame) -> bool:
    """Whether ids are whole numbers, which blocks keep as they are."""
    return isinstance(analysed.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType))


WORK = {"term": invert, "biword": invert_pairs}


def postings_of(blocks: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions of rows that hold them for several documents."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    each = F.transform("docs", lambda d, i: F.struct(d.alias("doc_id"), (F.get("ends", i) - before(i)).alias("tf"), before(i).alias("start")))
    out = blocks.select("term", "positions", F.explode(each).alias("p"))
    return out.select("term", "p.doc_id", "p.tf", F.slice("positions", F.col("p.start") + 1, F.col("p.tf")).alias("positions"))


def frequencies_of(blocks: DataFrame) -> DataFrame:
    """term, doc_id, tf; positions aren't read."""
    each = F.transform("docs", lambda d, i: F.struct(d.alias("doc_id"), (F.get("ends", i) - F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))).cast("long").alias("tf")))
    return blocks.select("term", F.explode(each).alias("p")).select("term", "p.doc_id", "p.tf")


def _schema(analysed: DataFrame, key: str) -> str:
    kind = analysed.schema["doc_id"].dataType.simpleString()
    return f"{key} string, docs array<{kind}>" + (", ends array<int>, positions array<int>, n bigint, cf bigint" if key == "term" else "")


def blocks_of(analysed: DataFrame, key: str = "term") -> DataFrame:
    """What invert() or, for the key `biword`, invert_pairs() gives of (doc_id, plain), block after block."""
    small_batches(analysed.sparkSession)
    return analysed.select("doc_id", "plain").mapInArrow(_by_blocks(WORK[key]), _schema(analysed, key))


def _edges(analysed: DataFrame, key: str, documents: int, partitions: int) -> Edges:
    """Where ranges of about equal bytes begin, told from the documents of least hash."""
    space = 1 << 20
    probe = analysed.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < max(1, PROBE * space // max(1, documents)))
    work = WORK[key]
    found = probe.select("doc_id", "plain").mapInArrow(_by_blocks(lambda held: work(held, 16)), _schema(analysed, key)).select(key, F.get("docs", F.lit(0)).cast("bigint").alias("first"), F.size("docs").alias("n")).toArrow()
    seen: dict[str, int] = {}
    rows = sorted(zip(*[c.to_pylist() for c in found.columns], strict=True))
    for k, _, n in rows:
        seen[k] = seen.get(k, 0) + n
    # a frequent key's postings lie many to a row, so they take less room than a rare one's
    weight = np.cumsum([n * (4 + 36 * min(1, 8 / seen[k])) for k, _, n in rows])
    if not rows:
        return []
    picks = np.searchsorted(weight, weight[-1] * np.arange(1, partitions) / partitions)
    return sorted({rows[i][:2] for i in picks.tolist()})


def sorted_blocks(analysed: DataFrame, key: str, documents: int, partitions: int) -> DataFrame:
    """blocks_of() dealt by ranges of key and first doc, and sorted by them in each; documents: how many there are.

    The ranges are known before the blocks are made, so texts are inverted once, where repartitionByRange would do it twice.
    """
    small_batches(analysed.sparkSession)
    edges, work = _edges(analysed, key, documents, partitions), WORK[key]
    dealt = analysed.select("doc_id", "plain").mapInArrow(_by_blocks(lambda held: _dealt(work(held), edges)), _schema(analysed, key) + ", part int")
    return dealt.repartitionById(len(edges) + 1, "part").sortWithinPartitions(key, F.get("docs", F.lit(0))).drop("part")


#: Bytes of a key that tell its range.
HEAD = 32


def _by_length(marked: pa.Array, terms: pa.Array) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """The terms of each length, some at a time."""
    sizes = pc.utf8_length(marked).to_numpy()
    order = np.argsort(sizes, kind="stable")
    lengths, starts = np.unique(sizes[order], return_index=True)
    for size, a, b in zip(lengths.tolist(), starts.tolist(), [*starts.tolist()[1:], len(order)], strict=True):
        step = max(1, OUT // (size * size))
        for k in range(a, b, step):
            some = pa.array(order[k : min(b, k + step)])
            yield size, marked.take(some), terms.take(some)


def rotations(terms: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Each rotation of `term$`, with the term."""
    for size, marked, own in _by_length(pc.binary_join_element_wise(terms, "$", ""), terms):
        twice = pc.binary_join_element_wise(marked, marked, "")
        yield pa.concat_arrays([pc.utf8_slice_codeunits(twice, k, k + size) for k in range(size)]), pa.concat_arrays([own] * size)


def grams(terms: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Each different window of three characters of `$term$`, with the term."""
    for size, marked, own in _by_length(pc.binary_join_element_wise("$", terms, "$", ""), terms):
        coded = pa.concat_arrays([pc.utf8_slice_codeunits(marked, k, k + 3) for k in range(size - 2)]).dictionary_encode()
        which = np.unique(np.tile(np.arange(len(own)), size - 2) * len(coded.dictionary) + coded.indices.to_numpy())
        yield coded.dictionary.take(pa.array(which % len(coded.dictionary))), own.take(pa.array(which // len(coded.dictionary)))


def _heads(keys: pa.Array, terms: pa.Array) -> np.ndarray:
    """The first bytes of key and term, in their order."""
    both = pc.binary_join_element_wise(keys, terms, "\0")
    offsets = np.frombuffer(both.buffers()[1], np.int32)[both.offset : both.offset + len(both) + 1].astype(np.int64)
    data, at = np.frombuffer(both.buffers()[2], np.uint8), offsets[:-1, None] + np.arange(HEAD)
    held = np.where(at < offsets[1:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return held.view(f"S{HEAD}").ravel()


WAYS = {"rotation": rotations, "gram": grams}


def _keyed(key: str, edges: np.ndarray | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, terms in WAYS[key](batch.column(0)) if len(batch) else ():
                columns = {key: keys, "term": terms}
                if edges is not None:
                    columns["part"] = pa.array(np.searchsorted(edges, _heads(keys, terms), "right").astype(np.int32))
                yield from _slices(pa.RecordBatch.from_pydict(columns))

    return lean(run)


def sorted_keys(terms: DataFrame, key: str, partitions: int) -> DataFrame:
    """The rotations or grams (key, term) of a stored table of different terms, dealt by ranges of both and sorted in each; ranges are told from the terms of least hash."""
    small_batches(terms.sparkSession)
    space, count = 1 << 20, terms.count()
    probe = terms.where(F.pmod(F.xxhash64("term"), F.lit(space)) < max(1, 4 * PROBE * space // max(1, count)))
    found = probe.mapInArrow(_keyed(key, None), f"{key} string, term string").toArrow()
    heads = np.sort(_heads(*[pa.concat_arrays(c.chunks) for c in found.columns])) if len(found) else np.zeros(0, f"S{HEAD}")
    edges = np.unique(heads[len(heads) * np.arange(1, partitions) // partitions]) if len(heads) else heads
    dealt = terms.mapInArrow(_keyed(key, edges), f"{key} string, term string, part int")
    return dealt.repartitionById(len(edges) + 1, "part").sortWithinPartitions(key, "term").drop("part")
