"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text: h = (h << 1) + gear[byte], of 16 bits, so that it depends on the last 16 bytes. A byte ends a chunk
where the upper MASK_BITS bits of h are zero and no byte of the APART before it is such a place; chunks are MAX_BYTES at most. Whether a place
ends a chunk depends on the 25 bytes up to it alone, so equal passages are cut alike whatever was inserted before them.

A lone chunk is too short to tell a copy from chance. What is compared is a run: from each cut, the fewest chunks that follow each other
with RUN_BYTES or more together, and the last such run of the text. Runs are known by a 128-bit digest. The first occurrence of a run (least
doc_id, then row, then place) stays; a chunk that lies in a later occurrence of any run is removed. A text shorter than RUN_BYTES is one run, which only equals whole texts.
So what is removed still stands in an earlier place, byte by byte. The ends of a repeated passage beyond its first and last cut stay.

Each task settles the repeats among a block of its runs and sends on one row for each different run of the block, so a run that a third of all
documents hold is a row for each block. One shuffle by digest then finds the first of each.

Null texts count as empty, and nothing of them is removed. A null doc_id is the least. Rows are told apart by a number of their own: of rows that repeat an id and a text one stays
whole, whichever it be. Columns with the names of added ones give way to them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from quillet.llm.bytesview import Texts, earlier, mix, slices
from quillet.session import Stored

MASK_BITS, APART, MAX_BYTES, RUN_BYTES = 4, 10, 1024, 160
#: Runs of a block.
BLOCK = 1 << 19
WINDOW = 16
GEAR = (mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
RUN = "key bigint, d2 bigint, doc bigint, row bigint, begin bigint, end bigint, gone bigint"
NAMES = [x.split()[0] for x in RUN.split(", ")]


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over 16 bytes, by doubling."""
    h = GEAR[buf]
    for k in range(4):
        width = 1 << k
        if len(h) > width:
            step = h[:-width] << np.uint16(width)
            h = h.copy()
            h[width:] += step
    return h


def edges(t: Texts, mask_bits: int = MASK_BITS, apart: int = APART, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Where chunks begin or end, over the slice: sorted, without repeats, with all ends of texts."""
    offs = t.offs.astype(np.int64)
    ends = np.flatnonzero(gear_hash(t.buf) >> np.uint16(16 - mask_bits) == 0) + 1
    doc = np.searchsorted(offs, ends, "left") - 1
    inner = (ends - offs[doc] >= WINDOW) & (ends < offs[doc + 1])  # the hash before that holds bytes of the text before
    ends, doc = ends[inner], doc[inner]
    far = np.ones(len(ends), bool)
    far[1:] = (np.diff(ends) >= apart) | (doc[1:] != doc[:-1])
    own = np.unique(np.concatenate([ends[far], offs]))
    gap = np.diff(own)
    long = np.flatnonzero(gap > max_bytes)
    if len(long):
        own = np.unique(np.concatenate([own, *(np.arange(own[k], own[k + 1], max_bytes) for k in long)]))
    return own


def runs(t: Texts, run_bytes: int = RUN_BYTES, **cutting: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs over the slice, and the number of each one's text."""
    offs, at = t.offs.astype(np.int64), edges(t, **cutting)
    doc = np.searchsorted(offs, at, "right") - 1  # of the text that begins there, if any: empty ones come before
    inside = at < offs[-1]
    begin, doc = at[inside], doc[inside]
    stop = offs[doc + 1]
    end = at[np.minimum(np.searchsorted(at, begin + run_bytes), len(at) - 1)]
    full = begin + run_bytes <= stop
    b, e, d = [begin[full]], [end[full]], [doc[full]]
    # the last run of each text, from the last cut that has run_bytes behind it; and short texts
    size = np.diff(offs)
    last = np.flatnonzero(size >= run_bytes)
    start = at[np.searchsorted(at, offs[last + 1] - run_bytes, "right") - 1]
    new = at[np.searchsorted(at, start + run_bytes)] < offs[last + 1]  # else it is the run from that cut
    b.append(start[new])
    e.append(offs[last + 1][new])
    d.append(last[new])
    short = np.flatnonzero((size > 0) & (size < run_bytes))
    b.append(offs[short])
    e.append(offs[short + 1])
    d.append(short)
    return tuple(np.concatenate(x) for x in (b, e, d))


def keyed(batches: Iterator[pa.RecordBatch], run_bytes: int, block: int, cutting: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows doc, row, text. Gives RUN, dealt by key: the first of each run in a block, and those of which an earlier one is in the block."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((6, 0), np.int64), *held], axis=1)
        held.clear()
        gone = earlier(rows)
        rows[0][gone], rows[1][gone] = mix(rows[3][gone].view(np.uint64)).view(np.int64), 0
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(gone.astype(np.int64))], names=NAMES)

    for batch in batches:
        docs, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for t in slices(batch.column(2)):
            b, e, d = runs(t, run_bytes, **cutting)
            raw = t.buf.tobytes()
            digests = [xxhash.xxh3_128_digest(raw[x:y], seed=y - x < run_bytes) for x, y in zip(b.tolist(), e.tolist(), strict=True)]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            start = t.offs[d]
            held.append(np.stack([halves[:, 0], halves[:, 1], docs[t.lo + d], ids[t.lo + d], b - start, e - start]))
            if sum(x.shape[1] for x in held) >= block:
                yield flush()
    yield flush()


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUN sorted by key. Gives row, begin and end of what goes."""
    held = np.zeros((7, 0), np.int64)

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        gone = earlier(rows[:6]) | (rows[6] > 0)
        return pa.RecordBatch.from_arrays([pa.array(rows[i][gone]) for i in (3, 4, 5)], names=["row", "begin", "end"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(7)])], axis=1)
        if not rows.shape[1]:
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = rows[:, last:]
        if last:
            yield emit(rows[:, :last])
    yield emit(held)


def dedup_chunks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run_bytes: int = RUN_BYTES, **cutting: int) -> DataFrame:
    """docs with kept_text (a binary: the bytes that stay, cuts may part a character), n_bytes, n_removed and n_spans. cutting: what edges() takes."""
    block = BLOCK
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(f"`{text}`").alias("text"))
    store = Stored(packed.withColumn("row", F.monotonically_increasing_id()), "texts")
    dealt = store.df.select("doc", "row", "text").mapInArrow(lambda b: keyed(b, run_bytes, block, cutting), RUN).repartition("key").sortWithinPartitions("key")
    gone = dealt.mapInArrow(later, "row bigint, begin bigint, end bigint").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("gone"))
    spans = Stored(gone, "spans")
    cut = cut_spans(store.df.join(spans.df, "row", "left").select("rest", "text", "gone"), "text", "gone")
    added = ["kept_text", "n_bytes", "n_removed", "n_spans"]
    return cut.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c not in added], *added)


def cut_spans(df: DataFrame, text: str, gone: str) -> DataFrame:
    """Add kept_text, n_bytes, n_removed and n_spans from sorted byte spans (begin, end); drops `gone`. Spans that touch or overlap count as one."""
    fields = [StructField("kept_text", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]
    names = [c for c in df.columns if c != gone and c not in {f.name for f in fields}]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.transform(gone, lambda x: x["begin"].cast("int")).alias("a"), F.transform(gone, lambda x: x["end"].cast("int")).alias("b"))
    schema = source.drop("a", "b").schema
    for f in fields:
        schema = schema.add(f)
    at = names.index(text)

    def run(batches):
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for x, a, b in zip(batch.column(at).to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                raw = (x or "").encode()
                out, end, lost, runs = [], 0, 0, 0
                for s, e in zip(a or [], b or [], strict=True):
                    if e <= end:
                        continue
                    if s > end or not runs:
                        runs += 1
                    s = max(s, end)
                    out.append(raw[end:s])
                    lost += e - s
                    end = e
                kept.append(b"".join([*out, raw[end:]]))
                sizes.append(len(raw))
                removed.append(lost)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in (sizes, removed, spans))], names=[f.name for f in schema])

    return source.mapInArrow(run, schema).toDF(*names, *[f.name for f in fields])


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns, from cut_spans()."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
