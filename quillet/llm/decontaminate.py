"""Benchmark decontamination by a broadcast set of normalised n-grams.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z. A window is `n` consecutive words of an item; an item of
fewer words, but not none, is one window. Texts are scanned by window hashes against the set; what hits is verified word by word.

Items are cut into pieces of PIECE words that overlap by n - 1, and pieces are dealt into blocks of some `block_bytes`; a block's windows are sorted arrays (some 40 bytes a
window, windows that several items share stand once) that are broadcast; the texts are scanned once for each block. So memory is bounded whatever the number and the sizes of the items.

Null texts and items have no words; empty ones neither. Items with equal texts all count; rows that repeat an item_id count as one item. An item with a null item_id is searched for like
others; all such rows are one item, null among the item_ids (it counts in n_items; the digest of the names leaves it out). Rows of docs that repeat are rows of their own; texts of any length are taken whole, and texts without a hit are
returned unchanged. Columns with the names of added ones give way to them. An empty table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from quillet.llm.bytesview import IS_ALNUM, U, Texts, bounds, slices, windows, words
from quillet.llm.chunks import cut_spans
from quillet.session import Stored, checkpoint, lean

BLOCK_BYTES = 8 << 20
PIECE = 4096
#: Bits of the sieve before the search: so many for each window, up to a 16 MB table.
SIEVE, SIEVE_BITS = 16, 24


def pieces(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """item, text. Gives item, words (in lower case, joined by a space) and count, for each piece."""
    for batch in batches:
        rows: list[tuple[int | None, bytes, int]] = []
        for t in slices(batch.column(1)):
            starts, ends, _, doc = words(t, IS_ALNUM)
            edges, low = bounds(doc, t.n), t.buf.tobytes().lower()
            own = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for i in range(t.n):
                a, b = int(edges[i]), int(edges[i + 1])
                while b > a:
                    rows.append((batch.column(0)[t.lo + i].as_py(), b" ".join(own[a : min(b, a + PIECE)]), min(b - a, PIECE)))
                    if b - a <= PIECE:
                        break
                    a += PIECE - n + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item", "words", "count"])


class Grams:
    """The windows of some pieces. For each length, sorted by hash: the hash, where the window's words lie in `text`, and the items it is of."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]], n: int):
        self.text = b"".join(r[1] for r in rows)
        offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts = pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())
        for t in slices(texts):
            starts, ends, hashes, doc = words(t, IS_ALNUM)
            lengths = np.minimum(n, np.diff(bounds(doc, t.n)))
            for length in np.unique(lengths[lengths > 0]).tolist():
                h = windows(hashes, length)[: len(hashes) - length + 1]
                own = np.flatnonzero((doc[: len(h)] == doc[length - 1 :]) & (lengths[doc[: len(h)]] == length))
                at = int(offsets[t.lo])
                found.setdefault(length, []).append((h[own], at + starts[own], at + ends[own + length - 1], t.lo + doc[own]))
        self.by_length = {k: self.merged([np.concatenate(x) for x in zip(*v, strict=True)], [r[0] for r in rows]) for k, v in found.items()}

    def merged(self, cols: list[np.ndarray], ids: list[int | None]) -> tuple[np.ndarray, ...]:
        """Windows of equal words once: hashes, begins, ends, and the edges of their items in the last two arrays (ids, and which of them are none)."""
        order = np.argsort(cols[0], kind="stable")
        h, begin, end, piece = (c[order] for c in cols)
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        first = np.zeros(len(h), bool)
        first[edge] = True
        place = np.arange(len(h))
        for a in edge[np.diff(np.concatenate([edge, [len(h)]])) > 1].tolist():
            kinds: dict[bytes, list[int]] = {}
            b = a
            while b < len(h) and h[b] == h[a]:
                kinds.setdefault(self.text[begin[b] : end[b]], []).append(b)
                b += 1
            place[a:b] = [k for own in kinds.values() for k in own]
            if len(kinds) > 1:  # different words with one hash
                first[a + np.cumsum([len(own) for own in kinds.values()])[:-1]] = True
        piece = piece[place]
        own = np.flatnonzero(first)
        item = np.array([x or 0 for x in ids], np.int64)[piece]
        return h[own], begin[place][own], end[place][own], np.concatenate([own, [len(h)]]), item, np.array([x is None for x in ids], bool)[piece]

    def sieves(self) -> dict[int, tuple[int, np.ndarray]]:
        out = {}
        for length, (h, *_) in self.by_length.items():
            bits = min(SIEVE_BITS, max(10, int(len(h) * SIEVE).bit_length()))
            out[length] = (bits, np.zeros(1 << bits, bool))
            out[length][1][h >> U(64 - bits)] = True
        return out


def scan(t: Texts, grams: Grams, sieves: dict[int, tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[set[int | None]], np.ndarray, np.ndarray]:
    """Edges of each text's words, which words are hit, item ids of each text, and the words' starts and ends."""
    starts, ends, hashes, doc = words(t, IS_ALNUM)
    marks, items = np.zeros(len(hashes) + 1, np.int32), [set() for _ in range(t.n)]
    low = b""
    for length, (known, begins, stops, edges, ids, none) in grams.by_length.items():
        if len(hashes) < length:
            continue
        h = windows(hashes, length)[: len(hashes) - length + 1]
        bits, sieve = sieves[length]
        at = np.flatnonzero(sieve[h >> U(64 - bits)] & (doc[: len(h)] == doc[length - 1 :]))
        left, right = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
        for k, a, b in zip(at[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist(), strict=True):
            low = low or t.buf.tobytes().lower()
            own = b" ".join(low[x:y] for x, y in zip(starts[k : k + length].tolist(), ends[k : k + length].tolist(), strict=True))
            for g in range(a, b):
                if grams.text[begins[g] : stops[g]] == own:
                    span = slice(edges[g], edges[g + 1])
                    items[doc[k]].update(ids[span][~none[span]].tolist(), [None] if none[span].any() else [])
                    marks[k] += 1
                    marks[k + length] -= 1
    return bounds(doc, t.n), np.cumsum(marks[:-1]) > 0, items, starts, ends


FIELDS = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(LongType())), StructField("hit_begins", ArrayType(LongType())), StructField("hit_ends", ArrayType(LongType()))]
NAMES = [f.name for f in FIELDS]


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit (words inside any occurrence of a window), item_ids (sorted), and hit_begins and hit_ends, the byte spans
    of the maximal runs of hit words."""
    kept = [c for c in docs.columns if c not in NAMES]
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    cut = checkpoint(items.mapInArrow(lean(lambda b: pieces(b, n)), "item bigint, words binary, count bigint"))
    total = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    before = None
    for block in range(count):
        part = cut if count == 1 else cut.where(F.pmod(F.xxhash64("words"), F.lit(count)) == block)
        grams = Grams([(r.item, bytes(r.words), r["count"]) for r in part.toLocalIterator()], n)
        marked = _scanned(marked, grams, len(kept), block > 0)
        if block < count - 1:
            stored = Stored(marked, "marked")
            if before:
                before.drop()
            marked, before = stored.df, stored
    return marked.drop("text").toDF(*kept, *NAMES)


def _scanned(docs: DataFrame, grams: Grams, columns: int, again: bool) -> DataFrame:
    """docs: some columns, text, and the FIELDS if again. The hits of an earlier block stay."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)
    schema = docs.select(*docs.columns[: columns + 1]).schema
    for f in FIELDS:
        schema = schema.add(f)
    opened: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(columns)):
                part = batch.slice(t.lo, t.n)
                old = part.select(NAMES[2:]).to_pydict() if again else None
                yield pa.RecordBatch.from_arrays([*part.columns[: columns + 1], *marks(t, old)], names=schema.names)

    def marks(t: Texts, old: dict[str, list] | None) -> list[pa.Array]:
        if not opened:
            opened.append((shared.value, shared.value.sieves()))
        edges, hit, items, starts, ends = scan(t, *opened[0])
        begins, stops = [], []
        for i, (a, b, o) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), t.offs.tolist(), strict=False)):
            if old and old["item_ids"][i] is not None:
                items[i].update(old["item_ids"][i])
                for x, y in zip(old["hit_begins"][i], old["hit_ends"][i], strict=True):
                    hit[a + np.searchsorted(starts[a:b], o + x) : a + np.searchsorted(starts[a:b], o + y)] = True
            own = hit[a:b]
            step = np.diff(np.concatenate([[0], own.view(np.int8), [0]])) if own.any() else np.zeros(1, np.int8)
            begins.append((starts[a:b][step[:-1] == 1] - o).tolist() if len(step) > 1 else [])
            stops.append((ends[a:b][step[1:] == -1] - o).tolist() if len(step) > 1 else [])
        total = np.concatenate([[0], np.cumsum(hit)])
        spans = pa.list_(pa.int64())
        return [pa.array(np.diff(edges), pa.int64()), pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64()), pa.array([sorted(x, key=lambda i: (i is not None, i or 0)) for x in items], spans), pa.array(begins, spans), pa.array(stops, spans)]

    return docs.mapInArrow(lean(run), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """The documents without a hit, with the columns of docs."""
    marked = mark_benchmark(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("scanned")), benchmark, "scanned", n)
    return marked.where("n_hit = 0").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """All documents; the bytes of each hit run are cut out of the text."""
    marked = mark_benchmark(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("scanned")), benchmark, "scanned", n)
    cut = cut_spans(marked.select("row", "scanned", F.arrays_zip(F.col("hit_begins").alias("begin"), F.col("hit_ends").alias("end")).alias("gone")), "scanned", "gone")
    return cut.select(*[F.when(F.col("n_spans") > 0, F.col("kept_text").cast("string")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(marked: DataFrame) -> DataFrame:
    """The contract's columns, from mark_benchmark()."""
    names = F.array_sort(F.col("item_ids").cast("array<string>"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
