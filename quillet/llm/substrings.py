"""Suffix-array dedup: bytes covered by strings of `length` bytes that start at two places or more, by deep-shallow sorting.

Every string of `length` bytes (a window) has a key: the least hash among its GRAM-byte substrings. Equal windows have equal keys, so
windows are sorted key by key, where a key occurs at two places or more.

1. Each text gives the keys of its windows; keys are counted, pre-aggregated.
2. Texts that hold repeated keys give pieces: maximal runs of windows with one repeated key (cut after PIECE windows). Equal pieces are counted
   by a 128-bit digest, so copies by the thousand are one row. All windows of a piece that occurs twice are repeated.
3. The remaining windows of a key are suffixes cut off at `length` bytes. A multikey quicksort over 8-byte words orders them to a shallow
   depth, all groups at once; blind tries order each group that agrees to that depth. Equal neighbours are repeats.
4. A key with over HOT different pieces (a short common passage in ever new contexts) would be too much for one task: its windows are counted
   by 128-bit digests over all tasks instead.
5. Repeated windows become byte spans of each text.

Null texts count as empty. No match crosses texts; overlapping repeats within a text count. Rows that repeat an id or a text are rows of their
own, so equal rows repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from quillet.llm.bytesview import BASE, TABLE, U, Texts, lists, map_texts, mix, slices
from quillet.llm.chunks import cut_spans
from quillet.session import Stored, checkpoint

LENGTH, GRAM = 200, 32
PIECE, HOT, SHALLOW = 512, 4096, 32
#: Windows that a task sorts at once.
AT_ONCE = 400_000


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each byte on, for a power of two."""
    h, factor, width = TABLE[buf], int(BASE), 1
    while width < gram:
        new = h[:-width] * U(factor)
        new += h[width:]
        h, factor, width = new, factor * factor % (1 << 64), 2 * width
    return mix(h)


def slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each `width` consecutive values."""
    f, span, own = (np.minimum if least else np.maximum), 1, values
    while 2 * span <= width:
        own = f(own[:-span], own[span:])
        span *= 2
    return f(own[: len(values) - width + 1], own[width - span :]) if width > span else own


def window_keys(t: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of the window from each byte on, whether it lies within one text, and the gram hashes."""
    if len(t.buf) < length:
        return np.zeros(0, U), np.zeros(0, bool), np.zeros(0, U)
    grams = gram_hashes(t.buf, gram)
    keys = slide(grams, length - gram + 1, True)
    whole = np.zeros(len(keys) + length, np.int32)
    sizes = np.diff(t.offs)
    fits = sizes >= length
    np.add.at(whole, t.offs[:-1][fits], 1)
    np.add.at(whole, t.offs[1:][fits] - length + 1, -1)
    return keys, np.cumsum(whole)[: len(keys)] > 0, grams


def anchor_counts(t: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and number of places (two at most) of the keys of each text."""
    keys, whole, grams = window_keys(t, length, gram)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    width = length - gram + 1
    padded = np.concatenate([np.zeros(width - 1, U), np.where(whole, keys, U(0)), np.zeros(width - 1, U)])
    at = np.flatnonzero(slide(padded, width, False) == grams)
    doc, key = np.searchsorted(t.offs, at, "right") - 1, grams[at]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], key[new], np.minimum(np.diff(np.concatenate([new, [len(key)]])), 2)


def with_keys(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def work(t: Texts) -> list[pa.Array]:
        doc, key, places = anchor_counts(t, length, gram)
        edges = np.searchsorted(doc, np.arange(t.n + 1))
        return [lists(key.view(np.int64), edges, pa.int64()), lists(places, edges, pa.int32())]

    return map_texts(rows, "text", [StructField("keys", ArrayType(LongType())), StructField("places", ArrayType(IntegerType()))], work, ["id"])


def pieces(keys: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the runs of wanted windows with one key."""
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.concatenate([[True], (keys[1:] != keys[:-1]) | (wanted[1:] != wanted[:-1])])
    first = np.flatnonzero(change)
    size = np.diff(np.concatenate([first, [len(keys)]]))
    first, size = first[wanted[first]], size[wanted[first]]
    parts = -(-size // PIECE)
    at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + at * PIECE
    return start, np.minimum(start + PIECE, np.repeat(first + size, parts)) + length - 1


PIECES = [StructField(x, ArrayType(LongType())) for x in ("m", "a", "b", "d1", "d2")]


def with_pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows: id, text and repeated (keys). Adds the pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                keys, whole, _ = window_keys(t, length, gram)
                raw = t.buf.tobytes()
                own = batch.column(2).slice(t.lo, t.n)
                edges, cols = [0], [[] for _ in PIECES]
                for i in range(t.n):
                    o, stop = int(t.offs[i]), int(t.offs[i + 1]) - length + 1
                    if stop > o and own[i].is_valid:
                        part = keys[o:stop]
                        a, b = pieces(part, np.isin(part, own[i].values.to_numpy().view(U)), length)
                        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[o + x : o + y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64).reshape(-1, 2)
                        for col, x in zip(cols, (part[a].view(np.int64), a, b, digests[:, 0], digests[:, 1]), strict=True):
                            col.append(x)
                        edges.append(edges[-1] + len(a))
                    else:
                        edges.append(edges[-1])
                flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in cols]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), batch.column(1).slice(t.lo, t.n), *(lists(x, np.array(edges), pa.int64()) for x in flat)], names=["id", "text", *[f.name for f in PIECES]])

    schema = rows.select("id", "text").schema
    for f in PIECES:
        schema = schema.add(f)
    return rows.select("id", "text", "repeated").mapInArrow(run, schema)


class BlindTrie:
    """A trie that keeps only where its strings part. `insert` finds a leaf by those bytes alone, compares once, and puts the string in."""

    def __init__(self, buf: bytes, length: int):
        self.buf, self.length, self.root = buf, length, None

    def insert(self, start: int) -> None:
        buf = self.buf
        if self.root is None:
            self.root = [start]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(buf[start + depth]) or next(iter(children.values()))
        near = node[0]
        if buf[start : start + self.length] == buf[near : near + self.length]:
            node.append(start)
            return
        low, high = 0, self.length
        while high - low > 1:  # the common prefix is low bytes or more and less than high
            mid = (low + high) // 2
            if buf[start : start + mid] == buf[near : near + mid]:
                low = mid
            else:
                high = mid
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < low:
            above, node = node, node[1][buf[start + node[0]]]
        if isinstance(node, tuple) and node[0] == low:
            node[1][buf[start + low]] = [start]
            return
        split = (low, {buf[near + low]: node, buf[start + low]: [start]})
        if above is None:
            self.root = split
        else:
            above[1][buf[start + above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """The equal strings, in order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            elif node:
                yield node


def deep_shallow(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings buf[s:s + length] within their groups; the order, and a number that equal strings of a group share.

    buf needs 8 bytes more behind the last string.
    """
    word = buf.astype(U)
    for width in (1, 2, 4):  # the 8 bytes from each byte on, as one number
        word = (word[:-width] << U(8 * width)) | word[width:]
    order = np.argsort(group, kind="stable")
    depth = np.zeros(len(order), np.int16)
    own = group[order]
    active = np.arange(len(order))
    while len(active):
        edge = np.concatenate([[True], own[active][1:] != own[active][:-1]])
        first = np.flatnonzero(edge)
        size = np.diff(np.concatenate([first, [len(active)]]))
        more = np.repeat(size > 1, size) & (depth[active] < shallow)
        active, edge = active[more], edge[more]
        if not len(active):
            break
        first = np.flatnonzero(edge)
        size = np.diff(np.concatenate([first, [len(active)]]))
        key = word[starts[order[active]] + depth[active]]
        x, y, z = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        side = (key > pivot).astype(np.int8) - (key < pivot)
        number = np.repeat(np.arange(len(first)), size) * 3 + side + 1
        moved = np.argsort(number, kind="stable")
        order[active], depth[active] = order[active][moved], depth[active][moved] + 8 * (side[moved] == 0)
        number = number[moved]
        new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        # a group is named by the place of its first member
        own[active] = np.repeat(active[new], np.diff(np.concatenate([new, [len(active)]])))
    return order, blind(buf, word, starts, order, regroup(own), length)


def regroup(own: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the runs of equal values."""
    return np.cumsum(np.concatenate([[False], own[1:] != own[:-1]])) if len(own) else own


def blind(buf: np.ndarray, word: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order each group by a blind trie, in place; the class of each place. A group whose strings all equal its first is one leaf."""
    if not len(order):
        return group
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(order)]]))
    at, head = starts[order], np.repeat(starts[order[first]], size)
    differ = np.zeros(len(order), bool)
    for d in [*range(0, length - 8, 8), length - 8]:
        differ |= word[at + d] != word[head + d]
    unlike = np.zeros(len(first), bool)
    unlike[group[differ]] = True
    leaf = np.zeros(len(order), np.int64)
    if unlike.any():
        raw = buf.tobytes()
        for k in np.flatnonzero(unlike).tolist():
            a, b = int(first[k]), int(first[k] + size[k])
            trie, by_start = BlindTrie(raw, length), dict(zip(at[a:b].tolist(), order[a:b].tolist(), strict=True))
            for s in at[a:b].tolist():
                trie.insert(s)
            place = a
            for n, same in enumerate(trie.leaves()):
                for s in same:
                    order[place], leaf[place] = by_start[s], n
                    place += 1
    return np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (leaf[1:] != leaf[:-1])]))


def repeated_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, d1, d2, n, piece) sorted by m; gives (m, d1, d2, spans) of the pieces that occur once but hold repeated windows."""
    held: list[tuple] = []
    waiting: list[tuple] = []
    windows_ = 0

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        buf = np.frombuffer(b"".join(r[4] for r in rows) + bytes(8), np.uint8)
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        begin = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        piece = np.repeat(np.arange(len(rows)), count)
        starts = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        _, bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        order, same = deep_shallow(buf, starts, bucket[piece], length)
        times = np.bincount(same, np.array([r[3] for r in rows], np.int64)[piece[order]]) if len(order) else np.zeros(0)
        repeated = np.zeros(len(starts), bool)
        repeated[order] = times[same] > 1
        out: list[list] = [[], [], [], [], []]
        for i in np.flatnonzero(np.bincount(piece, repeated, len(rows)) > 0).tolist():
            if rows[i][3] > 1:
                continue
            lo = int(np.searchsorted(piece, i))
            mark = np.diff(np.concatenate([[0], repeated[lo : lo + count[i]].view(np.int8), [0]]))
            for col, v in zip(out, (*rows[i][:3], np.flatnonzero(mark == 1).tolist(), (np.flatnonzero(mark == -1) + length - 1).tolist()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.list_(pa.int64())) for x in out[3:])], names=["m", "d1", "d2", "begins", "ends"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][0] != row[0]:
                waiting += held
                held = []
                if windows_ >= AT_ONCE:
                    yield settle(waiting)
                    waiting, windows_ = [], 0
            held.append(row)
            windows_ += len(row[4]) - length + 1
    if waiting or held:
        yield settle(waiting + held)


def hot_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, d1, d2, n, piece); gives a digest of each window with its place."""
    for batch in batches:
        for m, d1, d2, n, piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            count = len(piece) - length + 1
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[k : k + length]) for k in range(count)), np.int64).reshape(-1, 2)
            full = lambda v, c=count: pa.array(np.full(c, v, np.int64))
            yield pa.RecordBatch.from_arrays([full(m), full(d1), full(d2), full(n), pa.array(np.arange(count)), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))], names=["m", "d1", "d2", "n", "at", "w1", "w2"])


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """A row for each row of docs: id_col; gone: sorted spans (begin, end), in bytes, which may overlap; and text where gone isn't null,
    or else n_bytes and text_sha256 of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = Stored(with_keys(rows, length, gram).select("id", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("id", F.col("k.keys").alias("m"), F.col("k.places").alias("places")), "keys")
    twice = keyed.df.groupBy("m").agg(F.sum("places").alias("times")).where("times > 1").select("m")
    by_text = keyed.df.join(twice, "m", "left_semi").groupBy("id").agg(F.collect_set("m").alias("repeated"))
    joined = rows.join(by_text.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    cut = with_pieces(joined, length, gram)
    some = F.size("m") > 0
    cut = cut.select("id", F.when(some, F.col("text")).alias("text"), F.octet_length("text").cast("long").alias("n_bytes"), F.when(~some, F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"), F.when(some, F.arrays_zip("m", "a", "b", "d1", "d2")).alias("pieces"), F.monotonically_increasing_id().alias("row"))
    store = Stored(cut, "pieces")
    keyed.drop()
    each = store.df.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    known = checkpoint(each.groupBy("m", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("row", "a", "b")).alias("one")))
    kinds = known.groupBy("m").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most = 1").select("m", "kinds")
    open_ = known.join(kinds, "m").select("m", "d1", "d2", "n", "kinds", "one.*")
    raw = store.df.where("text is not null").select("row", F.col("text").cast("binary").alias("raw"))
    shown = Stored(open_.join(raw, "row").select("m", "d1", "d2", "n", F.expr("substring(raw, int(a) + 1, int(b - a))").alias("piece"), "kinds"), "shown")
    fields = ["m", "d1", "d2", "n", "piece"]
    few = shown.df.where(F.col("kinds") <= hot).select(*fields).repartition("m").sortWithinPartitions("m")
    spans = few.mapInArrow(lambda b: repeated_windows(b, length), "m bigint, d1 bigint, d2 bigint, begins array<bigint>, ends array<bigint>")
    found = spans.select("m", "d1", "d2", F.zip_with("begins", "ends", lambda a, b: F.struct(a.alias("begin"), b.alias("end"))).alias("spans"))
    digests = shown.df.where(F.col("kinds") > hot).select(*fields).mapInArrow(lambda b: hot_windows(b, length), "m bigint, d1 bigint, d2 bigint, n bigint, at bigint, w1 bigint, w2 bigint")
    often = digests.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    found_hot = digests.where("n = 1").join(often, ["w1", "w2"], "left_semi").groupBy("m", "d1", "d2").agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + length).alias("end"))).alias("spans"))
    whole = known.where("n > 1").select("m", "d1", "d2", F.array(F.struct(F.lit(0).cast("long").alias("begin"), (F.col("one.b") - F.col("one.a")).alias("end"))).alias("spans"))
    decided = checkpoint(whole.unionByName(found).unionByName(found_hot))
    shown.drop()
    moved = each.join(decided, ["m", "d1", "d2"]).select("row", F.transform("spans", lambda s: F.struct((s["begin"] + F.col("a")).alias("begin"), (s["end"] + F.col("a")).alias("end"))).alias("spans"))
    gone = moved.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("gone"))
    return store.df.join(gone, "row", "left").select(F.col("id").alias(id_col), "text", "n_bytes", "text_sha256", "gone")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with kept_text (a binary), n_bytes, n_removed and n_spans. Rows are told apart by a number of their own; columns with these names give way."""
    rest = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    store = Stored(docs.select(rest.alias("rest"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    spans = repeat_spans(store.df, "row", "text", length).where("gone is not null").select("row", "gone")
    cut = cut_spans(store.df.join(spans, "row", "left").select("rest", "text", "gone"), "text", "gone")
    added = ["kept_text", "n_bytes", "n_removed", "n_spans"]
    return cut.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c not in added], *added)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns, from repeat_spans()."""
    cut = cut_spans(spans.withColumnRenamed("n_bytes", "all_bytes"), "text", "gone")
    untouched = F.col("text").isNull()
    return cut.select("doc_id", F.col("all_bytes").alias("n_bytes"), "n_removed", "n_spans", F.when(untouched, F.col("text_sha256")).otherwise(F.sha2("kept_text", 256)).alias("kept_sha256"))
