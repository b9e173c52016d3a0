"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, with DivideSkip.

A text's set is its distinct shingles of `width` consecutive words (runs of non-space characters, A-Z as a-z); a shorter text's whole
sequence is its one shingle; a text without words has an empty set and links with nothing. Two texts link when
100 * |A & B| >= PERCENT * |A | B|. The result is each text's set size and component.

1. Texts with equal sets are one class, known by its least id; the rest works on classes.
2. Under one order of shingles by rarity, a set of n gives its first n - ceil(t n) + slack(n) shingles to the inverted lists. Two sets
   that link share slack of the smaller or more of these (all of a small set), so that number T is the occurrences to search for.
   Lists of one entry are dropped. Slack is 1 + n // 32.
3. Documents are dealt into blocks of bounded size so that copies meet: each goes with its leader, the document it meets in most lists among those that
   lists name (the most central entry, and a random one that is the same for all lists). Large groups are dealt over several blocks that all hold the leader.
4. A task holds the inverted lists of a block. Each document is compared with its leader; then each one that still shares T lists with another component searches
   its lists: the short ones are merged by a heap with the threshold T less the number of long ones, the long ones are probed by binary search. What reaches T is
   compared by a sketch that bounds the difference, then verified on the whole sets. One link to each component is enough, so a group gives
   a tree of links, never all its pairs.
5. Lists that hold several components after that are searched across blocks: a document asks the other blocks where entries of lesser components share T lists
   with it, in the same way.
6. Links of both searches give the components. Pairs within a component aren't compared again; no other pair is left out.

Null texts count as empty; a row with a null id is linked with nothing and has no component. Rows that repeat an id and its text have the same result; rows of one id with
different texts are documents of their own (the smallest doc_id of a component is then a value, not a row). Texts of any length are taken whole, and columns besides id and text don't matter. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from quillet.llm.bytesview import U, Texts, bounds, lists, map_texts, slices, windows, words
from quillet.llm.components import components
from quillet.llm.hilbert import ranked
from quillet.llm.rarity import Rarity, frequent, shared_keys, sort_within
from quillet.session import Stored, checkpoint, lean, release

WIDTH, PERCENT = 5, 80
#: Shingles of a block, and documents that ask a task; tasks that a frequent key's list is dealt over.
BLOCK, ASKED, SALTS = 1 << 20, 2048, 64
NO_ID = -(1 << 63)


def shingles(t: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a slice, one after another, each sorted; and their edges."""
    _, _, hashes, doc = words(t)
    edges = bounds(doc, t.n)
    counts = np.diff(edges)
    found, owner = [], []
    if len(hashes) >= width:
        h = windows(hashes, width)[: len(hashes) - width + 1]
        whole = doc[: len(h)] == doc[width - 1 :]
        found.append(h[whole])
        owner.append(doc[: len(h)][whole])
    for length in range(1, width):
        short = np.flatnonzero(counts == length)
        if len(short):
            found.append(windows(hashes, length)[edges[short]])
            owner.append(short)
    h, own = np.concatenate([np.zeros(0, U), *found]), np.concatenate([np.zeros(0, np.int64), *owner])
    by_doc = np.argsort(own, kind="stable")
    h, own = h[by_doc], own[by_doc]
    order = sort_within(h, own)
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(t.n + 1))


def need(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of n with any that it links with."""
    return -(-PERCENT * n // 100)


def slack(n: np.ndarray | int) -> np.ndarray | int:
    return 1 + n // 32


def with_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Add n and the two halves of the set's digest."""

    def work(t: Texts) -> list[pa.Array]:
        h, edges = shingles(t, width)
        raw, at = h.tobytes(), (edges * 8).tolist()
        halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64).reshape(-1, 2)
        return [pa.array(np.diff(edges), pa.int64()), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))]

    return map_texts(docs, text, [StructField("n", LongType()), StructField("d1", LongType()), StructField("d2", LongType())], work, ["id"])


def with_prefixes(docs: DataFrame, text: str, width: int, rarity: Rarity) -> DataFrame:
    """id, n and the keys of the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def work(t: Texts) -> list[pa.Array]:
        h, edges = shingles(t, width)
        own = np.repeat(np.arange(t.n), np.diff(edges))
        keys = shared.value.keys(h)
        keys = keys[sort_within(keys, own)]
        n = np.diff(edges)
        length = np.minimum(n, n - need(n) + slack(n))
        place = np.arange(len(keys)) - np.repeat(edges[:-1], n)
        kept = place < np.repeat(length, n)
        return [pa.array(n, pa.int64()), lists(keys[kept].view(np.int64), np.concatenate([[0], np.cumsum(length)]), pa.int64())]

    return map_texts(docs, text, [StructField("n", LongType()), StructField("prefix", ArrayType(LongType()))], work, ["id"])


def postings(prefixes: DataFrame) -> DataFrame:
    """key, id and n of the lists with two entries or more; lists of frequent keys are dealt over SALTS tasks and kept whatever they hold."""
    flat = prefixes.select(F.explode("prefix").alias("key"), "id", "n")
    salt = F.when(F.shiftright("key", 56) > 0, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = flat.repartition("key", salt).sortWithinPartitions("key")
    return dealt.mapInArrow(lean(lambda b: shared_keys(b, frequent_too=True)), "key bigint, id bigint, n bigint")


def leaders(entries: DataFrame) -> DataFrame:
    """entries: key, id, n, lists. id, leader: of the documents that lists name, the one that each meets in most lists; itself if it meets none twice.

    A list names its most central entry (the one with most lists for its size: an original is in the lists of all its copies) and a random one.
    """
    ranks = [F.struct((-F.col("lists") / F.col("n")).alias("r"), F.xxhash64("id").alias("h"), F.col("id").alias("i")), F.struct(F.lit(0.0).alias("r"), F.xxhash64(F.col("id"), F.lit(1)).alias("h"), F.col("id").alias("i"))]
    named = entries.groupBy("key").agg(*[F.min(r)["i"].alias(f"named{k}") for k, r in enumerate(ranks)])
    met = entries.join(named, "key").select("id", F.explode(F.array_distinct(F.array("named0", "named1"))).alias("leader")).where("id <> leader")
    times = met.groupBy("id", "leader").agg(F.count("*").alias("times")).where("times > 1")
    return times.groupBy("id").agg(F.max(F.struct("times", "leader"))["leader"].alias("leader"))


def divide_skip(lists_: list[np.ndarray], threshold: int) -> list[int]:
    """The entries that occur in `threshold` of the sorted lists or more: the longest threshold - 1 lists at most are probed by binary
    search for what the heap merge of the others finds."""
    lists_ = sorted(lists_, key=len, reverse=True)
    if len(lists_) < threshold:
        return []
    longest = len(lists_[0])
    # the trade-off of Li, Lu and Lu (ICDE 2008): T / (mu log M + 1), with mu = 0.01
    long = min(threshold - 1, int(threshold / (0.01 * np.log2(max(2, longest)) + 1)))
    probes, short = [x.tolist() for x in lists_[:long]], [x.tolist() for x in lists_[long:]]
    found, last, times = [], None, 0

    def settle() -> None:
        if last is not None and times >= threshold - long:
            total = times
            for k, probe in enumerate(probes):
                if total + len(probes) - k < threshold:
                    return
                at = bisect_left(probe, last)
                total += at < len(probe) and probe[at] == last
            if total >= threshold:
                found.append(last)

    for entry in heapq.merge(*short):
        if entry != last:
            settle()
            last, times = entry, 0
        times += 1
    settle()
    return found


SKETCH = 1024


def sketches(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each set the parity of its elements in each of SKETCH bits. Two sets differ in as many elements as their sketches in bits, or more."""
    count = len(edges) - 1
    own = np.repeat(np.arange(count), np.diff(edges))
    odd = np.bincount(own * SKETCH + (h & U(SKETCH - 1)).astype(np.int64), minlength=count * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(count, SKETCH), axis=1).view(U)


class Block:
    """The documents of one part: their sets, sketches and sizes, the inverted lists of their keys, and their components."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.ids, self.comps, self.keys, self.sets, self.sketches = [], [], [], [], []
        self.lists: dict[int, np.ndarray] | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        """rows: id, comp, keys, text."""
        self.ids += rows.column(0).to_pylist()
        self.comps += rows.column(1).to_pylist()
        self.keys += [x.values.to_numpy() for x in rows.column(2)]
        for t in slices(rows.column(3)):
            h, edges = shingles(t, self.width)
            self.sets += [h[a:b].copy() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            self.sketches.append(sketches(h, edges))

    def close(self) -> None:
        sizes = [len(k) for k in self.keys]
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.keys])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((self.owner, self.flat))
        self.flat, self.owner = self.flat[order], self.owner[order]
        self.edge = np.flatnonzero(np.concatenate([[True], self.flat[1:] != self.flat[:-1], [True]])) if len(self.flat) else np.zeros(1, np.int64)
        self.lists = {int(self.flat[a]): self.owner[a:b] for a, b in zip(self.edge[:-1], self.edge[1:], strict=True)}
        self.comp = np.array(self.comps, np.int64)
        self.n = np.array([len(x) for x in self.sets], np.int64)
        self.bits = np.concatenate([np.zeros((0, SKETCH // 64), U), *self.sketches])
        self.sketches = []

    def links(self, own: np.ndarray, i: int) -> bool:
        """Whether the set `own` links with document i, by the whole sets."""
        other = self.sets[i]
        place = np.minimum(np.searchsorted(other, own), len(other) - 1)
        inter = int((other[place] == own).sum())
        return inter * 100 >= PERCENT * (len(own) + len(other) - inter)

    def ask(self, fit: np.ndarray, keys: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> list[int]:
        """Documents out of `fit` that link with the set `own`: one for each component."""
        n = len(own)
        fit = fit & (np.minimum(self.n, n) * 100 >= PERCENT * np.maximum(self.n, n))
        lists_ = [x[fit[x]] for k in keys.tolist() if (x := self.lists.get(k)) is not None]
        found = np.array(divide_skip([x for x in lists_ if len(x)], int(least_shared(n))), np.int64)
        if not len(found):
            return []
        overlap = -(-PERCENT * (n + self.n[found]) // (100 + PERCENT))
        differ = np.bitwise_count(self.bits[found] ^ sketch).sum(1, dtype=np.int64)
        found = found[differ <= n + self.n[found] - 2 * overlap]
        out: dict[int, int] = {}
        for i in found.tolist():
            if self.comp[i] not in out and self.links(own, i):
                out[self.comp[i]] = i
        return list(out.values())

    def join(self, leader: np.ndarray) -> list[tuple[int, int]]:
        """Links that join all documents of the block that any links join. leader: of each document, by its place in the block, or -1."""
        self.comp = np.arange(len(self.ids))
        out = []

        def unite(i: int, k: int) -> None:
            out.append((self.ids[i], self.ids[k]))
            self.comp[self.comp == max(self.comp[i], self.comp[k])] = min(self.comp[i], self.comp[k])

        for i in np.flatnonzero(leader >= 0).tolist():
            k = int(leader[i])
            if self.comp[i] != self.comp[k] and min(self.n[i], self.n[k]) * 100 >= PERCENT * max(self.n[i], self.n[k]) and self.links(self.sets[i], k):
                unite(i, k)
        if not len(self.flat):
            return out
        # only what shares lists enough with other components searches
        comp = self.comp[self.owner]
        several = np.minimum.reduceat(comp, self.edge[:-1]) != np.maximum.reduceat(comp, self.edge[:-1])
        shared = np.bincount(self.owner, weights=np.repeat(several, np.diff(self.edge)), minlength=len(self.ids))
        for i in np.flatnonzero(shared >= least_shared(self.n)).tolist():
            fit = self.comp != self.comp[i]
            fit[i:] = False  # a pair is asked for once
            for k in self.ask(fit, self.keys[i], self.sets[i], self.bits[i]):
                if self.comp[i] != self.comp[k]:
                    unite(i, k)
        return out


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """The least T that a set of n elements may have with any partner."""
    return np.minimum(slack(need(n)), need(n))


def groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Of rows sorted by their first columns, pieces with one value of these."""
    for batch in batches:
        by = [batch.column(k).to_numpy() for k in range(columns)]
        if batch.num_rows:
            edge = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in by], axis=0), [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield tuple(int(x[a]) for x in by), batch.slice(a, b - a)


def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["x", "y"])


def search_within(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, leader, keys, text) sorted by part. Gives links of documents of one part."""
    part, block, leader = None, Block(width), []

    def settled() -> pa.RecordBatch:
        block.close()
        place = {i: k for k, i in enumerate(block.ids)}
        return pairs_of(block.join(np.array([place.get(x, -1) if x != i else -1 for i, x in zip(block.ids, leader, strict=True)], np.int64)))

    for (at,), rows in groups(batches, 1):
        if at != part and part is not None:
            yield settled()
            block, leader = Block(width), []
        part = at
        leader += rows.column(2).to_pylist()
        block.add(rows.select(["id", "leader", "keys", "text"]))
    if part is not None:
        yield settled()


def search_across(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, id, comp, keys, text) sorted by part and kind: the documents of a part (kind 0), then what asks them (kind 1). Gives links to lesser components."""
    part, block = None, Block(width)
    for (at, kind), rows in groups(batches, 2):
        if at != part:
            part, block = at, Block(width)
        rows = rows.select(["id", "comp", "keys", "text"])
        if kind == 0:
            block.add(rows)
            continue
        if block.lists is None:
            block.close()
        found = []
        ids, comps = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        for t in slices(rows.column(3)):
            h, edges = shingles(t, width)
            bits = sketches(h, edges)
            for i in range(t.n):
                k = t.lo + i
                links = block.ask(block.comp < comps[k], rows.column(2)[k].values.to_numpy(), h[edges[i] : edges[i + 1]], bits[i])
                found += [(ids[k], block.ids[y]) for y in links]
        yield pairs_of(found)


def threshold(n: str = "n"):
    """The least T that a set of n elements may have with any partner."""
    floor = F.ceil(F.col(n) * PERCENT / 100)
    return F.least(F.floor(floor / 32) + 1, floor)


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """df, of narrow rows, in partitions of the advisory size: a table to be stored makes a file for each, and each file on a local folder starts two processes or three."""
    return df.hint("rebalance", *by)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col, n_shingles and component_id of each row of docs."""
    named = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").alias("text"))
    sets = Stored(gathered(with_sets(named, "text", width)), "sets")
    differ = sets.df.where(F.col("id") != NO_ID).groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in ("d1", "d2") for n, f in (("min", F.min), ("max", F.max))])
    if differ.where("min_d1 <> max_d1 or min_d2 <> max_d2").limit(1).count():
        sets.drop()
        placed = ranked(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h")), ["id", "h"])[0]
        names = placed.select(F.col("rank").alias("component_id"), F.col("id").alias("component"))
        each = jaccard_components(placed.where("id is not null"), "rank", "text", width).join(names, "component_id").select("rank", "n_shingles", "component")
        counted = each.join(placed.select("rank", "id"), "rank").select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
        return counted.unionByName(jaccard_components(docs.where(F.col(f"`{id_col}`").isNull()), id_col, text, width))
    rarity = frequent(named, "text", lambda t: shingles(t, width)[0])
    classes = checkpoint(sets.df.where((F.col("n") > 0) & (F.col("id") != NO_ID)).groupBy("d1", "d2").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    lists_ = Stored(gathered(postings(with_prefixes(named, "text", width, rarity).where("n > 0").join(reps, "id", "left_semi").dropDuplicates(["id"])), "id"), "lists")
    # only those with lists enough can link
    counts = lists_.df.groupBy("id").agg(F.count("*").alias("lists"), F.first("n").alias("n"))
    live = checkpoint(counts.where(F.col("lists") >= threshold()))
    entries = Stored(lists_.df.select("key", "id").join(live, "id").select("key", "id", "n", "lists"), "entries")
    lists_.drop()
    # blocks, by leader
    own = live.select("id", "n").join(leaders(entries.df), "id", "left").select("id", "n", F.coalesce("leader", "id").alias("leader"))
    own = checkpoint(own)
    parts = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    led = own.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("subs"))
    part = F.pmod(F.xxhash64("leader", "sub"), F.lit(parts)).cast("int").alias("part")
    home = own.join(led, "leader").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int")).select("id", "leader", part)
    present = led.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(F.col("leader").alias("id"), "leader", part)
    home = checkpoint(home)
    # a document once in each part, with its own leader if it has two
    held = checkpoint(home.unionByName(present).groupBy("part", "id").agg(F.min(F.struct((F.col("leader") == F.col("id")).alias("self"), "leader"))["leader"].alias("leader")))
    keys = entries.df.groupBy("id").agg(F.collect_list("key").alias("keys"))
    # whole texts are read again where they are needed, not stored; one shuffle by id serves the filter, the distinct rows and the join
    texts = lambda ids: named.join(ids.select("id"), "id", "left_semi").dropDuplicates(["id"])
    rows = held.join(keys, "id").join(texts(live), "id").select("part", "id", "leader", "keys", "text")
    within = rows.repartition("part").sortWithinPartitions("part").mapInArrow(lean(lambda b: search_within(b, width)), "x bigint, y bigint")
    first = checkpoint(within)
    release(docs.sparkSession)
    labels = components(first)
    # across blocks: lists with several components
    marked = Stored(entries.df.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("comp")), "marked")
    entries.drop()
    mixed = marked.df.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "lo")
    mixed = Stored(marked.df.join(mixed, "key"), "mixed")
    marked.drop()
    enough = mixed.df.groupBy("id").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list("key").alias("keys")).where(F.size("keys") >= threshold())
    enough = checkpoint(enough.join(home.select("id", "part"), "id"))
    shared = enough.select(F.explode("keys").alias("key"), "part").distinct()
    asking = mixed.df.where("comp <> lo").join(enough.select("id"), "id", "left_semi").join(shared, "key")
    asking = asking.groupBy("part", "id").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list("key").alias("keys")).where(F.size("keys") >= threshold())
    asking = checkpoint(asking.join(held.select("part", "id"), ["part", "id"], "left_anti").select("part", "id", "comp", "keys"))
    # what asks one block is dealt over tasks that each hold the block
    shares = checkpoint(asking.groupBy("part").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares")))
    needed = texts(enough)  # what asks is among these
    each = lambda df, share: df.join(shares, "part").join(needed, "id").withColumn("share", share).select("part", "share", "kind", "id", "comp", "keys", "text")
    whole = each(enough.select("part", F.lit(0).alias("kind"), "id", "comp", "keys"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    asked = each(asking.withColumn("kind", F.lit(1)), F.pmod(F.xxhash64("id", F.lit(1)), "shares").cast("int"))
    rows = whole.unionByName(asked).select(F.xxhash64("part", "share").alias("part"), "kind", "id", "comp", "keys", "text")
    second = rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(lean(lambda b: search_across(b, width)), "x bigint, y bigint")
    links = checkpoint(first.unionByName(second))
    labels = components(links)
    mixed.drop()
    member = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("component"))
    out = sets.df.join(member, ["d1", "d2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    named_row = F.col("id") != NO_ID
    return out.select(F.when(named_row, F.col("id")).alias(id_col), "n_shingles", F.when(named_row, F.col("component_id")).alias("component_id"))
