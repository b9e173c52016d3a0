"""Line dedup by an exact set-similarity join of line tokens.

A line's set is its distinct words (runs of non-space characters, A-Z as a-z). Every line with a word takes part.
A line is removed when an earlier line (by document, then line number), removed or not, has 100 * |A & B| >= PERCENT * |A | B|.

1. Lines with equal sets are one class, known by a digest; all occurrences but its first are removed. Each task settles the repeats among a block of
   its lines, so that a line by the million is a row for each block. Sets of fewer than LISTED words link with equal ones only, so they are
   settled here and enter no list (a set of LISTED words links with one that has a word more).
2. Words are ordered by rarity: uncounted ones first, then by count. A class is entered under each infrequent word of its prefix (the n - ceil(t n) + 1 rarest words), and under
   each pair of frequent words of the prefix longer by one: two sets that link share two words of that, and if the rarer is infrequent
   it lies in the prefix; else both are frequent and the pair is a key. Frequent keys alone would make lists that grow with the corpus.
3. Within a list, entries meet if they pass the length filter, the positional filter (sets that link also meet under the first words
   they share, so these and the words behind them must be enough) and a sketch filter: 64 parities of hashed words; two sets differ in as many
   words as their sketches in bits, or more. A list gives its entries that meet another, with a digest of whom they meet there, never pairs: a group of near copies is
   a row for each member and list. Of an entry's lists in which it meets the same others, the one of least key stands for all. (A pair meets in some lists; for
   either of its sets these are all lists of some digests; so both keep the least of them, and no pair is lost.)
4. The entries' sketches of 512 bits are dealt by list. There each line proposes the earlier one that differs least, of those that pass the length filter and these sketches; the best
   proposal of a line's lists is verified on the whole sets.
5. Lines whose proposal fails while there were others are settled within their lists, dealt once more with their words: each is compared with all earlier lines that pass, until one links. Only the
   lines to remove leave the list. No pair is left out.

Null texts have no lines; rows with a null id are left alone. Lines without words stay. Rows that repeat an id are rows of their own: they are ordered by id, then by a hash of the
text, then at random. Documents that lose all their lines with words are empty afterwards. Texts of any length are taken whole. Columns with the names of added
ones give way to them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.bytesview import LOWER_TABLE, U, Texts, earlier, filled, hash_ranges, mix, runs, slices
from quillet.llm.hilbert import ranked
from quillet.llm.rarity import Counter, Rarity, class_of, top
from quillet.session import Stored, checkpoint, lean, release, small_batches

PERCENT = 80
#: The least words of a set that links with another than itself: n of n + 1.
LISTED = -(-PERCENT // (100 - PERCENT))
#: Words in so many lines are frequent; words in COUNTED lines or more are ordered by their counts.
MIN_COUNT, COUNTED = 1000, 12
#: span is n << 32 | place: the size of the set and the place of the key's later word.
FIELDS = ["key", "d1", "span", "sketch"]
#: Lines of a block; entries of a short list; entries of a long list that are compared at once; pairs that are tested at once.
BLOCK, SHORT, TILE, PAIRS = 1 << 19, 64, 512, 250_000
#: Entries that a task deals into buckets at once; buckets, and words for each of them where that makes more.
DEALT, BUCKETS, WORDS = 1 << 18, 1024, 1 << 18
#: 64-bit words of the large sketch.
SKETCH = 8
LOW48 = U((1 << 48) - 1)
LOW32 = (1 << 32) - 1


def packed_sort(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort 48-bit values within their groups (which need no order). One sort of one number where 16 bits hold the groups."""
    if not len(group) or int(group.max()) < 1 << 16:
        both = np.sort(group.astype(U) << U(48) | value)
        return (both >> U(48)).astype(np.int64), both & LOW48
    order = np.lexsort((value, group))
    return group[order], value[order]


def distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    group, value = packed_sort(group, value)
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return group[new], value[new]


def numbered(starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many marks stand at or before each start; both ascend."""
    at = np.searchsorted(starts, marks)
    return np.repeat(np.arange(len(marks) + 1), np.diff(np.concatenate([[0], at, [len(starts)]])))


class Lines:
    """The lines with words of a slice: their sets, one after another (line counted over the slice; 48 bits of each word's hash, sorted), which lines
    they are, where each begins, its size, and two halves of a digest: sums of hashes, as a set has no order."""

    def __init__(self, t: Texts):
        starts, ends = runs(filled(t.buf), t.offs)
        h = hash_ranges(t.buf, starts, ends, LOWER_TABLE) >> U(16)
        newlines = np.flatnonzero(t.buf == 10)
        self.texts = np.searchsorted(newlines, t.offs) + np.arange(t.n + 1)  # a text of k newlines has k + 1 lines
        # words by the newlines and texts before them, of which there are fewer
        self.line, self.words = distinct(numbered(starts, newlines) + numbered(starts, t.offs[1:]), h)
        new = np.ones(len(self.line), bool)
        new[1:] = self.line[1:] != self.line[:-1]
        self.start = np.flatnonzero(new)
        self.which = self.line[self.start]
        self.size = np.diff(np.concatenate([self.start, [len(self.line)]]))
        none = np.zeros(0, U)
        self.d1, self.d2 = (np.add.reduceat(mix(self.words ^ U(salt)), self.start) if len(self.start) else none for salt in (0x51ED27, 0xB5297A4D))

    def docs(self) -> np.ndarray:
        """The text of each line."""
        return np.searchsorted(self.texts, self.which, "right") - 1


def need(n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * n // 100)


KINDS = ["kind", "d1", "d2", "id", "no", "counts"]


def with_lines(rows: DataFrame) -> DataFrame:
    """Rows of kind 0: digest, id and number of the first line of each set in a block; of kind 1: the block's other lines; of kind 2: a piece (d1) of the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, size = Counter(), [], 0

        def flush() -> pa.RecordBatch:
            lines = np.concatenate([np.zeros((4, 0), np.int64), *held], axis=1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(earlier(lines).astype(np.int32)), *(pa.array(x) for x in lines), pa.nulls(lines.shape[1], pa.binary())], names=KINDS)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for t in slices(batch.column(1)):
                own = Lines(t)
                counter.add(own.words << U(16))
                doc = own.docs()
                held.append(np.stack([own.d1.view(np.int64), own.d2.view(np.int64), ids[t.lo + doc], own.which - own.texts[doc]]))
                size += len(doc)
                if size >= BLOCK:
                    yield flush()
                    size = 0
        yield flush()
        numbers, counts = counter.pieces()
        zero = np.zeros(len(numbers), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 2), *(pa.array(c, pa.int64()) for c in (numbers, zero, zero, zero)), pa.array(counts, pa.binary())], names=KINDS)

    return rows.select("id", "text").mapInArrow(lean(run), "kind int, d1 bigint, d2 bigint, id bigint, no bigint, counts binary")


def by_key(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Of rows sorted by a column, tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[-1].column(column)[0].as_py() != key[0]:
            if last:
                held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1, d2, id, no, sorted by d1. Adds whether the line is not the first of its set."""
    for table in by_key(batches):
        lines = np.stack([table.column(k).to_numpy() for k in range(4)])
        yield pa.RecordBatch.from_arrays([pa.array(lines[0]), pa.array(lines[2]), pa.array(lines[3]), pa.array(earlier(lines))], names=["d1", "id", "no", "copy"])


def line_prefixes(rows: DataFrame, rarity: Rarity) -> DataFrame:
    """Entries of FIELDS, one for each key of each line, in buckets (see packed()); sketch is the parity of the hashed words in each of 64 bits. A task leaves out
    lines whose sets it has seen not long before.

    Here a word is its class (7 bits) and 41 bits of its hash; words that agree in these only make lists longer."""
    shared = rows.sparkSession.sparkContext.broadcast(rarity)
    frequent = U(int(class_of(MIN_COUNT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_, seen = shared.value, np.arange(BLOCK).astype(U) ^ U(1)  # the last digest of each place; at first none that has this place
        for batch in batches:
            for t in slices(batch.column(0)):
                own = Lines(t)
                digest = own.d1 ^ mix(own.d2)
                chosen = np.zeros(len(digest), bool)
                chosen[np.unique(digest, return_index=True)[1]] = True
                chosen &= own.size >= LISTED
                place = (digest & U(BLOCK - 1)).astype(np.int64)
                chosen &= seen[place] != digest
                seen[place[chosen]] = digest[chosen]
                size = own.size[chosen]
                stay = np.repeat(chosen, own.size)
                h, line = own.words[stay], np.repeat(np.arange(len(size)), size)
                start = np.cumsum(size) - size
                if not len(h):
                    continue
                sketch = np.bitwise_xor.reduceat(U(1) << (h & U(63)), start)
                which, key = packed_sort(line, order_.keys(h << U(16)) >> U(15))
                place = np.arange(len(which)) - start[which]
                length = (size - need(size) + 1)[which]
                often = key >> U(41) >= frequent
                alone = np.flatnonzero((place < length) & ~often)
                outs = [(which[alone], key[alone], place[alone])]
                at = np.flatnonzero((place < length + 1) & often)
                for step in range(1, int(np.bincount(which[at], minlength=1).max(initial=0))):  # pairs of frequent words that are `step` apart
                    left = at[:-step][which[at[:-step]] == which[at[step:]]]
                    outs.append((which[left], mix(key[left] * U(3) + mix(key[left + step])) | U(1 << 63), place[left + step]))
                who, keys, last = (np.concatenate(x) for x in zip(*outs, strict=True))
                cols = [keys, own.d1[chosen][who], size[who] << 32 | last, sketch[who]]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=FIELDS)

    buckets = max(BUCKETS, rarity.total // WORDS)
    return rows.select("text").mapInArrow(lean(lambda b: packed(run(b), buckets)), "bucket int, entries binary")


def packed(batches: Iterator[pa.RecordBatch], buckets: int, most: int = DEALT) -> Iterator[pa.RecordBatch]:
    """bucket, entries: rows of four numbers, dealt by a hash of the first, the key. The rows of a bucket stand in one binary, so that Spark moves and sorts
    buckets rather than entries; a key's rows all have one bucket."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        rows = np.concatenate(held)
        held.clear()
        at = ((mix(rows[:, 0].view(U)) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
        order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
        at, rows = at[order], rows[order]
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        return pa.RecordBatch.from_arrays([pa.array(at[edge[:-1]]), pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 32).astype(np.int32)), pa.py_buffer(rows)])], names=["bucket", "entries"])

    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            held.append(np.stack([c.to_numpy() for c in batch.slice(lo, most).columns], axis=1))
            if sum(map(len, held)) >= most:
                yield flush()
    if held:
        yield flush()


def opened(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Of packed() rows sorted by bucket, a batch for each bucket: the entries sorted by key, with least=2 those that share theirs alone."""
    for table in by_key(batches):
        bucket = table.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(1).slice(a, b - a)]).reshape(-1, 4)
            key = np.ascontiguousarray(rows[:, 0])
            order = np.argsort(key)
            if least > 1:
                same = np.zeros(len(key), bool)
                same[1:] = key[order[1:]] == key[order[:-1]]
                same[:-1] |= same[1:]
                order = order[same]
            cols = rows[order].T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=FIELDS)


def passes(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs may link, by length, position and sketch. key is that of both."""
    total = x["n"] + y["n"]
    least = -(-PERCENT * total // (100 + PERCENT))
    ok = np.minimum(x["n"], y["n"]) * 100 >= PERCENT * np.maximum(x["n"], y["n"])
    # the key's words taken as the first that both share: they and at most the words behind them are shared
    ok &= np.minimum(x["n"] - x["place"], y["n"] - y["place"]) + (x["key"] < 0) >= least
    return ok & (np.bitwise_count(x["sketch"] ^ y["sketch"]) <= total - 2 * least)


def short_pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (later, earlier) of rows of lists."""
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    first = np.repeat(begin, size)
    x = np.repeat(first + offset, offset)
    return x, np.arange(len(x)) - np.repeat(np.cumsum(offset) - offset, offset) + np.repeat(first, offset)


def parts(size: np.ndarray) -> Iterator[np.ndarray]:
    """The short lists in groups of some PAIRS pairs."""
    group = np.cumsum(size * (size - 1) // 2) // PAIRS
    for k in np.unique(group).tolist():
        yield np.flatnonzero(group == k)


def by_size(change: np.ndarray, n: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """The order of sorted lists' entries by list, size and digest. change: the number of the list of each entry but the first.

    One sort of one number where it holds list and size beside 16 bits of the digest or more (copies that others come between stay apart, which only gives more entries)."""
    of = np.concatenate([np.zeros(min(1, len(n)), np.int64), change])
    sizes = int(n.max(initial=0)).bit_length()
    rest = 64 - int(of.max(initial=0)).bit_length() - sizes
    if rest < 16:
        return np.lexsort((d1, n, of))
    return np.argsort((of << sizes | n).astype(U) << U(rest) | d1.view(U) >> U(64 - rest))


def meet(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mark: np.ndarray, met: np.ndarray, others: np.ndarray) -> None:
    """Of the pairs (x, y), those that pass are noted in met and others."""
    fit = passes({k: v[x] for k, v in rows.items()}, {k: v[y] for k, v in rows.items()})
    x, y = x[fit], y[fit]
    met[x] = met[y] = True
    np.add.at(others, x, mark[y])
    np.add.at(others, y, mark[x])


def meeting(batches: Iterator[pa.RecordBatch], brief: int = SHORT, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS sorted by key: the entries (key, d1) that pass with others of their list, and a sum of the hashes of these. A list is held while it is read: 32 bytes an entry."""
    for table in by_key(batches):
        key, d1 = table.column(0).to_numpy(), table.column(1).to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        some = np.flatnonzero(same)
        n = table.column(2).to_numpy()[some] >> 32
        # by size, so that the partners of an entry follow each other; copies from several tasks are one entry
        order = by_size(np.cumsum(key[some[1:]] != key[some[:-1]], dtype=np.int64), n, d1[some])
        some, n = some[order], n[order]
        new = np.ones(len(some), bool)
        new[1:] = (key[some[1:]] != key[some[:-1]]) | (d1[some[1:]] != d1[some[:-1]])
        some, n = some[new], n[new]
        key, d1, span, sketch = key[some], d1[some], table.column(2).to_numpy()[some], table.column(3).to_numpy()[some].view(U)
        rows = {"key": key, "n": n, "place": span & LOW32, "sketch": sketch}
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        size, met, others, mark = np.diff(edge), np.zeros(len(key), bool), np.zeros(len(key), U), mix(d1.view(U))
        # an entry's partners are among those before it, from the first that is large enough; each must be within the other's bound
        of = np.repeat(np.arange(len(size)), size)
        bound = (100 + PERCENT) * (n - rows["place"] + (key < 0)) // PERCENT - n
        least = np.searchsorted(of << 33 | n, of << 33 | need(n))
        after = np.searchsorted(of << 33 | n, of << 33 | bound, "right")
        entry = np.flatnonzero(size[of] <= brief)
        times = np.maximum(np.minimum(after[entry], entry) - least[entry], 0)
        group = np.cumsum(times) // PAIRS
        for k in np.unique(group[times > 0]).tolist():
            own = (group == k) & (times > 0)
            x = np.repeat(entry[own], times[own])
            y = np.arange(len(x)) - np.repeat(np.cumsum(times[own]) - times[own], times[own]) + np.repeat(least[entry[own]], times[own])
            near = n[x] <= bound[y]
            meet(rows, x[near], y[near], mark, met, others)
        small, bound, enough = n.astype(np.int32), bound.astype(np.int32), need(n).astype(np.int32)
        for a, b in zip(edge[:-1][size > brief].tolist(), edge[1:][size > brief].tolist(), strict=True):
            for lo in range(a, b, tile):
                i = slice(lo, min(b, lo + tile))
                for other in range(int(least[lo]), min(i.stop, int(after[i].max())), tile):
                    j = slice(other, min(i.stop, other + tile))
                    fit = (small[i, None] <= bound[None, j]) & (small[None, j] <= bound[i, None]) & (small[None, j] >= enough[i, None])
                    x, y = np.divmod(np.flatnonzero(fit), fit.shape[1])
                    x, y = x + lo, y + other
                    before = y < x
                    meet(rows, x[before], y[before], mark, met, others)
        yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(d1[met]), pa.array(others[met].view(np.int64))], names=["key", "d1", "others"])


class Sketches:
    """Sizes and large sketches of some sets."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.bits = n, bits

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may link, by length and sketch; and in how many bits they differ."""
        n, m = self.n[x], self.n[y]
        least = -(-PERCENT * (n + m) // (100 + PERCENT))
        differ = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(-1, dtype=np.int64)
        return (np.minimum(n, m) * 100 >= PERCENT * np.maximum(n, m)) & (differ <= n + m - 2 * least), differ


class Sets(Sketches):
    """The words of some lines, for comparisons by whole sets."""

    def __init__(self, lines: pa.Array):
        row = h = np.zeros(0, np.int64)
        for t in slices(lines, 1 << 62):
            starts, ends = runs(filled(t.buf), t.offs)
            row, h = distinct(np.searchsorted(t.offs, starts, "right") - 1, hash_ranges(t.buf, starts, ends, LOWER_TABLE) >> U(16))
        self.words = h.view(U)
        super().__init__(np.bincount(row, minlength=len(lines)), np.zeros((len(lines), SKETCH), U))
        self.start = np.cumsum(self.n) - self.n
        np.bitwise_xor.at(self.bits, (row, (self.words >> U(6) & U(SKETCH - 1)).astype(np.int64)), U(1) << (self.words & U(63)))

    def link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs link."""
        out = np.zeros(len(x), bool)
        total = np.cumsum(self.n[x] + self.n[y]) // 4_000_000
        for k in np.unique(total).tolist():
            some = np.flatnonzero(total == k)
            n, m = self.n[x[some]], self.n[y[some]]
            both = np.concatenate([self.n[x[some]], self.n[y[some]]])
            first = np.concatenate([self.start[x[some]], self.start[y[some]]])
            at = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both) + np.repeat(first, both)
            pair, h = packed_sort(np.repeat(np.concatenate([np.arange(len(some))] * 2), both), self.words[at])
            twice = pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])]
            inter = np.bincount(twice, minlength=len(some))
            out[some] = inter * 100 >= PERCENT * (n + m - inter)
        return out


def with_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, no, keys, line. Adds n and bits."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sets = Sets(part.column(3))
            edge = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SKETCH)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets.n, pa.int64()), pa.ListArray.from_arrays(edge, pa.array(sets.bits.view(np.int64).ravel()))], names=["id", "no", "keys", "line", "n", "bits"])


def in_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by key, id and no (the first columns); ids and nos in it, and the edges of lists."""
    key, ids, nos = (table.column(k).to_numpy() for k in range(3))
    order = np.lexsort((nos, ids, key))
    key = key[order]
    return order, ids[order], nos[order], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def pairs_in(edge: np.ndarray, open_: np.ndarray, brief: int, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of one list, x open and y before it, sorted by x and y, in bounded numbers; open_ may change meanwhile."""
    size = np.diff(edge)
    few = (size > 1) & (size <= brief)
    begin, small = edge[:-1][few], size[few]
    for group in parts(small):
        x, y = short_pairs(begin[group], small[group])
        yield x[open_[x]], y[open_[x]]
    for a, b in zip(edge[:-1][size > brief].tolist(), edge[1:][size > brief].tolist(), strict=True):
        for lo in range(a, b, tile):
            for other in range(a, lo + 1, tile):
                left = lo + np.flatnonzero(open_[lo : min(b, lo + tile)])
                right = np.arange(other, min(b, other + tile))
                i, j = np.nonzero(right[None, :] < left[:, None])
                yield left[i], right[j]


def proposals(batches: Iterator[pa.RecordBatch], brief: int = SHORT, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """key, id, no, n, bits, sorted by key. For each line that may link with earlier ones of its list: the one that differs least (the first of these), by
    how much, and how many they are."""
    for table in by_key(batches):
        order, ids, nos, edge = in_lists(table)
        bits = table.column(4).combine_chunks()
        sketches = Sketches(table.column(3).to_numpy()[order], bits.flatten().to_numpy().view(U).reshape(-1, SKETCH)[order])
        best, times, least = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), 1 << 32)
        for x, y in pairs_in(edge, np.ones(len(ids), bool), brief, tile):
            fit, differ = sketches.near(x, y)
            x, y, differ = x[fit], y[fit], differ[fit]
            np.add.at(times, x, 1)
            first = np.lexsort((y, differ, x))
            first = first[np.concatenate([[True], x[first][1:] != x[first][:-1]])] if len(x) else first
            first = first[differ[first] < least[x[first]]]
            best[x[first]], least[x[first]] = y[first], differ[first]
        some = times > 0
        cols = [ids[some], nos[some], ids[best[some]], nos[best[some]], least[some], times[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "no", "to_id", "to_no", "differ", "times"])


def linked(batches: Iterator[pa.RecordBatch], brief: int = SHORT, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """key, id, no, line, open, sorted by key: the open lines (id, no) that link with an earlier one of their list. The lines of a list are held while it is read."""
    for table in by_key(batches):
        order, ids, nos, edge = in_lists(table)
        sets = Sets(table.column(3).combine_chunks().take(pa.array(order)))
        open_ = table.column(4).to_numpy()[order].astype(bool)
        gone = np.zeros(len(ids), bool)
        for x, y in pairs_in(edge, open_, brief, tile):
            fit = sets.near(x, y)[0]
            settle(sets, x[fit], y[fit], gone)
            open_ &= ~gone
        yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array(nos[gone])], names=["id", "no"])


def settle(sets: Sets, x: np.ndarray, y: np.ndarray, gone: np.ndarray) -> None:
    """x, y: pairs, sorted by x. Marks each x that links with one of its y, the first ones tried first."""
    tried = 0
    for most in (1, 8, len(x)):
        nth = np.arange(len(x)) - np.searchsorted(x, x)
        now = (nth < most) & (nth >= tried) & ~gone[x]
        gone[x[now][sets.link(x[now], y[now])]] = True
        tried = most


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, no, line, other line: the id and no of those that link."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sets = Sets(pa.concat_arrays([part.column(2), part.column(3)]))
            x = np.arange(part.num_rows)
            keep = pa.array(sets.link(x, x + part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["id", "no"])


def met_lines(rows: DataFrame, lines: Stored, limits: tuple[int, int]) -> DataFrame:
    """d1, keys: the sets that meet others, and the lists that stand for all in which they do."""
    rarity = top(lines.df.where("kind = 2").select(F.col("d1").alias("part"), "counts"), COUNTED)
    entries = line_prefixes(rows, rarity).repartition("bucket").sortWithinPartitions("bucket")
    met = entries.mapInArrow(lean(lambda b: meeting(opened(b, 2), *limits)), "key bigint, d1 bigint, others bigint").groupBy("d1", "others").agg(F.min("key").alias("key"))
    return met.groupBy("d1").agg(F.collect_set("key").alias("keys"))


def shown_lines(rows: DataFrame, met: DataFrame, first: DataFrame) -> DataFrame:
    """id, no, keys, line, n, bits of the first line of each set in `met`."""
    wanted = met.join(first.where("not copy").select("d1", "id", "no"), "d1").groupBy("id").agg(F.collect_list(F.struct("no", "keys")).alias("at"))
    # the wanted places of a task are few beside its texts, which needn't be sorted
    text = rows.join(wanted.hint("shuffle_hash"), "id").select("id", "at", F.split("text", "\n").alias("lines"))
    each = text.select("id", F.explode(F.transform("at", lambda x: F.struct(x["no"].alias("no"), x["keys"].alias("keys"), F.get("lines", x["no"].cast("int")).alias("line")))).alias("x"))
    return each.select("id", "x.*").mapInArrow(lean(with_sketches), "id bigint, no bigint, keys array<bigint>, line string, n bigint, bits array<bigint>")


def best_proposals(shown: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """id, no, to (differ, to_id, to_no), more: the best proposal of each line, and whether it had others."""
    by_list = shown.select(F.explode("keys").alias("key"), "id", "no", "n", "bits").repartition("key").sortWithinPartitions("key")
    found = by_list.mapInArrow(lean(lambda b: proposals(b, *limits)), "id bigint, no bigint, to_id bigint, to_no bigint, differ bigint, times bigint")
    one = F.struct("to_id", "to_no")
    return found.groupBy("id", "no").agg(F.min(F.struct("differ", "to_id", "to_no")).alias("to"), ((F.max("times") > 1) | (F.min(one) < F.max(one))).alias("more"))


def settled(shown: DataFrame, best: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """id, no of the lines that link with an earlier one."""
    lines = shown.select("id", "no", "line")
    # under names of their own the lines would be shuffled twice, so both sides join the same table
    p, x, y = best.select("id", "no", "to.to_id", "to.to_no").alias("p"), lines.alias("x"), lines.alias("y")
    both = p.join(x, F.expr("p.id = x.id and p.no = x.no")).join(y, F.expr("p.to_id = y.id and p.to_no = y.no"))
    near = checkpoint(both.select("p.id", "p.no", "x.line", F.col("y.line").alias("other")).mapInArrow(lean(verified), "id bigint, no bigint"))
    left = checkpoint(best.where("more").select("id", "no").join(near, ["id", "no"], "left_anti"))
    if not left.limit(1).count():
        return near
    each = shown.select(F.explode("keys").alias("key"), "id", "no")
    alive = each.join(left, ["id", "no"], "left_semi").select("key").distinct()
    asked = each.join(alive, "key", "left_semi").groupBy("id", "no").agg(F.collect_list("key").alias("keys")).join(left.withColumn("open", F.lit(True)), ["id", "no"], "left")
    lists_ = asked.join(lines, ["id", "no"]).select(F.explode("keys").alias("key"), "id", "no", "line", F.coalesce("open", F.lit(False)).alias("open")).repartition("key").sortWithinPartitions("key")
    return near.unionByName(checkpoint(lists_.mapInArrow(lean(lambda b: linked(b, *limits)), "id bigint, no bigint").distinct()))


def duplicate_lines(rows: DataFrame) -> DataFrame:
    """id, no: the lines (numbered from 0) to remove. rows: id (unique, not null), text (not null).

    Each step is a function of its own, so that nothing holds its shuffle files when release() has them dropped."""
    limits = (SHORT, TILE)
    lines = Stored(with_lines(rows), "lines")
    dealt = lines.df.where("kind = 0").select("d1", "d2", "id", "no").repartition("d1").sortWithinPartitions("d1")
    first = Stored(dealt.mapInArrow(lean(first_lines), "d1 bigint, id bigint, no bigint, copy boolean"), "first")
    copies = first.df.where("copy").select("id", "no").unionByName(lines.df.where("kind = 1").select("id", "no"))
    met = Stored(met_lines(rows, lines, limits), "met")
    shown = Stored(shown_lines(rows, met.df, first.df), "shown")
    met.drop()
    near = settled(shown.df, checkpoint(best_proposals(shown.df, limits)), limits)
    shown.drop()
    return copies.unionByName(near)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_removed_lines and kept_text."""
    small_batches(docs.sparkSession)
    # the text is carried once, beside the others
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    packed = docs.select(rest.alias("rest"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    named = packed.where("id is not null")
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        packed = ranked(packed.withColumn("h", F.xxhash64("text")), ["id", "h"])[0].select("rest", F.when(F.col("id").isNotNull(), F.col("rank")).alias("id"), "text")
        named = packed.where("id is not null")
    gone = duplicate_lines(named.select("id", F.coalesce("text", F.lit("")).alias("text"))).groupBy("id").agg(F.collect_set("no").alias("gone"))
    release(docs.sparkSession)
    joined = packed.join(gone.hint("shuffle_hash"), "id", "left")
    text_ = F.coalesce("text", F.lit(""))
    # the lines are bound to a name, once, where some go; else only their ends are counted
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("gone", lambda k: k.cast("int")))
    kept = F.get(F.transform(F.array(F.split(text_, "\n")), lambda x: F.array_join(F.transform(stay(x), lambda k: F.get(x, k)), "\n")), F.lit(0))
    count = F.octet_length(text_) - F.octet_length(F.replace(text_, F.lit("\n"), F.lit(""))) + 1
    made = F.struct(count.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
    out = joined.select("rest", "text", made.alias("made"))
    added = ["n_lines", "n_removed_lines", "kept_text"]
    return out.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c not in added], *[F.col(f"made.{c}").alias(c) for c in added])
