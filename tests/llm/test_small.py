"""Each operator on small tables: results by brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillet.llm.bytesview import SLICE_BYTES
from quillet.llm import bytesview, chunks, decontaminate, hilbert, licenses, linejoin, ngramjoin, pages, quality, queries, rarity, sentencepieces, substrings
from quillet.session import ROOT, Stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(400)]


def vary(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "Two words", "x" * 5000, "é ß " * 300]
    base = [rng.choice(WORDS) for _ in range(90)]
    for edits in (0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 10, 12):
        texts += [" ".join(vary(base, rng, edits)) for _ in range(4)]
    passage = " ".join(rng.choice(WORDS) for _ in range(70))
    for _ in range(12):
        a, b = ([rng.choice(WORDS) for _ in range(rng.randrange(5, 60))] for _ in range(2))
        texts.append(" ".join(a) + "\n" + passage + "\n" + " ".join(b))
    texts += ["ab" * 400, "ab" * 300, " ".join(rng.choice(WORDS) for _ in range(3000))]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [100, 1000, 1 << 20])
def test_op7(docs, rows, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_op7_search_alone_is_whole(docs, rows, block, monkeypatch):
    """Without leaders, the T-occurrence search finds all links itself, within blocks or across them."""
    monkeypatch.setattr(ngramjoin, "leaders", lambda entries: entries.selectExpr("id", "id as leader").limit(0))
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "ASKED", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_op7_stores_few_files(spark, rows, monkeypatch):
    """What is stored has files by its size, not one for each partition of the input; whole texts aren't stored."""
    files = {}

    class Counted(Stored):
        def __init__(self, df, name="t"):
            super().__init__(df, name)
            files[name] = len(list(Path(self.path.removeprefix("file:")).glob("part-*"))), "text" in df.columns

    monkeypatch.setattr(ngramjoin, "Stored", Counted)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(24)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    assert max(n for n, _ in files.values()) <= 6 and not any(whole for _, whole in files.values()), files


def test_op7_rows_of_one_id(spark):
    """Rows of one id with different texts are documents of their own; long texts; other columns don't matter."""
    long = " ".join(random.Random(5).choices(WORDS, k=300_000))
    near = long.replace("w7 ", "v ", 200)
    assert len(long) > 1 << 20
    base = [" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(3)]
    rows = [(5, base[0]), (5, base[1]), (6, base[0] + " x"), (2, base[1] + " y"), (9, base[2]), (9, base[2]), (None, base[2]), (11, long), (12, near), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(1) for n in ("id", "rank", "h", "key", "comp", "component_id", "n_shingles")})
    got = Counter((r.doc_id, r.component_id) for r in ngramjoin.jaccard_components(docs).collect())
    assert got == Counter([(5, 5), (6, 5), (5, 2), (2, 2), (9, 9), (9, 9), (None, None), (11, 11), (12, 11), (13, 13)])


def test_op7_edges(spark, none):
    assert ngramjoin.jaccard_components(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "x"), (4, "a b c"), (4, "a b c"), (2, "A  b\tC"), (3, None)], "doc_id bigint, text string")
    assert sorted(ngramjoin.jaccard_components(odd).collect(), key=str) == sorted([(None, 1, None), (None, 1, None), (4, 1, 2), (4, 1, 2), (2, 1, 2), (3, 0, 3)], key=str)


def test_rarity_at_any_size():
    """Rare tokens in full buckets aren't taken for frequent ones; frequent tokens are, and are ordered by count."""
    from quillet.llm import rarity

    rng = np.random.default_rng(0)
    for usual in (0, 150, 10_000_000):
        counts = rng.poisson(usual, 1 << rarity.BITS)
        counts[7] += 1_000_000
        counts[8] += 300_000
        own = rarity.ranks(counts, 64)
        assert own[7] > own[8] > 0 and (own > 0).sum() < 100
    counter = rarity.Counter()
    tokens = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    counter.add(tokens)
    parts, pieces = counter.pieces()
    total = np.zeros((rarity.PARTS, (1 << rarity.BITS) // rarity.PARTS), np.int64)
    for k, piece in zip(parts, pieces, strict=True):
        total[k] = np.frombuffer(piece, "<u4")
    assert (total.ravel() == np.bincount((tokens >> np.uint64(64 - rarity.BITS)).astype(np.int64), minlength=1 << rarity.BITS)).all()


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_divide_skip(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 60))) for _ in range(8)]
        times = Counter(i for x in lists for i in x.tolist())
        assert ngramjoin.divide_skip(lists, threshold) == sorted(i for i, n in times.items() if n >= threshold)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 60, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:400], rng.integers(0, 1 << 60, 90).astype(np.uint64)]))
    s = ngramjoin.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert 0 < np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def brute_lines(rows, min_tokens=1):
    out, sets = {}, []
    for i, text, *_ in sorted(r for r in rows if r[0] is not None):
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            s = frozenset(words_of(x))
            if len(s) >= min_tokens:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in sets):
                    sets.append(s)
                    continue
                sets.append(s)
            kept.append(x)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("count", "short"), [(1000, 64), (3, 64), (3, 2), (1000, 2)])
def test_op5(spark, rows, count, short, monkeypatch):
    # these are read on the driver and sent along
    for name, value in (("MIN_COUNT", count), ("SHORT", short), ("TILE", 3), ("BLOCK", 20)):
        monkeypatch.setattr(linejoin, name, value)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(30)]
    extra = [(1000 + k, "\n".join(" ".join(vary(base, rng, rng.randrange(6))) for _ in range(3)), "en", "s", 1) for k in range(15)]
    table = spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.kept_text or "") for r in linejoin.dedup_lines(table).collect()}
    assert got == brute_lines([*rows, *extra])


def test_op5_edges(spark, none):
    """Null ids and texts; rows that repeat an id, with equal and with other texts; long texts; columns with the names of added and inner ones."""
    assert linejoin.dedup_lines(none).count() == 0
    long = "\n".join(" ".join(random.Random(k).choices(WORDS, k=12)) for k in range(30_000))
    assert len(long) > 1 << 20
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (1, "f g h\ni"), (2, None), (2, "i\nf g h"), (3, long), (4, long), (5, "")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in ("row", "rest", "id", "gone", "__gone", "__id", "lines", "n_lines", "rank", "h", "no")})
    got = linejoin.dedup_lines(odd).collect()
    assert all(r[n] == n for r in got for n in ("row", "rest", "id", "gone", "__gone", "__id", "lines", "rank", "h", "no"))
    n = long.count("\n") + 1
    kept = Counter((r.doc_id, r.n_lines, r.n_removed_lines, r.kept_text) for r in got)
    assert kept == Counter([(None, 1, 0, "a b c d e"), (1, 1, 0, "a b c d e"), (1, 1, 1, ""), (1, 2, 0, "f g h\ni"), (2, 1, 0, None), (2, 2, 2, ""), (3, n, 0, long), (4, n, n, ""), (5, 1, 0, "")])


def test_op5_entries_move_in_buckets(spark, rows, monkeypatch):
    """Spark moves a row for each bucket of a task, not for each list entry; all entries of a key come out together."""
    monkeypatch.setattr(linejoin, "BUCKETS", 8)
    texts = spark.createDataFrame([(r[1] or "",) for r in rows] * 3, "text string").coalesce(1)
    moved = linejoin.line_prefixes(texts, rarity.Rarity(np.zeros(1 << rarity.BITS, np.uint8))).sort("bucket")
    got = moved.collect()
    entries = [tuple(x) for r in got for x in np.frombuffer(r.entries, np.int64).reshape(-1, 4).tolist()]
    assert len({r.bucket for r in got}) == len(got) <= 8 and len(entries) > 8 * len(got)
    batches = pa.Table.from_pylist([r.asDict() for r in got], schema=pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])).to_batches(2)
    out = pa.Table.from_batches(linejoin.opened(iter(batches))).to_pylist()
    assert sorted(tuple(r.values()) for r in out) == sorted(entries)
    keys = [r["key"] for r in out]
    assert len(set(keys)) == 1 + sum(a != b for a, b in zip(keys, keys[1:], strict=False))


@pytest.mark.parametrize("brief", [2, 1 << 30])
def test_op5_lists_compare_what_fits(brief, monkeypatch):
    """Entries of a list that can't link by their sizes and places aren't compared pair by pair; those that pass are all found, with whom they meet."""
    rng = np.random.default_rng(1)
    n = rng.integers(5, 400, 3000)
    place = (rng.random(3000) * (n - linejoin.need(n) + 1)).astype(np.int64)
    key = np.sort(rng.choice(np.array([-9, -2, 3, 8]), 3000, p=[0.1, 0.4, 0.001, 0.499]))
    d1, sketch = rng.integers(-(1 << 62), 1 << 62, 3000), np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 1 << 40, 3000))
    rows = np.stack([key, d1, n << 32 | place, sketch])
    rows = rows[:, np.sort(np.concatenate([np.arange(3000), rng.integers(0, 3000, 500)]))]  # with copies from other tasks
    one = {"key": key, "n": n, "place": place, "sketch": sketch.view(np.uint64)}
    fit = linejoin.passes({k: v[:, None] for k, v in one.items()}, {k: v[None, :] for k, v in one.items()}) & (key[:, None] == key)
    np.fill_diagonal(fit, False)
    others = (fit * bytesview.mix(d1.view(np.uint64))[None, :]).sum(1, dtype=np.uint64)
    expected = sorted((k, d, x) for k, d, x, m in zip(key.tolist(), d1.tolist(), others.view(np.int64).tolist(), fit.any(1).tolist(), strict=True) if m)
    tested, passes = [], linejoin.passes
    monkeypatch.setattr(linejoin, "passes", lambda x, y: tested.append(np.broadcast(x["n"], y["n"]).size) or passes(x, y))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=linejoin.FIELDS)
    got = pa.Table.from_batches(linejoin.meeting(iter([batch.slice(k, 700) for k in range(0, 3500, 700)]), brief, 64)).to_pylist()
    assert expected and sorted(tuple(r.values()) for r in got) == expected
    assert sum(tested) < 0.1 * (key[:, None] == key).sum() / 2


def test_workers_give_memory_back():
    """What a task held in small pieces leaves the process at its end, also below a piece that stays."""
    code = """
import numpy as np, re, sys
from quillet.session import lean
mb = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
kept = []
def work(batches):
    held = [np.ones(8_000) for _ in range(4_000)]
    kept.append(np.ones(8_000))
    yield mb()
before = mb()
most, = (lean(work) if sys.argv[1] == "lean" else work)(iter(()))
print(most - before, mb() - before)
"""
    for kind in ("lean", "plain"):
        held, left = map(int, subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
        assert held > 200 and (left < 50) == (kind == "lean")


def test_filled():
    every = np.arange(256, dtype=np.uint8)
    assert (bytesview.filled(every) == bytesview.NOT_SPACE).all()


@pytest.mark.parametrize("count", [1000, 3])
def test_op5_short_lines(spark, count, monkeypatch):
    """Lines of 1 to 4 words link with equal sets, and those of 4 also with one that has a word more."""
    monkeypatch.setattr(linejoin, "MIN_COUNT", count)
    rng = random.Random(7)
    rows = [(1, "Les.\nand so\n\na b c\nd e f g"), (2, "les.\nSO and so\n\na b c d\nd x e f g"), (3, "p q r s t\np q r s\na c b\n \nh i j"), (4, "Les."), (5, None), (6, "h i j k")]
    rows += [(100 + k, "\n".join(" ".join(rng.choices(WORDS[:7], k=rng.randrange(7))) for _ in range(6))) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.kept_text or "") for r in linejoin.dedup_lines(table).collect()}
    assert got == brute_lines(rows, min_tokens=1)
    assert got[2] == (5, 3, "\na b c d") and got[3][2] == "p q r s t\n \nh i j" and got[4] == (1, 1, "") and got[6][1] == 0


def brute_repeats(rows, length):
    seen = Counter()
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for b in raw.values():
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_op2(docs, rows, hot):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(substrings.repeat_spans(docs, hot=hot)).collect()}
    assert got == brute_repeats(rows, 200)


def test_op2_edges(spark, none):
    assert substrings.repeat_spans(none).count() == 0
    text = "".join(chr(97 + (k * k) % 26) for k in range(230))
    twice = spark.createDataFrame([(1, text), (1, text), (None, "x" * 199), (2, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.digest(substrings.repeat_spans(twice)).collect()), key=str)
    assert got == [(1, 230, 230, 1), (1, 230, 230, 1), (2, 0, 0, 0), (None, 199, 0, 0)]


def test_op2_columns_and_long_texts(spark):
    """Repeated rows and ids, null ids, texts above a slice, several slices in a batch, and columns with the names of added and inner ones."""
    long = " ".join(random.Random(6).choices([f"q{k}" for k in range(50_000)], k=60_000))
    part = long[200_000:200_300]
    rows = [(1, long), (1, "p" * 150 + part), (1, "p" * 150 + part), (None, "short"), (2, None), (3, long[-100_000:] + "z"), (4, "r" * 90 + "s")]
    names = ("gone", "row", "rest", "id", "m", "n_spans", "pieces", "__id")
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).withColumns({n: F.lit(n) for n in names})
    got = substrings.remove_repeats(table).collect()
    assert len(long) > 2 * SLICE_BYTES and all(r[n] == n for r in got for n in names if n != "n_spans")
    texts = [t for _, t in rows]
    windows = Counter(t[k : k + 200] for t in texts if t for k in range(len(t) - 199))
    for r in got:
        raw, stay = r.text or "", [True] * len(r.text or "")
        for k in range(len(raw) - 199):
            if windows[raw[k : k + 200]] > 1:
                stay[k : k + 200] = [False] * 200
        assert bytes(r.kept_text).decode() == "".join(c for c, s in zip(raw, stay, strict=True) if s) and r.n_removed == stay.count(False)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(3)
    buf = np.concatenate([rng.integers(97, 99, 3000), np.zeros(8, int)]).astype(np.uint8)
    buf[1000:1400] = buf[:400]
    starts, raw = np.arange(2900), buf.tobytes()
    group = np.zeros(len(starts), np.int64)
    order, same = substrings.deep_shallow(buf, starts, group, 60)
    strings = [raw[s : s + 60] for s in starts[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(same, same[1:], strict=False)] == [a == b for a, b in zip(strings, strings[1:], strict=False)]


def test_op3(docs, rows, none, spark):
    got = hilbert.hilbert_shards(docs)
    by_id = {r.doc_id: r for r in got.collect()}
    assert len(by_id) == len(rows) and {r.law for r in by_id.values()} == {"rows"}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32, by_id[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)
    slots = defaultdict(list)
    for r in by_id.values():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert hilbert.hilbert_shards(none).count() == 0
    assert hilbert.hilbert_shards(spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)).count() == 3
    assert hilbert.shard_ranges(got).count() == 16


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (4, 2), (3, 3)])
def test_hilbert_curve_is_one(spark, dims, bits):
    """Every cell has a place of its own, neighbours on the curve differ by one step in one dimension, and aligned runs of 2**dims cells fill a box."""
    names = [f"x{k}" for k in range(dims)]
    grid = spark.range(1 << dims * bits).selectExpr(*[f"int(shiftright(id, {k * bits}) & {(1 << bits) - 1}) as {n}" for k, n in enumerate(names)])
    path = {r.h: tuple(r[n] for n in names) for r in hilbert.curve_index(grid, names, bits, "h").collect()}
    assert sorted(path) == list(range(1 << dims * bits)) and len(set(path.values())) == len(path)
    assert all(sum(abs(p - q) for p, q in zip(path[h], path[h + 1], strict=True)) == 1 for h in range(len(path) - 1))
    assert all(len({tuple(v >> 1 for v in path[h]) for h in range(lo, lo + (1 << dims))}) == 1 for lo in range(0, len(path), 1 << dims))


def test_op3_follows_the_curve(spark, docs, rows):
    """Shards are runs of equal counts along (curve, id), and cells are quantiles that keep the order of each dimension."""
    got = hilbert.hilbert_shards(docs).collect()
    placed = sorted(got, key=lambda r: (r.hilbert, r.doc_id))
    assert [(r.shard, r.slot) for r in placed] == [(k * 16 // len(rows), k - (-(-(k * 16 // len(rows)) * len(rows) // 16))) for k in range(len(rows))]
    of = {r[0]: {"d_lang": r[2], "d_source": r[3], "d_size": len((r[1] or "").encode()), "d_id": r[0]} for r in rows}
    for name in hilbert.DIMENSIONS:
        own = sorted((of[r.doc_id][name], r[name]) for r in got)
        assert all(x[1] <= y[1] and (x[0] != y[0] or x[1] == y[1]) for x, y in zip(own, own[1:], strict=False))
    sizes = Counter(r.d_id for r in got)
    assert len(sizes) == 16 and max(sizes.values()) <= 2 * len(rows) / 16


def test_op3_files_are_pruned(spark, tmp_path, docs, rows):
    """What a reader of one corner of the grid opens is a part of the shards, and all rows come back in curve order."""
    clash = docs.withColumn("slot", F.lit("s"))
    assigned = hilbert.hilbert_shards(clash)
    hilbert.write_shards(clash, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] for r in rows} and {"d_id", "d_size", "shard"} < set(back.columns)
    ranges = hilbert.shard_ranges(assigned).collect()
    corner = [r.shard for r in ranges if r.min_d_id <= 3 and r.min_d_size <= 3]
    assert {r.shard for r in back.where("d_id <= 3 and d_size <= 3").collect()} <= set(corner) and len(corner) <= 8
    assert sum(r.rows for r in ranges) == len(rows) and sum(r.bytes for r in ranges) == sum(len((r[1] or "").encode()) + 1 for r in rows)


def test_op3_edges(spark):
    """Null and repeated ids, long texts, other columns with inner names."""
    long = "x y " * 400_000
    rows = [(None, long, None, "a", 1), (1, "t", "en", None, 1), (1, "t", "en", None, 1), (2, None, "en", "b", 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in ("shard", "slot", "hilbert", "d_id", "__at", "rank", "size")})
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in hilbert.hilbert_shards(table).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def brute_hits(text, items):
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))
    w = find(text)
    hit, found = set(), set()
    for item, benchmark in items:
        b = find(benchmark)
        for window in [b[k : k + 10] for k in range(max(1, len(b) - 9))] if b else []:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
    ids = sorted(map(str, found))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_op6(spark, docs, rows, block):
    long = rows[30][1].split()
    items = [(1, " ".join(long[5:30]).upper()), (2, "one"), (3, None), (4, "..."), (5, "é, ß É"), (10, "ONE"), (12, " ".join(long[20:31]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    marked = decontaminate.mark_benchmark(docs, benchmark, block_bytes=block)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(marked).collect()}
    assert got == {r[0]: brute_hits(r[1], items) for r in rows}
    clean = decontaminate.remove_contaminated(docs.withColumnRenamed("n_chars", "n_words"), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in got.items() if not x[-1]) and "n_words" in clean.columns
    cut = decontaminate.remove_spans(docs, benchmark)
    assert decontaminate.mark_benchmark(cut, benchmark).where("doc_id = 3").first().n_hit == 0 and cut.columns == docs.columns


def test_op6_edges(spark, none, docs):
    """Empty tables; null and repeated item ids; items of several pieces; long texts; repeated rows; columns with the names of added and inner ones."""
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.mark_benchmark(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.mark_benchmark(none, empty).count() == 0
    words = [f"v{k}" for k in range(200_000)]
    long = " ".join(words[:150_000]) + " x " + " ".join(words[150_000:])
    items = [(None, "none of these"), (7, "none of these"), (7, "and more"), (None, "and that"), (8, " ".join(words[4080:9000])), (9, None)]
    rows = [(1, "None of these."), (1, "None of these."), (2, "and that"), (None, "x and more"), (3, long), (4, None)]
    clash = {n: F.lit(n) for n in ("row", "scanned", "n_hit", "item_ids", "c0", "gone", "item")}
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash)
    for block in (1 << 20, 2000):
        marked = decontaminate.mark_benchmark(odd, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.row, r.item) for r in marked.collect())
        assert got == Counter({(1, 3, 3, (None, 7), "row", "item"): 2, (2, 2, 2, (None,), "row", "item"): 1, (None, 3, 2, (7,), "row", "item"): 1, (3, 200_001, 4920, (8,), "row", "item"): 1, (4, 0, 0, (), "row", "item"): 1})
    assert len(long) > 1 << 20
    assert [(r.doc_id, r.n_hit) for r in decontaminate.remove_contaminated(odd, spark.createDataFrame(items, "item_id bigint, text string")).collect()] == [(4, "n_hit")]


def test_op6_block_is_bounded():
    """A full block: its arrays hold some 40 bytes a window besides the text."""
    rng = np.random.default_rng(0)
    text = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 20, 200_000).tolist()).encode()
    grams = decontaminate.Grams([(1, text, 200_000)], 10)
    size = sum(x.nbytes for own in grams.by_length.values() for x in own)
    assert size < 45 * 200_000 and len(grams.by_length[10][0]) == 200_000 - 9


def brute_chunk_runs(raw):
    """Begins and ends of the runs of a text, byte by byte, with a hash of its own making."""
    cuts, last = [0], -1
    for end in range(1, len(raw)):
        h = 0
        for x in raw[max(0, end - 16) : end]:
            h = (2 * h + int(chunks.GEAR[x])) % 65536
        if end >= 16 and h < 65536 >> chunks.MASK_BITS:
            if last < 0 or end - last >= chunks.APART:
                cuts.append(end)
            last = end
    cuts.append(len(raw))
    full = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in range(a, b, chunks.MAX_BYTES)] + [len(raw)]
    if len(raw) < chunks.RUN_BYTES:
        return [(0, len(raw))] if raw else []
    found = set()
    for a in full:
        if a + chunks.RUN_BYTES <= len(raw):
            found.add((a, min(x for x in full if x >= a + chunks.RUN_BYTES)))
    return sorted(found | {(max(x for x in full if x + chunks.RUN_BYTES <= len(raw)), len(raw))})


def brute_chunk_dedup(rows):
    """Which bytes stay, of rows (id, text) with different ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        stay = [True] * len(raw)
        for a, b in brute_chunk_runs(raw):
            run = (raw[a:b], b - a < chunks.RUN_BYTES)
            if run in seen:
                stay[a:b] = [False] * (b - a)
            seen.add(run)
        out[i] = bytes(x for x, k in zip(raw, stay, strict=True) if k)
    return out


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_op8(docs, rows, none, block, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", block)
    got = {r.doc_id: r for r in chunks.dedup_chunks(docs).collect()}
    want = brute_chunk_dedup([r[:2] for r in rows])
    assert {i: bytes(r.kept_text) for i, r in got.items()} == want
    assert any(r.n_spans for r in got.values()) and all(r.n_removed == r.n_bytes - len(r.kept_text) for r in got.values())
    assert chunks.dedup_chunks(none).count() == 0


def test_op8_wholes(spark, tmp_path):
    """Exact copies go as wholes, short ones too; a short text within another stays; passages go but for their ends; clean texts stay."""
    long, other, third = (" ".join(random.Random(k).choices(WORDS, k=200)) for k in range(3))
    passage = " ".join(random.Random(9).choices(WORDS, k=80))
    rows = [(1, "By be in."), (2, "By be in."), (3, long), (4, long), (5, other + "\n" + passage), (6, None), (7, "By be in, no."), (8, third + "\n" + passage + "\n" + long[:100]), (9, "By be in. " + third[:90])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in queries.op8_chunk_dedup(spark, str(tmp_path)).collect()}
    size = {i: len((t or "").encode()) for i, t in rows}
    assert {i: x for i, x in got.items() if i != 8} == {i: (n, n if i in (2, 4) else 0) for i, n in size.items() if i != 8}
    assert 0.6 * len(passage) < got[8][1] <= len(passage) + 2


def test_op8_edges(spark):
    """Equal rows of one id: one stays. Rows of one id with different texts, null ids, long texts, and columns with the names of added ones."""
    long = " ".join(random.Random(5).choices(WORDS, k=400_000))
    rows = [(1, long, 7), (1, long, 7), (2, long, 8), (1, "short", 9), (None, "short", 1), (None, None, 2), (3, "", 3)]
    names = "doc_id bigint, text string, n_spans int"
    docs = spark.createDataFrame(rows, names).withColumns({"gone": F.lit("g"), "__id": F.lit(1), "row": F.lit(2), "rest": F.lit(3), "doc": F.lit(4), "key": F.lit(5)})
    got = chunks.dedup_chunks(docs).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "gone", "__id", "row", "rest", "doc", "key").collect()
    assert len(long) > 1 << 20 and all(tuple(r[5:]) == ("g", 1, 2, 3, 4, 5) for r in got)
    whole = Counter((r.doc_id, len(r.text or ""), r.n_removed, r.n_spans) for r in got)
    n = len(long)
    assert whole == Counter([(1, n, 0, 0), (1, n, n, 1), (2, n, n, 1), (1, 5, 5, 1), (None, 5, 0, 0), (None, 0, 0, 0), (3, 0, 0, 0)])


def test_chunks_resist_shifts():
    import pyarrow as pa
    from quillet.llm.bytesview import slices

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    parts = []
    for x in (text, text[:500] + "inserted" + text[500:]):
        ends = next(chunks.edges(t).tolist() for t in slices(pa.array([x])))
        parts.append({x[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)})
        assert all(b - a <= chunks.MAX_BYTES for a, b in zip(ends[:-1], ends[1:], strict=True))
    assert len(parts[0] & parts[1]) > 0.95 * len(parts[0])


def test_op9(docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    for r in sentencepieces.encode_spans(docs, queries.model_path()).collect():
        text = r.text or ""
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        assert not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(text.encode()))
        assert all(a == b for a, b in zip(r.ends, r.begins[1:], strict=False))


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "tab\tnew\nline", "▁mark ▁", "日本語 🙂", "  ", "a b c", "<s> </s>", "\x00x"])
def test_pieces_by_word(text):
    model = sentencepieces.load(queries.model_path())
    assert model.by_word and model.encode([text]) == [model.library.encode(text)]
    spans = model.spans(text.encode(), np.array(model.encode([text])[0]))
    raw = text.encode()
    for k, i in enumerate(model.encode([text])[0]):
        piece = model.library.id_to_piece(i)
        if not piece.startswith("<0x"):
            shown = raw[spans[k] : spans[k + 1]].decode().replace(" ", "▁")
            assert shown == piece or k == 0 and "▁" + shown == piece


def test_character_map():
    """A trie that leads ab to X and a to Y, built as the format says."""
    units = [0] * 600
    root = 256
    units[0] = root << 10
    a = root ^ ord("a")
    child = 300
    units[a] = (a ^ child) << 10 | 1 << 8 | ord("a")
    units[child] = 1 << 31 | 2
    b = child ^ ord("b")
    leaf = 400
    units[b] = (b ^ leaf) << 10 | 1 << 8 | ord("b")
    units[leaf] = 1 << 31
    import struct

    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"X\0Y\0"
    m = sentencepieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"X") and m.longest(b"ac", 0) == (1, b"Y") and m.longest(b"c", 0) is None


def message(*fields):
    """A protobuf message of (number, value): bytes, whole numbers or floats."""
    import struct

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def mapped_model(path, kinds):
    """A small model whose character map leads ab to X and a to Y."""
    import struct

    units = [0] * 768
    units[0] = 256 << 10
    a, child = 256 ^ ord("a"), 300
    units[a] = (a ^ child) << 10 | 1 << 8 | ord("a")
    units[child] = 1 << 31 | 2
    b, leaf = child ^ ord("b"), 400
    units[b] = (b ^ leaf) << 10 | 1 << 8 | ord("b")
    units[leaf] = 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"X\0Y\0"
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("X", -3.0, 1), ("Y", -3.5, 1), ("▁X", -2.5, 1), ("c", -4.0, 1), ("Yc", -4.5, 1), *kinds]
    proto = message(*((1, message((1, x.encode()), (2, score), (3, kind))) for x, score, kind in pieces), (2, message((3, 1), *([(35, 1)] if kinds else []))), (3, message((1, b"own"), (2, blob), (3, 1), (4, 1), (5, 1))))
    path.write_bytes(proto)
    return str(path)


@pytest.mark.parametrize("bytes_", [True, False])
def test_op9_spans_through_a_map(spark, tmp_path, bytes_):
    """Spans by the character map equal the offsets that the library gives; a model without byte pieces takes unknown characters too."""
    import sentencepiece

    path = mapped_model(tmp_path / "m.model", [(f"<0x{k:02X}>", -9.0, 6) for k in range(256)] if bytes_ else [])
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.load(path)
    texts = ["abc", "ac ab", "  a  abab c ", "c", "", None, "ab" * 400, "aß日c z", "zq ab ß", "ab\u2581c"]
    got = sentencepieces.encode_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)), path).collect()
    assert model.map.longest(b"abc", 0) == (2, b"X") and len(got) == len(texts)
    for r in got:
        raw = (r.text or "").encode()
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        if not bytes_ or set(raw) <= set(b"abc "):
            found = library.encode(r.text or "", return_type="proto").pieces
            assert r.begins == [p.begin for p in found] and r.ends[-1:] == [p.end for p in found[-1:]]
        assert not r.ids or (r.begins[0] == 0 or raw[:1] == b" ") and r.begins == sorted(r.begins) and r.ends[-1] <= len(raw)


def test_op9_edges(spark, none):
    """Empty tables, repeated rows, null ids, texts above a slice, a batch of several slices, and columns with the names of added ones."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    long = " ".join(random.Random(4).choices(WORDS, k=300_000)) + "  end \U0001F642"
    rows = [(1, long), (1, "twice"), (1, "twice"), (None, "no id"), (2, None), (3, ""), (4, long[:200_000]), (5, long[100_000:350_000])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).withColumns({n: F.lit(n) for n in ("ids", "decoded", "c0", "spans")})
    got = sentencepieces.encode_spans(table, queries.model_path()).collect()
    assert len(long) > 1 << 20 and Counter((r.doc_id, tuple(r.ids), r.decoded, r.c0) for r in got) == Counter((i, tuple(x := library.encode(t or "")), library.decode(x), "c0") for i, t in rows)
    assert sentencepieces.digest(sentencepieces.encode_spans(none, queries.model_path())).count() == 0


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def test_op10(spark, rows):
    more = [*rows, (900, "a b a b a b\nx y\nx y\n\n<#>", "en", None, 1), (901, " ".join(WORDS[:60]) + "\nhot line of this host", "en", "s0", 1)]
    extra = [(2000 + k, " ".join(random.Random(k).choices(WORDS, k=55)) + "\nhot line of  THIS host", "en", "s0", 1) for k in range(12)]
    table = spark.createDataFrame([*more, *extra], SCHEMA)
    judged = quality.assess(table)
    got = {r.doc_id: (*(r[c] for c in quality.BASE), r.base_failed) for r in judged.collect()}
    assert got == {r[0]: brute_base(r[1]) for r in [*more, *extra]}
    state = {r.doc_id: (r.removed_chars, r.kept) for r in judged.collect()}
    assert state[2003] == (len("hotlineofthishost"), True) and state[901][0] == 17
    kept = {r.doc_id: r for r in quality.apply_rules(table).collect()}
    assert "THIS" not in kept[2003].text and kept[2003].n_chars == len(kept[2003].text) and 900 not in kept
    assert quality.apply_rules(table.limit(0)).count() == 0 and quality.apply_rules(table).columns == table.columns


def brute_rules(rows):
    """doc_id: text of what apply_rules keeps, of rows (id, text, lang, host, n) with different ids."""
    filled = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    seen, docs = defaultdict(set), Counter(r[3] for r in rows)
    for i, text, _, host, _ in rows:
        for x in filled(text):
            seen[host, norm(x)].add(i)
    boiler = {k for k, v in seen.items() if len(v) > max(10, 0.1 * docs[k[0]])}
    out = {}
    for i, text, _, host, _ in rows:
        base = brute_base(text)
        lost = sum(len("".join(words_of(x))) for x in filled(text) if (host, norm(x)) in boiler)
        if not base[-1] and lost <= 0.5 * base[1]:
            out[i] = "\n".join(x for x in text.split("\n") if x not in filled(text) or (host, norm(x)) not in boiler)
    return out


def test_op10_edges(spark):
    """Columns with the names of added and inner ones, null hosts and ids, repeated rows, long texts."""
    long = " ".join(random.Random(3).choices([f"u{k}" for k in range(100_000)], k=250_000))
    assert len(long) > 1 << 20
    rows = [(k, " ".join(random.Random(k).choices(WORDS, k=60)) + "\nsame line in all of them", "en", None, 1) for k in range(15)] + [(20, long, "en", "s", 1), (None, long + " z", "en", "s", 1)]
    clash = {n: F.lit(n) for n in ("__lines", "__text", "row", "host", "of", "boiler", "kept", "n_words", "cleaned", "h")}
    table = spark.createDataFrame([*rows, rows[0]], SCHEMA).withColumns(clash)
    judged = quality.assess(table).collect()
    assert len(judged) == len(rows) + 1 and all(r["__lines"] == "__lines" and r["row"] == "row" and r["of"] == "of" and r.kept for r in judged)
    kept = quality.apply_rules(table)
    assert kept.columns == table.columns
    want = Counter(brute_rules(rows).items())
    want[0, brute_rules(rows)[0]] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_op10_depleted(spark):
    line = " ".join(WORDS[:60])
    table = spark.createDataFrame([(k, line, "en", "s", 1) for k in range(40)] + [(99, " ".join(WORDS[100:200]), "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in quality.assess(table).where("kept").collect()] == [99]


def test_op10_stays_native(docs):
    plan = quality.assess(docs)._jdf.queryExecution().toString() + hilbert.hilbert_shards(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><div id="top" class="site-header"><ul><li><a href=/>Home</a></ul></div><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title {k}</h1></header><p>First &amp; <b>bold{k}</b> text<br>after <p>Second {k}<ul><li>one {k}<li>two</ul><form><input>Mail</form><div class=ad>Buy {k}</div></article>
<section class="comments"><p>Nice {k}!</p></section></main><aside>Related</aside><p>Copyright Host</p><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_op1(spark):
    table = spark.createDataFrame([(k, f"http://h.example/{k}", PAGE.format(k=k)) for k in range(20)] + [(50, None, "<p>alone"), (51, "http://h.example/n", None), (52, "x", ""), (53, "http://h.example/d", "<b>" * 3000 + "deep")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.main_text(table).collect()}
    assert got[3][0] == "Title 3\n\nFirst & bold3 text after\n\nSecond 3\n\none 3\n\ntwo" and got[3][1] == len(got[3][0])
    assert got[50] == ("alone", 5) and got[51] == got[52] == ("", 0) and got[53] == ("deep", 4)
    assert pages.main_text(table.limit(0)).count() == 0
    joined = {r.page_id: r.text for r in pages.main_text(table, broadcast_bytes=-1).collect()}
    assert joined == {k: v[0] for k, v in got.items()}


def test_op1_edges(spark, monkeypatch):
    """Columns with the names of added and inner ones, repeated rows, null ids and urls, a host over several tasks, deep and long pages."""
    monkeypatch.setattr(pages, "SHARE", 3)
    deep = "<div class=x>" * 20_000 + "<nav>Menu</nav><p>Low {k}</p>"
    long = "<article>" + "".join(f"<p>{' '.join(random.Random(k).choices(WORDS, k=2000))}</p>" for k in range(150)) + "</article>"
    assert len(long) > 1 << 20
    rows = [(k % 9, "http://a.example/", PAGE.format(k=k % 9)) for k in range(18)] + [(None, None, "<p>x</p>"), (20, "http://b.example/", deep.format(k=1)), (21, "http://b.example/", deep.format(k=2)), (22, "http://c.example/", long)]
    names = ("host", "page", "refs", "share", "text", "n_named", "h", "r", "c0")
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({n: F.lit(n) for n in names})
    one, two = (Counter((r.page_id, r.text, r.n_chars, r.host, r.page, r.c0) for r in pages.main_text(table, broadcast_bytes=b).collect()) for b in (-1, 1 << 25))
    assert one == two and {x[3:] for x in one} == {("host", "page", "c0")}
    got = {x[0]: x[1] for x in one}
    assert sorted(one.values()) == [1] * 4 + [2] * 9 and got[None] == "x" and got[20] == "Low 1"
    assert got[22] == long[12:-14].replace("</p><p>", "\n\n")


def brute_host(html):
    """Main text of pages without telling tags or names: paragraphs whose text no other page of the host has."""
    texts = {k: re.findall(r"<p>(.*?)</p>", x) for k, x in html.items()}
    times = Counter(t for own in texts.values() for t in set(own))
    return {k: "\n\n".join(t for t in own if times[t] == 1) for k, own in texts.items()}


def test_op1_wrapper_decides(spark):
    """Hosts whose names say nothing, without articles: notices stand at other places of each page. Without references the result is wrong, with them right."""
    story = lambda *k: " ".join(random.Random(str(k)).choices(WORDS, k=12))
    html = {}
    for k in range(12):
        own = [f"<p>{story(k, j)}</p>" for j in range(3 + k % 4)]
        places = sorted(random.Random(k).choices(range(len(own) + 1), k=3), reverse=True)
        for at, notice in zip(places, ("Write to us today", "All rights are ours", "Read this too"), strict=True):
            own.insert(at, f"<p>{notice}</p>")
        html[k] = f"<body><div class=q1><p>Start here</p></div><div class=z{k % 2}>{''.join(own)}</div><div class=q2><p>The end of it</p></div></body>"
    table = spark.createDataFrame([(k, f"http://w.example/{k}", x) for k, x in html.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(table).collect()}
    assert got == brute_host(html)
    alone = {r.page_id: r.text for r in pages.main_text(table, references=0).collect()}
    assert all(alone[k] != got[k] for k in html)


def test_op1_template_without_article(spark):
    page = "<body><div>Welcome to the site</div><div class=x><p>Story {k} tells of things number {k}.</p><p>It goes on {k}.</p></div><div>All about us</div></body>"
    table = spark.createDataFrame([(k, f"http://p.example/{k}", page.format(k=k)) for k in range(9)], "page_id bigint, url string, html string")
    assert pages.main_text(table).where("page_id = 4").first().text == "Story 4 tells of things number 4.\n\nIt goes on 4."


@pytest.mark.parametrize("n", [4, 9, 30])
def test_op1_template_in_article(spark, n):
    """A constant paragraph goes on small and large hosts, also where one page lacks it."""
    page = "<body><article><h1>Title {k} of this</h1><p>{story}</p>{ask}</article></body>"
    story = lambda k: " ".join(random.Random(k).choices(WORDS, k=40))
    html = {k: page.format(k=k, story=story(k), ask="" if k == 1 and n > 4 else "<p>Write to us</p>") for k in range(n)}
    table = spark.createDataFrame([(k, f"http://a.example/{k}", x) for k, x in html.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(table).collect()}
    assert got == {k: f"Title {k} of this\n\n{story(k)}" for k in html}


def test_op1_whole_text(spark):
    """A title beside the story, two parts, several articles, and names that are topics."""
    parts = {
        "a": "<body><div>All about this site</div><h1>Title {k}</h1><div><p>{s}</p></div><div><p>Then {k} {s}</p></div></body>",
        "b": "<body><div><article><h1>One {k}</h1><p>{s}</p></article><h2>Between {k}</h2><article><p>Two {k}</p></article></div></body>",
        "c": "<body><article><h2 id=search-algorithms>Search {k}</h2><section id=related-work><p>Work {k} {s}</p></section><div class=share-prices>Prices {k}</div><ul class=share-box><li><a href=/>Send {k}</a></ul><div class=ad>Buy {k}</div></article></body>",
    }
    want = {"a": "Title {k}\n\n{s}\n\nThen {k} {s}", "b": "One {k}\n\n{s}\n\nBetween {k}\n\nTwo {k}", "c": "Search {k}\n\nWork {k} {s}\n\nPrices {k}"}
    story = [" ".join(random.Random(k).choices(WORDS, k=30)) for k in range(6)]
    rows = [(f"{x}{k}", f"http://{x}.example/{k}", page.format(k=k, s=story[k])) for x, page in parts.items() for k in range(6)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {f"{x}{k}": t.format(k=k, s=story[k]) for x, t in want.items() for k in range(6)}


def brute_matching(a, b):
    def weight(x, y):
        if not pages.alike(x, y):
            return 0
        if isinstance(x, str):
            return 1
        p, q = pages.children(x), pages.children(y)
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, u in enumerate(p):
            for j, v in enumerate(q):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(u, v))
        return 1 + best[-1][-1]

    return weight(a, b)


def test_tree_matching():
    a, b = pages.parse("<div><p>x<p>y<ul><li>1<li>2</ul></div>"), pages.parse("<div><p>x<b>z</b><ul><li>1<li>2<li>3</ul><p>q</div>")
    assert pages.weight(a, b, {}) == brute_matching(a, b)


def test_equal_subtrees_are_not_aligned(monkeypatch):
    """Subtrees that two pages share match as node by node, but at once."""
    menu = lambda k: "".join(f"<li><a href=/{j}>{k} {j}</a> <i>of {j % 3}</i>" for j in range(50))
    html = [f"<body><nav><ul>{menu('Go')}</ul></nav><ul>{menu(x)}</ul><p>Story {x}<p>Same<p>{x}</body>" for x in "ab"]
    calls = []
    aligned = pages.aligned
    monkeypatch.setattr(pages, "aligned", lambda *x: calls.append(x) or aligned(*x))
    found = []
    for sealed in (False, True):
        a, b = map(pages.parse, html)
        for root in (a, b):
            pages.seal(root)
            for node in () if sealed else list(pages.nodes(root).values()):
                node.digest = None
        own = pages.nodes(a)
        same, other = [], []
        pages.match(a, b, same, other, {})
        found.append((len(calls), *(sorted(pages.children(own[n])[k] for n, k in x) for x in (same, other))))
        calls.clear()
    assert found[0][1:] == found[1][1:] and len(found[1][1]) == 50 * 3 + 1 and len(found[1][2]) == 50 + 2
    assert found[0][0] > 250 and found[1][0] < 160


def test_op4(spark, docs, rows):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    edited = " ".join(w if k % 25 else "changed" for k, w in enumerate(words))
    texts = [(1, "Released under the MIT License. Then more"), (2, f"# {mit}\ncode"), (3, edited), (4, " ".join(words[: len(words) // 3])), (5, None), (6, ""), (7, "all RIGHTS, reserved?\n" * 2)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = defaultdict(list)
    for r in licenses.license_matches(table).collect():
        got[r.doc_id].append((r.template, round(r.coverage, 2), texts[r.doc_id - 1][1].encode()[r.begin : r.end].decode()))
    assert got[1] == [("mit-line", 1.0, "Released under the MIT License")] and got[2] == [("mit", 1.0, mit.rstrip("."))]
    assert got[3][0][0] == "mit" and 0.8 <= got[3][0][1] < 1 and set(got) == {1, 2, 3, 7}
    assert got[7] == [("all-rights-reserved", 1.0, "all RIGHTS, reserved")] * 2
    assert licenses.license_matches(docs).count() == 0 and licenses.license_matches(table.limit(0)).count() == 0


def brute_licenses(text, coverage=0.8):
    """Templates of which some stretch of the text, as long as the template and a quarter on each side, has `coverage` of the words in order."""
    words = licenses.tokens(text or "")[0]
    out = set()
    for name, template in licenses.TEMPLATES.items():
        own = licenses.tokens(template)[0]
        near = min(licenses.BAND, len(own) // 4)
        for at in range(-near, len(words)):
            piece = words[max(0, at) : at + len(own) + near]
            row = [0] * (len(piece) + 1)
            for w in own:
                row = [0, *(x for x in _lcs(row, piece, w))]
            if row[-1] >= coverage * len(own):
                out.add(name)
                break
    return out


def _lcs(row, piece, word):
    left = 0
    for j, x in enumerate(piece):
        left = max(left, row[j + 1], row[j] + (x == word))
        yield left


def test_op4_against_brute_force(spark, rows):
    """Every template with a fifth of its words replaced is found: recall over edits, against a scan of whole texts. Short templates against brute force."""
    rng = random.Random(8)
    texts, want = [(0, None), (1, "")], {}
    for name, template in licenses.TEMPLATES.items():
        own = template.split()
        count = len(licenses.tokens(template)[0])
        for k in range(4):
            words = list(own)
            for at in rng.sample(range(len(words)), int(count * 0.2 * k / 3)):
                words[at] = "changed"
            i = len(texts)
            texts.append((i, " ".join(rng.choices(WORDS, k=20)) + " " + " ".join(words) + " " + " ".join(rng.choices(WORDS, k=20))))
            if len(licenses.tokens(" ".join(w for w in words if w != "changed"))[0]) >= 0.8 * count:
                want[i] = name
    got = defaultdict(set)
    table = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in ("id", "template", "begin")})
    for r in licenses.license_matches(table).collect():
        got[r.doc_id].add(r.template)
    related = {"gpl-3.0": {"agpl-3.0"}, "agpl-3.0": {"gpl-3.0"}, "lgpl-2.1": {"gpl-3.0", "agpl-3.0"}}  # of overlapping ones that with more matched words stays
    assert all(got[i] & ({name} | related.get(name, set())) for i, name in want.items()) and len(want) > 3 * len(licenses.TEMPLATES)
    small = [(i, t) for i, t in texts if t is None or len(t.split()) < 60]
    assert all(bool(got[i]) == bool(brute_licenses(t)) and got[i] <= brute_licenses(t) for i, t in small)


def test_op4_inserted_sentence(spark):
    """A notice with 20 foreign words put in is one match over both parts; a very long text; null ids and repeated rows."""
    words = licenses.TEMPLATES["isc"].split()
    text = " ".join([*words[:40], *WORDS[:20], *words[40:]])
    long = " ".join(random.Random(1).choices(WORDS, k=300_000)) + " " + licenses.TEMPLATES["zlib"]
    assert len(long) > 1 << 20
    table = spark.createDataFrame([(1, text), (1, text), (None, long)], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.template, r.coverage, r.end - r.begin) for r in licenses.license_matches(table).collect())
    assert got == Counter({(1, "isc", 1.0, len(text) - 1): 2, (None, "zlib", 1.0, len(licenses.TEMPLATES["zlib"]) - 1): 1})


def test_alignment_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        t, x = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))] for _ in range(2)]
        best = [[0] * (len(x) + 1) for _ in range(len(t) + 1)]
        for i, u in enumerate(t):
            for j, v in enumerate(x):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (u == v))
        n, first, last = licenses.align(t, x, -10, 10)
        assert n == best[-1][-1] and (not n or 0 <= first <= last < len(x))
