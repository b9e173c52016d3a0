"""Codecs of posting lists (variable byte, Elias gamma) and of sorted dictionaries (front coding).

Sizes and gaps are column expressions; only the bytes themselves are made in Arrow batches.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.plans.order import numbered, ranged


def vbyte_one(numbers: list[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("variable byte codes need numbers of 0 or more")
        groups = [n & 127]
        while n > 127:
            n >>= 7
            groups.append(n & 127)
        groups[0] |= 128  # the last group written ends the number
        out += bytes(reversed(groups))
    return bytes(out)


def vbyte_back(code: bytes) -> list[int]:
    out, n = [], 0
    for byte in code:
        n = n << 7 | byte & 127
        if byte & 128:
            out.append(n)
            n = 0
    if n:
        raise ValueError("a number has no end")
    return out


def to_gaps(numbers: list[int], add: int = 0) -> list[int]:
    gaps = [b - a for a, b in zip([0, *numbers], numbers, strict=False)]
    if any(g < 0 for g in gaps):
        raise ValueError("numbers must ascend")
    return [g + add for g in gaps]


def from_gaps(gaps: list[int], add: int = 0) -> list[int]:
    out, at = [], 0
    for g in gaps:
        at += g - add
        out.append(at)
    return out


def gamma_bits(n: int) -> str:
    if n <= 0:
        raise ValueError("gamma codes need numbers above 0")
    return "0" * (n.bit_length() - 1) + f"{n:b}"


def gamma_one(numbers: list[int]) -> bytes:
    """A big-endian count of 4 bytes, then the codes' bits, filled up with zeros. No numbers: no bytes."""
    if not numbers:
        return b""
    bits = "".join(map(gamma_bits, numbers))
    bits += "0" * (-len(bits) % 8)
    return struct.pack(">i", len(numbers)) + int(bits, 2).to_bytes(len(bits) // 8, "big")


def gamma_back(code: bytes) -> list[int]:
    if not code:
        return []
    if len(code) < 4:
        raise ValueError("the count is cut off")
    count, bits, at, out = struct.unpack(">i", code[:4])[0], "".join(f"{b:08b}" for b in code[4:]), 0, []
    while len(out) < count:
        one = bits.find("1", at)
        if one < 0 or 2 * one - at + 1 > len(bits):
            break  # what is whole stays
        end = 2 * one - at + 1
        out.append(int(bits[one:end], 2))
        at = end
    return out


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the edges of the lists; null lists are empty here."""
    parts = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in lists]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _gaps(numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.diff(numbers, prepend=0)
    first = edges[:-1][np.diff(edges) > 0]
    out[first] = numbers[first]
    if (out < 0).any():
        raise ValueError("numbers must ascend")
    return out


def _sums(gaps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(gaps)])
    return total[1:] - np.repeat(total[edges[:-1]], np.diff(edges))


def _bit_length(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.int64)
    for k in range(63):
        out += n >> k > 0
    return out


def vbyte_batch(numbers: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Each list's code, all at once: the k-th last bytes of all numbers are set together."""
    if (numbers < 0).any():
        raise ValueError("variable byte codes need numbers of 0 or more")
    size = np.maximum(1, -(-_bit_length(numbers) // 7))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[end[some] - 1 - k] = numbers[some] >> 7 * k & 127 | (128 if k == 0 else 0)
    raw, at = out.tobytes(), np.concatenate([[0], end])[edges].tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def vbyte_batch_back(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all codes, and the edges of the lists."""
    raw = np.frombuffer(b"".join(codes), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    last = raw >= 128
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a and not last[b - 1]:
            return _one_by_one(codes)
    end = np.flatnonzero(last)
    number = np.cumsum(last) - last  # which number each byte is of
    back = end[number] - np.arange(len(raw)) if len(raw) else np.zeros(0, np.int64)
    value = np.zeros(len(end), np.int64)
    np.add.at(value, number, (raw & 127).astype(np.int64) << 7 * back)
    return value, np.concatenate([[0], np.cumsum(last)])[edges]


def _one_by_one(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For codes that end within a number: what vbyte_back says of them."""
    parts = [vbyte_back(c) for c in codes]
    return np.array([n for p in parts for n in p], np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def gamma_batch(numbers: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Each list's code, all at once: the bits of one weight of all numbers are set together."""
    if (numbers <= 0).any():
        raise ValueError("gamma codes need numbers above 0")
    width = _bit_length(numbers)
    bits = np.concatenate([[0], np.cumsum(2 * width - 1)])
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    size = bits[edges[1:]] - bits[edges[:-1]]
    start = np.concatenate([[0], np.cumsum(-(-size // 8) * 8)])  # lists begin at whole bytes
    end = start[of] + bits[1:] - bits[edges[:-1]][of]
    out = np.zeros(int(start[-1]), np.uint8)
    for k in range(int(width.max(initial=0))):
        some = width > k
        out[end[some] - 1 - k] = numbers[some] >> k & 1
    raw, at = np.packbits(out).tobytes(), (start // 8).tolist()
    return [struct.pack(">i", n) + raw[a:b] if n else b"" for n, a, b in zip(np.diff(edges).tolist(), at[:-1], at[1:], strict=True)]


def _encoder(batch, gaps: bool, add: int):
    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        numbers, edges = _flat(column)
        codes = batch(_gaps(numbers, edges) + add if gaps else numbers, edges)
        return pd.Series([None if x is None else c for x, c in zip(column, codes, strict=True)], dtype=object)

    return run


def _decoder(back, gaps: bool, add: int):
    @F.pandas_udf("array<bigint>")
    def run(column: pd.Series) -> pd.Series:
        numbers, edges = back([b"" if c is None else bytes(c) for c in column])
        if gaps:
            numbers = _sums(numbers - add, edges)
        return pd.Series([None if c is None else numbers[a:b] for c, a, b in zip(column, edges[:-1].tolist(), edges[1:].tolist(), strict=True)], dtype=object)

    return run


def _gamma_lists(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.array(gamma_back(c), np.int64) for c in codes]  # a code's length is known when it is read, so one after another
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def running_sums(column: Column | str, start: Column | str) -> Column:
    """The sums of a list's numbers up to each of them, and a start."""

    @F.pandas_udf("array<bigint>")
    def run(lists: pd.Series, starts: pd.Series) -> pd.Series:
        numbers, edges = _flat(lists)
        sums = _sums(numbers, edges) + np.repeat(starts.to_numpy(np.int64), np.diff(edges))
        return pd.Series([sums[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], dtype=object)

    return run(column, start)


def vbyte_encode(column: Column | str, gaps: bool = False) -> Column:
    return _encoder(vbyte_batch, gaps, 0)(column)


def vbyte_decode(column: Column | str, gaps: bool = False) -> Column:
    return _decoder(vbyte_batch_back, gaps, 0)(column)


def gamma_encode(column: Column | str, gaps: bool = False) -> Column:
    """Gaps are one higher in the code, so that a gap of 0 has one."""
    return _encoder(gamma_batch, gaps, 1)(column)


def gamma_decode(column: Column | str, gaps: bool = False) -> Column:
    return _decoder(_gamma_lists, gaps, 1)(column)


def vbyte_size(n: Column) -> Column:
    """Bytes of a number's variable byte code."""
    return F.ceil(F.length(F.bin(n)) / 7).cast("long")


def gamma_code(n: Column) -> Column:
    """A number's gamma code as text."""
    return F.concat(F.repeat(F.lit("0"), F.length(F.bin(n)) - 1), F.bin(n))


def gamma_size(n: Column) -> Column:
    """Bits of a number's gamma code."""
    return (2 * F.length(F.bin(n)) - 1).cast("long")


def posting_gaps(pairs: DataFrame) -> DataFrame:
    """(term, doc_id) with gap, the difference to the term's doc before it (the first: to 0).

    Pairs are dealt by ranges of (term, doc_id), so a term that all documents hold is spread over tasks; what stands before a range's first row comes from
    a table with a row for each range, which is broadcast.
    """
    held = ranged(pairs.select("term", "doc_id"), ["term", "doc_id"])
    ends = held.groupBy("__part").agg(F.max_by(F.struct("term", "doc_id"), "__at").alias("end"))
    edges = ends.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("edge"))
    upto = F.lag(F.struct("term", "doc_id")).over(Window.partitionBy("__part").orderBy("__at"))
    before = held.withColumn("own", upto).join(F.broadcast(edges), "__part").withColumn("last", F.coalesce("own", "edge"))
    return before.select("term", "doc_id", (F.col("doc_id") - F.when(F.col("last.term") == F.col("term"), F.col("last.doc_id")).otherwise(0)).alias("gap"))


def undo_gaps(gaps: DataFrame) -> DataFrame:
    """The doc ids again, as the running sum of the gaps in doc order: within ranges, and over ranges from the sums of the terms at their ends."""
    held = ranged(gaps.select("term", "doc_id", "gap"), ["term", "doc_id"])
    ends = held.groupBy("__part").agg(F.array_distinct(F.array(F.min("term"), F.max("term"))).alias("ts")).select("__part", F.explode("ts").alias("term"))
    sums = held.join(F.broadcast(ends), ["__part", "term"]).groupBy("__part", "term").agg(F.sum("gap").alias("all"))
    carry = sums.select("__part", "term", F.sum("all").over(Window.partitionBy("term").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    upto = F.sum("gap").over(Window.partitionBy("__part", "term").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    # two rows for each range are carried
    return held.withColumn("own", upto).join(F.broadcast(carry), ["__part", "term"], "left").select("term", (F.col("own") + F.coalesce("carried", F.lit(0))).alias("doc_id"))


def front_code(terms: DataFrame, block: int = 8) -> DataFrame:
    """block, code (`<shared>:<rest>|` for each term of the block), original (characters and one each) and coded (characters).

    terms: distinct `term`s. They are numbered over a range shuffle, so no task holds them all; blocks are built by key.
    """
    in_order = numbered(terms.select("term"), ["term"], "rn").withColumn("block", F.expr(f"rn div {block}"))
    members = in_order.groupBy("block").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    limit = lambda a, b: F.least(F.length(a), F.length(b))
    shared = lambda a, b: F.size(F.filter(F.sequence(F.lit(0), limit(a, b)), lambda k: (k > 0) & (F.left(a, k) == F.left(b, k))))
    piece = lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(shared(F.get("terms", i - 1), x)).alias("n"), x.alias("t"))
    parts = members.withColumn("parts", F.transform("terms", piece))
    code = F.array_join(F.transform("parts", lambda p: F.concat(p["n"].cast("string"), F.lit(":"), F.substring(p["t"], p["n"] + 1, F.length(p["t"])), F.lit("|"))), "")
    original = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 1)
    return parts.select("block", code.alias("code"), original.alias("original"), F.length(code).cast("long").alias("coded"))


def front_decode(blocks: DataFrame) -> DataFrame:
    """The terms of front coded blocks."""
    entries = F.filter(F.split("code", r"\|"), lambda x: F.instr(x, ":") > 0)
    state = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("terms"))

    def add(s: Column, x: Column) -> Column:
        at = F.instr(x, ":")
        term = F.concat(F.left(s["last"], F.substring(x, F.lit(1), at - 1).cast("int")), F.substring(x, at + 1, F.length(x)))
        return F.struct(term.alias("last"), F.array_append(s["terms"], term).alias("terms"))

    return blocks.select("block", F.explode(F.aggregate(entries, state, add)["terms"]).alias("term"))


def front_to_bytes(codes: list[str]) -> bytes:
    """A block count of 4 bytes, then each block's length (4 bytes) and UTF-8."""
    parts = [c.encode() for c in codes]
    return struct.pack(">i", len(parts)) + b"".join(struct.pack(">i", len(p)) + p for p in parts)


def front_from_bytes(data: bytes) -> list[str]:
    count, at, out = struct.unpack_from(">i", data)[0], 4, []
    for _ in range(count):
        size = struct.unpack_from(">i", data, at)[0]
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out
