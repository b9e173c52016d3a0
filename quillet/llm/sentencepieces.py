"""SentencePiece encoding and decoding that keeps byte offsets.

The model file is read here as a protobuf. Its compiled character map (a double-array trie over UTF-8 prefixes, each leading to
a replacement) is applied by longest prefix, and every normalised byte records the source bytes it came from. The library cuts
the text into pieces; each piece's normalised bytes are projected to the source bytes by that record.

Where no piece has the space mark after another character, no merge crosses a space, so the words of a text can be encoded one by
one and a bounded table of seen words saves work. Texts with leading, trailing or double spaces, and models without that property,
go to the library whole.

Null texts count as empty and give no pieces. Nothing is cut off, sampled or added. Where the pieces don't account for the normalised bytes one by one (a model without byte pieces
whose unknown pieces swallow several runs), the library's own offsets of the text are taken. Rows that repeat are rows of their own, ties don't occur; columns with the names of added ones
give way to them. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from hashlib import sha256 as sha256_of
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from quillet.llm.bytesview import Texts, map_texts

MARK = "▁".encode()
#: Words that the table of seen words holds at most.
SEEN = 150_000


def fields(buf: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protobuf message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            out.append((tag >> 3, buf[at : at + size]))
            at += size
    return out


class CharMap:
    """The compiled character map: u32 size of the trie, the trie's u32 units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.text = blob[4 + size :] if blob else b""

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest prefix at `at` that has a replacement, and the replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            unit = units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.text[value : self.text.index(0, value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = fields(f.read())
        pieces = [dict(fields(v)) for k, v in top if k == 1]
        trainer = dict(fields(next((v for k, v in top if k == 2), b"")))
        spec = dict(fields(next((v for k, v in top if k == 3), b"")))
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        names, kinds = [p[1] for p in pieces], [p.get(3, 1) for p in pieces]
        #: Normalised bytes of each piece: one for a byte piece (kind 6), none known for the unknown piece (kind 2).
        self.size = np.array([1 if k == 6 else -1 if k == 2 else len(x) for x, k in zip(names, kinds, strict=True)])
        self.by_word = not self.map.units and self.dummy and not self.squeeze and self.escape and not self.suffix and not any(MARK in x.replace(MARK, b" ").lstrip(b" ").replace(b" ", MARK) for x in names)
        self.seen: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.library.encode(texts, num_threads=1)
        seen, out = self.seen, []
        if len(seen) > SEEN:
            seen.clear()
        split = [None if not x or x[0] == " " or x[-1] == " " or "  " in x or "▁" in x else x.split(" ") for x in texts]
        new = list(set(chain.from_iterable(x for x in split if x)).difference(seen))
        seen.update(zip(new, self.library.encode(new, num_threads=1), strict=True))
        whole = iter(self.library.encode([x for x, s in zip(texts, split, strict=True) if s is None], num_threads=1))
        for parts in split:
            out.append(next(whole) if parts is None else list(chain.from_iterable(map(seen.__getitem__, parts))))
        return out

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte it starts from."""
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.map.units or self.squeeze:
            out, begin, at = bytearray(), [], 0
            while at < len(source):
                hit = self.map.longest(source, at)
                step = hit[0] if hit else 1 + next((k for k in range(3) if at + k + 1 >= len(source) or source[at + k + 1] & 0xC0 != 0x80), 3)
                new = hit[1] if hit else source[at : at + step]
                if self.squeeze and new == b" " and (not out or out.endswith(b" ")):
                    new = b""
                out += new
                begin += [at] * len(new)
                at += step
            while self.squeeze and out.endswith(b" "):
                out.pop()
                at = begin.pop()
            plain, origin = np.frombuffer(bytes(out), np.uint8), np.array([*begin, at], np.int64)
        else:
            plain, origin = np.frombuffer(source, np.uint8), np.arange(len(source) + 1)
        mark = np.frombuffer(MARK if self.escape else b" ", np.uint8)
        times = np.where(plain == 0x20, len(mark), 1)
        wide = np.repeat(plain, times)
        start = np.cumsum(times) - times
        for k, byte in enumerate(mark):
            wide[start[plain == 0x20] + k] = byte
        origin = np.concatenate([np.repeat(origin[:-1], times), origin[-1:]])
        if self.dummy and not self.suffix:
            return mark.tobytes() + wide.tobytes(), np.concatenate([np.full(len(mark), origin[0]), origin])
        if self.dummy:
            return wide.tobytes() + mark.tobytes(), np.concatenate([origin, np.full(len(mark), origin[-1])])
        return wide.tobytes(), origin

    def spans(self, source: bytes, ids: np.ndarray) -> np.ndarray:
        """The source byte at which each piece begins, and the end of the last: piece k comes from spans[k]..spans[k + 1]."""
        normal, origin = self.normalise(source)
        size = self.size[ids]
        if (size < 0).any():  # an unknown piece takes what the others leave
            lack = size < 0
            size = np.where(lack, (len(normal) - size[~lack].sum()) if lack.sum() == 1 else 0, size)
        at = np.concatenate([[0], np.cumsum(size)])
        return origin[at] if at[-1] == len(normal) else self.library_spans(source)

    def library_spans(self, source: bytes) -> np.ndarray:
        """The same by the library."""
        found = self.library.encode(source.decode(), return_type="proto").pieces
        return np.array([*(p.begin for p in found), found[-1].end if found else 0], np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


ADDED = [StructField("ids", ArrayType(IntegerType())), StructField("begins", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("decoded", StringType()), StructField("spans_sha256", StringType())]


def encode_spans(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ids, begins and ends (UTF-8 byte spans of each piece in the source), the decoded text, and spans_sha256: of the begins and the last end as 32-bit
    little-endian numbers.

    The model file must lie at `model_path` on every executor. Null and empty texts give empty lists and an empty text.
    """

    def work(t: Texts) -> list[pa.Array]:
        model = load(model_path)
        raw = t.buf.tobytes()
        sources = [raw[a:b] for a, b in zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)]
        ids = model.encode([x.decode() for x in sources])
        decoded = model.library.decode(ids, num_threads=1)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(edges[-1]))
        spans = [model.spans(x, flat[a:b]) for x, a, b in zip(sources, edges[:-1], edges[1:], strict=True)]
        column = lambda v: pa.ListArray.from_arrays(pa.array(edges), pa.array(v, pa.int32()))
        return [column(flat), column(np.concatenate([x[:-1] for x in spans])), column(np.concatenate([x[1:] for x in spans])), pa.array(decoded, pa.string()), pa.array([sha256_of(x.astype("<i4").tobytes()).hexdigest() for x in spans], pa.string())]

    return map_texts(df, text, ADDED, work)


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def digest_columns() -> list[Column | str]:
    return [
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes_covered"),
        "spans_sha256",
    ]


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from encode_spans()."""
    return encoded.select(*digest_columns())
