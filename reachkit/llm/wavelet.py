"""Token-id output as wavelet matrices: one succinct, compressed file per shard.

Documents are dealt by ranges of doc_id, encoded, and each shard of about ``SHARD_TOKENS`` ids is
written as one wavelet matrix: the shard's distinct ids are numbered in ascending order, and bit
plane l holds bit l (highest first) of all numbers in an order that is stably split by the bits above.
Planes carry a rank directory; access, rank, select, counting and occurrence look-up need only the
planes.  Shards are rows of a Parquet table (one binary file each), written by Spark to the shared
folder, and read back from there.

Edge cases: a null or empty text is its end id alone; rows without a doc_id are left out; rows that
share a doc_id follow each other in the order of a hash of their text; an empty table gives no shard
and no row; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.llm import common as c
from reachkit.llm.encoder import encoder

SHARD_TOKENS = 1 << 20
END_ID = 2
MAGIC = b"WMX1"
_BLOCK = 512  # bits per entry of the rank directory


class WaveletMatrix:
    """Wavelet matrix over a sequence of unsigned ids."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.alphabet, self.planes, self.zeros = n, alphabet, planes, zeros  # planes: packed bits
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    # -- building and reading everything

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.unique(ids)
        width = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        top = int(alphabet[-1]) + 1 if len(alphabet) else 0
        if top <= 1 << 22:
            table = np.zeros(top, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
            table[alphabet] = np.arange(len(alphabet))
            x = table[ids]
        else:
            x = np.searchsorted(alphabet, ids).astype(np.uint32)
        planes, zeros = [], []
        for level in range(width):
            one = (x & x.dtype.type(1 << (width - 1 - level))) != 0
            planes.append(np.packbits(one))
            ones = np.compress(one, x)
            zeros.append(len(x) - len(ones))
            x = np.concatenate([np.compress(~one, x), ones])
        return cls(len(ids), alphabet, planes, zeros)

    def to_array(self) -> np.ndarray:
        """All ids in order: the stable splits undone from the lowest plane up."""
        width = len(self.planes)
        x = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z, y = self.zeros[level], np.empty_like(x)
            y[np.flatnonzero(~one)] = x[:z]
            y[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (width - 1 - level))
            x = y
        return self.alphabet[x] if self.n else self.alphabet[:0]

    # -- rank and select

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if self._ranks[level] is None:
            self._ranks[level] = self._directory(level)
        block = i // _BLOCK
        lo = block * _BLOCK
        return int(self._ranks[level][block]) + int(
            np.unpackbits(self.planes[level][lo // 8:-(-i // 8)], count=i - lo).sum()) if i > lo else int(self._ranks[level][block])

    def _directory(self, level: int) -> np.ndarray:
        """Ones before every block of a plane."""
        padded = np.zeros(-(-self.n // _BLOCK) * _BLOCK or _BLOCK, np.uint8)
        padded[:self.n] = np.unpackbits(self.planes[level], count=self.n)
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, _BLOCK).sum(1, dtype=np.int64))])

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7)) & 1)

    def access(self, i: int) -> int:
        code = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = z + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, value: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Interval of a code's occurrences before i in the order behind the last plane."""
        lo, hi, width = 0, i, len(self.planes)
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (z + a, z + b) if code >> (width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of an id before position i."""
        code = self._code(value)
        if code is None:
            return 0
        lo, hi = self._range(code, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane, by the rank directory."""
        self._rank1(level, self.n)
        at = np.arange(len(self._ranks[level])) * _BLOCK
        before = self._ranks[level] if bit else np.minimum(at, self.n) - self._ranks[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        lo = block * _BLOCK
        bits = np.unpackbits(self.planes[level][lo // 8:(lo + _BLOCK) // 8], count=min(_BLOCK, self.n - lo))
        return lo + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        code = self._code(value)
        if code is None or not 0 <= k < self.count(value):
            raise IndexError(f"no occurrence {k} of id {value}")
        i, width = self._range(code, self.n)[0] + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            bit = code >> (width - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    # -- the file

    def to_bytes(self) -> bytes:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        # the rank directory lies in the file as the ones of every block
        ones = [np.diff(self._directory(k)).astype("<u2") for k in range(len(self.planes))]
        parts = [z.compress(self.alphabet.astype("<u4").tobytes()), z.compress(b"".join(x.tobytes() for x in ones))]
        parts += [z.compress(p.tobytes()) for p in self.planes]
        head = MAGIC + struct.pack("<QII", self.n, len(self.alphabet), len(self.planes))
        head += struct.pack(f"<{len(self.zeros)}Q", *self.zeros) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        import zstandard

        f = io.BytesIO(raw)
        if f.read(4) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, _, width = struct.unpack("<QII", f.read(16))
        zeros = list(struct.unpack(f"<{width}Q", f.read(8 * width)))
        sizes = struct.unpack(f"<{width + 2}Q", f.read(8 * (width + 2)))
        z = zstandard.ZstdDecompressor()
        alphabet, ones, *planes = [np.frombuffer(z.decompress(f.read(s)), kind)
                                   for s, kind in zip(sizes, ["<u4", "<u2"] + [np.uint8] * width, strict=True)]
        out = cls(n, alphabet, planes, zeros)
        out._ranks = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (ones.reshape(width, -1) if width else [])]
        return out


# ---------------------------------------------------------------- Spark jobs

SHARDS = "part int, seq int, n_docs long, n_tokens long, doc_ids binary, counts binary, file binary"


def write_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending doc_id order and write one wavelet matrix per shard; returns
    the written table (``part, seq`` order the shards)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer_path, "words")
        part, seq, held, have = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            ids = np.concatenate([x[0] for x in held])
            counts = np.concatenate([x[1] for x in held])
            tokens = np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_docs": [len(ids)], "n_tokens": [len(tokens)], "doc_ids": [ids.astype("<i8").tobytes()],
                "counts": [counts.astype("<u4").tobytes()],
                "file": pa.array([WaveletMatrix.build(tokens).to_bytes()], pa.binary())})

        for ids, buf, start, end in c.text_slices(batches, most=2 << 20):
            tokens, count = code(buf, start, end)
            stop = np.cumsum(count + 1)
            out = np.full(len(tokens) + len(count), END_ID, np.uint32)
            body = np.ones(len(out), bool)
            body[stop - 1] = False
            out[body] = tokens
            held.append((c.as_longs(ids), count + 1, out))
            have += len(out)
            if have >= shard_tokens:
                yield shard()
                seq, held, have = seq + 1, [], 0
        if held:
            yield shard()

    texts = c.documents(docs).where("doc_id is not null")
    # a doc_id on many rows is cut by its texts
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    return c.stored(c.mapped(ordered, encode, SHARDS), "wavelet-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written files."""
    # ids before a shard: totals of the range partitions, then of the shards inside one
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("start"))
    starts = c.stored(starts, "wavelet-starts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                tokens = WaveletMatrix.from_bytes(row["file"].as_py()).to_array().astype("<u4")
                ids = np.frombuffer(row["doc_ids"].as_py(), "<i8")
                counts = np.frombuffer(row["counts"].as_py(), "<u4").astype(np.int64)
                stop = np.cumsum(counts)
                view = memoryview(tokens.tobytes())
                crcs = [c.crc(view[4 * (b - n):4 * b]) for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(stop - counts + row["start"].as_py()), pa.array(counts),
                     pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(starts.hint("broadcast") if _few(starts) else starts, ["part", "seq"]).mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(df: DataFrame, rows: int = 1 << 20) -> bool:
    return df.count() <= rows


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return c.stored(read_shards(write_shards(docs, tokenizer_path)), "wavelet-digest")
