"""What the text operators share: batches of bounded size, words, and 64-bit hashes in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlint.runtime import Workspace

CHUNK = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have; extra columns of any name then stay as they are."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``size`` bytes of text, however long a single text is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = n[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(n, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    out = pc.fill_null(batch.column(column), "")
    return out.cast(pa.string()) if not pa.types.is_string(out.type) else out


def words(arr: pa.Array, drop_empty: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: a code for each word, the offset of each row, and the distinct words."""
    lists = pc.ascii_split_whitespace(arr)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    if drop_empty and len(flat):
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            flat = flat.filter(pa.array(full))
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), offsets, coded.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}
KEPT = 6 << 20


def power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; up to KEPT of them are kept for the next call."""
    out = _powers.get(base)
    if out is None or len(out) < n:
        out = np.full(n, base & _MASK, dtype=np.uint64)
        if n:
            out[0] = 1
            np.multiply.accumulate(out, out=out)
        if n <= KEPT:
            _powers[base] = out
    return out[:n]


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed & _MASK))


def string_hashes(arr: pa.Array, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in tabulated bytes, finalised."""
    if not len(arr):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int32, count=len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return segment_hashes(byte_table(seed)[raw], offsets[:-1], offsets[1:])


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hashes of values[start:end], each in constant time from one prefix sum."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power(_BASE, n), dtype=np.uint64, out=sums[1:])
    inverse = power(_INVERSE, n + 1)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row: one fewer than k less than there are values."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = s * np.uint64(_BASE) + h[i : len(h) - k + 1 + i]
        s ^= s >> np.uint64(29)
    return mix(s)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurs again in its row, and whether it occurs earlier in its row."""
    salted = mix(key + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(salted, kind="stable")
    s = salted[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    again, earlier = np.zeros(len(s), bool), np.zeros(len(s), bool)
    earlier[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    again[order] = twice
    return again, earlier


BLOOM_BITS = 26


def bloom_positions(h: np.ndarray) -> np.ndarray:
    return (mix(h.astype(np.uint64, copy=False) if h.dtype != np.int64 else h.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def bitmap_of(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**26 bits over hashed keys, for a broadcast of fixed size (8 MiB) however many keys there are.

    It only lets through too much, never too little; an equi-join afterwards is exact.
    """
    seg = 15

    def positions(it):
        for b in it:
            p = np.unique(bloom_positions(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(p >> seg), pa.array((p & ((1 << seg) - 1)).astype(np.int32))], ["seg", "low"])

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << seg, np.uint8)
        bits[t.column("low").to_numpy()] = 1
        return pa.table({"seg": t.column("seg").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = df.select(column).where(F.col(column).isNotNull()).mapInArrow(positions, "seg long, low int").distinct()
    out = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    width = 1 << (seg - 3)
    for row in found.groupBy("seg").applyInArrow(pack, "seg long, bits binary").toLocalIterator():
        out[row.seg * width : (row.seg + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = bloom_positions(h)
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1


def file_system(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path and the path there: whatever scheme pyarrow knows, so files need no mounted folder."""
    return pf.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


SEGMENT = 13


def _word_and_mask(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key in a filter of so many, and its four bits in it."""
    x = mix(h.view(np.uint64))
    low, one = np.uint64(63), np.uint64(1)
    mask = np.zeros(len(x), np.uint64)
    for k in range(4):
        mask |= one << ((x >> np.uint64(6 * k)) & low)
    return (((x >> np.uint64(32)) * np.uint64(n_words)) >> np.uint64(32)).astype(np.int64), mask


def write_filter(keys: DataFrame, column: str, ws: Workspace, name: str, bits: int) -> str:
    """The path of a filter of ``bits`` bits a key, so that what it lets through beyond the keys is a fixed share of the rest, however many they are.

    keys, without nulls or repeats, are read twice. Every key has one word of 64 bits and
    four bits in it; of other keys 5 % pass at 8 bits, 0.8 % at 16. Segments of 64 KiB are
    packed by the tasks and pass through the driver one partition at a time. Workers map the
    file where it lies in a local folder, so that those of one machine share it.
    """
    n_words = max(1, -(-(keys.count() * bits) // (64 << SEGMENT))) << SEGMENT

    def placed(it):
        for b in it:
            key = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(_word_and_mask(key.to_numpy(), n_words)[0] >> SEGMENT), key], ["seg", "key"])

    def pack(t: pa.Table) -> pa.Table:
        at, mask = _word_and_mask(t.column("key").to_numpy(), n_words)
        words = np.zeros(1 << SEGMENT, np.uint64)
        np.bitwise_or.at(words, at & ((1 << SEGMENT) - 1), mask)
        return pa.table({"seg": t.column("seg").slice(0, 1), "words": pa.array([words.astype("<u8").tobytes()], pa.binary())})

    packed = ws.table(keys.select(F.col(column).cast("long")).mapInArrow(placed, "seg long, key long").groupBy("seg").applyInArrow(pack, "seg long, words binary"), f"{name}-segments")
    fs, path = file_system(ws.at(f"{name}.filter"))
    done, none = 0, bytes(8 << SEGMENT)
    with fs.open_output_stream(path) as out:
        for row in packed.orderBy("seg").toLocalIterator():
            for _ in range(row.seg - done):
                out.write(none)
            out.write(row.words)
            done = row.seg + 1
        for _ in range((n_words >> SEGMENT) - done):
            out.write(none)
    ws.drop(f"{name}-segments")
    return ws.at(f"{name}.filter")


_filters: dict[str, np.ndarray] = {}


def in_filter(path: str, h: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; keys that are always pass. A worker holds the two it used last."""
    words = _filters.pop(path, None)
    if words is None:
        fs, at = file_system(path)
        if isinstance(fs, pf.LocalFileSystem):
            words = np.memmap(at, "<u8", "r")
        else:
            with fs.open_input_file(at) as f:
                words = np.frombuffer(f.read(), "<u8")
    _filters[path] = words
    while len(_filters) > 2:
        _filters.pop(next(iter(_filters)))
    at, mask = _word_and_mask(h, len(words))
    return words[at] & mask == mask


class Memo:
    """The ids of strings seen before, in one table; past ``most`` strings only those of the last batch are kept."""

    def __init__(self, most: int):
        self.most = most
        self.start, self.size, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at: dict[str, int] = {}
        self.last: list[tuple[list[str], np.ndarray]] = []

    def slots(self, *kinds) -> np.ndarray:
        """Where each string lies in start and size; kinds are (distinct strings, what gives ids and sizes of new ones)."""
        if len(self.at) + sum(len(names) for names, _ in kinds) > self.most and self.at:
            names = [w for some, _ in self.last for w in some]
            keep = np.concatenate([slot for _, slot in self.last])
            self.table, ends = spread(self.table, self.start[keep], self.size[keep])
            self.at, self.start, self.size = dict(zip(names, range(len(names)))), ends[:-1], np.diff(ends)
        self.last = []
        for names, encode in kinds:
            at = self.at
            new = [w for w in names if w not in at]
            if new:
                ids, size = encode(new)
                at.update(zip(new, range(len(at), len(at) + len(new))))
                self.start = np.concatenate([self.start, len(self.table) + np.cumsum(size) - size])
                self.size, self.table = np.concatenate([self.size, size]), np.concatenate([self.table, ids])
            self.last.append((names, np.fromiter((at[w] for w in names), np.int64, len(names))))
        return np.concatenate([slot for _, slot in self.last])


def spread(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the table one after another, and where each begins, with the end."""
    ends = np.append(0, np.cumsum(size))
    return table[np.arange(int(ends[-1])) + np.repeat(start - ends[:-1], size)], ends
