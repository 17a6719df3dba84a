"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

Lines are normalised (lower case; runs of anything but letters and digits become one
space). Equal normalised lines are one class. Two classes link when they share a block of
their SimHash, their SimHashes over all features differ in at most BITS of 64 bits, and their
edit similarity is at least ``similar``.

The SimHash is parted by feature. In a common one every feature sways every bit, so that
one changed word of a line of 50 moves about five of 64 bits and no block scheme of useful
width finds it. Here a line's features, its word bigrams, are dealt to blocks by their own
hash, and a block is the 64-bit SimHash of its features alone. An edit changes a few
features and with them a few blocks; by the pigeonhole principle some block stays as long
as there are more blocks than changed features, and usually beyond. The number of blocks
doubles with the length of the line, from eight on, so that each holds SHARE to 2 * SHARE
features; lines little above a step also have the blocks below it. The first BLOCKS of
them count, and in all but short lines only those of three features or more (two at eight
blocks), which chance seldom makes equal. Lines under SHORT characters have the hashes of their one-deletion variants
too, which finds every pair one edit apart, whatever their SimHashes.

Pairs are not all looked at. Every block value has a centre, its least class, and first all
its classes are compared with that; what links to one centre is one group already. Then
only classes of different groups that share a value are compared with each other, so a
large cluster of near copies costs one comparison a line, and no link between groups is lost.
A task holds whole values, makes their pairs itself and leaves out those of groups that links
it has found connect already, so what is shuffled and written follows the classes, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlint.llm.common import byte_table, free_name, in_filter, mix, rows_of, segment_hashes, signed, slices, spread, string_hashes, texts, window_hashes, write_filter
from sparrowlint.llm.components import connected_components
from sparrowlint.runtime import Workspace, ship

SHARE, BLOCKS, LEAST_LEVEL, FEW_WORDS, SHORT, BITS = 2.5, 12, 3, 6, 30, 20
SEEN, PAYS, STEP, PAIRS, CELLS = 1 << 17, 16, 1 << 18, 1 << 16, 1 << 23
PART, DEALT = 1 << 19, 1 << 18
#: Classes of a value that one task compares with all others of it, classes in a part, pairs compared at a time, and classes of characters.
HOT, SPOTS, NEAR, LETTERS = 1 << 14, 1 << 14, 1 << 19, 32
#: Joins that find each part of one side to be at most so large hash that side in place of sorting both.
HASHED, HASHED_MOST = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"
_SPREAD = np.array([sum(((x >> j) & 1) << (8 * j) for j in range(8)) for x in range(256)], np.uint64)
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x0A] = 0x0A
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _a, _z, _to in ((0x30, 0x3A, 0x30), (0x61, 0x7B, 0x61), (0x41, 0x5B, 0x61)):
    _FOLD[_a:_z] = np.arange(_to, _to + _z - _a)


class Lines:
    """The normalised lines of all rows: lower case, runs of letters and digits apart by single spaces.

    offsets tell the lines of each row, words those of each line; hashes are of words, keys
    of lines, sizes in bytes, lengths in characters. ASCII and Latin-1 letters are folded in numpy; rows
    with other characters go through regular expressions first.
    """

    def __init__(self, arr: pa.Array):
        off, raw = self._bytes(arr)
        lead = np.append(False, raw[:-1] == 0xC3)
        other = (raw >= 0x80) & (raw != 0xC3) & ~lead
        if other.any():
            slow = np.zeros(len(arr), bool)
            slow[np.searchsorted(off, np.flatnonzero(other), side="right") - 1] = True
            mask = pa.array(slow)
            arr = pc.replace_with_mask(arr, mask, pc.replace_substring_regex(pc.utf8_lower(arr.filter(mask)), r"[^\p{L}\p{N}\n]+", " "))
            off, raw = self._bytes(arr)
            lead = np.append(False, raw[:-1] == 0xC3)
        x = _FOLD[raw]
        sign = lead & ((raw == 0x97) | (raw == 0xB7))
        x[lead & (raw < 0x9F)] += 0x20
        if sign.any():
            at = np.flatnonzero(sign)
            x[at] = x[at - 1] = 0x20
        self.raw, inside = x, (x != 0x20) & (x != 0x0A)
        first = np.zeros(len(x) + 1, bool)
        first[off] = True
        newline = np.flatnonzero(x == 0x0A)
        self.begin = np.sort(np.concatenate([off[:-1], newline + 1]))
        per_row = np.diff(np.searchsorted(newline, off)) + 1
        self.offsets = np.append(0, np.cumsum(per_row))
        before = np.append(False, inside[:-1]) & ~first[:-1]
        self.start = np.flatnonzero(inside & ~before)
        after = np.append(inside[1:], False) & ~first[1:]
        end = np.flatnonzero(inside & ~after) + 1
        borders = np.append(self.begin, len(x))
        self.words = np.searchsorted(self.start, borders)
        self.hashes = segment_hashes(byte_table(1)[x], self.start, end)
        self.keys = segment_hashes(self.hashes, self.words[:-1], self.words[1:])
        size = np.append(0, np.cumsum(end - self.start + 1))
        self.sizes = np.maximum(size[self.words[1:]] - size[self.words[:-1]] - 1, 0)
        # Bytes that continue a character are all inside of words.
        self.lengths = self.sizes - np.diff(np.searchsorted(np.flatnonzero((x & 0xC0) == 0x80), borders))
        self.inside = inside

    @staticmethod
    def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
        data = arr.buffers()[2]
        return off - off[0], (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8))

    def texts(self) -> pa.Array:
        """The lines themselves."""
        keep = self.inside.copy()
        inner = np.ones(len(self.start), bool)
        inner[self.words[:-1][np.diff(self.words) > 0]] = False
        keep[self.start[inner] - 1] = True
        at = np.append(0, np.cumsum(self.sizes)).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.begin), pa.py_buffer(at), pa.py_buffer(self.raw[keep].tobytes()))


def simhash(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of the features from each start to the next: a bit is set where it is in more than half of them."""
    n = np.diff(np.append(starts, len(f)))
    out = np.zeros(len(starts), np.uint64)
    half = np.minimum(n // 2 + 1, 127).astype(np.uint64) * _ONES
    planes = np.ascontiguousarray(f.view(np.uint8).reshape(-1, 8).T)
    for k in range(8):
        # Eight counters of a byte each: a comparison sets the top bit of those that reach the half.
        counts = np.add.reduceat(_SPREAD[planes[k]], starts)
        up = (((counts | _TOPS) - half) & _TOPS) >> np.uint64(7)
        out |= ((up * np.uint64(0x0102040810204080)) >> np.uint64(56)) << np.uint64(8 * k)
    if len(many := np.flatnonzero(n > 127)):
        # So many by pieces of 127, whose counters are added up.
        flat, ends = spread(f, starts[many], n[many])
        pieces = -(-n[many] // 127)
        first = np.cumsum(pieces) - pieces
        at = np.repeat(ends[:-1], pieces) + 127 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
        planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T)
        for k in range(8):
            counts = np.add.reduceat(_SPREAD[planes[k]], at).view(np.uint8).reshape(-1, 8)
            up = 2 * np.add.reduceat(counts, first, axis=0, dtype=np.int64) > n[many, None]
            out.view(np.uint8).reshape(-1, 8)[many, k] = np.packbits(up, axis=1, bitorder="little")[:, 0]
    return out


def line_blocks(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(line, value)`` of every block of the lines, given the hashes of their words, and the SimHash of all features of each line."""
    n = np.diff(off)
    row = rows_of(off)
    inside = row[1:] == row[:-1]
    few = (n <= FEW_WORDS)[row]
    f, fr = window_hashes(h, 2)[inside], row[:-1][inside]
    if few.any():
        f, fr = np.concatenate([f, mix(h[few] + np.uint64(99))]), np.concatenate([fr, row[few]])
        order = np.argsort(fr, kind="stable")
        f, fr = f[order], fr[order]
    whole = np.zeros(len(n), np.uint64)
    if len(f):
        s = np.flatnonzero(np.append(True, fr[1:] != fr[:-1]))
        whole[fr[s]] = simhash(f, s)
    m = np.bincount(fr, minlength=len(n))
    level = np.maximum(np.floor(np.log2(np.maximum(m / SHARE, 1))), LEAST_LEVEL).astype(np.int64)
    near = (level > LEAST_LEVEL) & (m < 1.25 * SHARE * 2.0**level)
    least = np.where(level > LEAST_LEVEL, 3, np.where(m < SHARE * 2**LEAST_LEVEL, 1, 2))
    deal = (f >> np.uint64(40)).astype(np.int64)
    parts = []
    for below in (0, 1):
        at = np.flatnonzero(near[fr]) if below else slice(None)
        lv = level[fr[at]] - below
        g = deal[at] & ((1 << np.maximum(lv, 0)) - 1)
        keep = g < BLOCKS
        parts.append((((fr[at][keep] * 2 + below) * 64 + lv[keep]) * BLOCKS + g[keep], f[at][keep]))
    cell, f = (np.concatenate(x) for x in zip(*parts))
    if not len(cell):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), whole
    order = np.argsort(cell)
    cell, f = cell[order], f[order]
    s = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    count, cell = np.diff(np.append(s, len(cell))), cell[s]
    line = cell // (128 * BLOCKS)
    keep = count >= least[line]
    value = mix(simhash(f, s) + (cell % (64 * BLOCKS)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return line[keep], value[keep], whole


def _lines(least: int, similar: float):
    """Every line; of each class, where it is first seen, also its text. The blocks of many classes are with the first of them."""
    one = int(np.ceil(1 / (1 - similar) - 1e-6)) if similar < 1 else 1 << 30
    low = int(similar * one)

    def run(it):
        seen: set[int] = set()
        for b in slices(it, "text", STEP):
            x = Lines(texts(b))
            row, n, key = rows_of(x.offsets), x.lengths, x.keys
            _, first = np.unique(key, return_index=True)
            known = key[first].tolist()
            first = first[np.fromiter((k not in seen for k in known), bool, len(known)) & (n[first] >= max(1, least))]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(key[first].tolist())
            first = np.sort(first)
            at, value, sim = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(n), np.uint64)
            lines = x.texts()
            if similar < 1 and len(first):
                size = np.diff(x.words)[first]
                at, value, sim[first] = line_blocks(*spread(x.hashes, x.words[:-1][first], size))
                at = first[at]
                if len(short := first[(n[first] >= low) & (n[first] < SHORT)]):
                    left = [list({y, *(y[:i] + y[i + 1 :] for i in range(len(y)))}) for y in lines.take(pa.array(short)).to_pylist()]
                    at = np.concatenate([at, np.repeat(short, [len(ys) for ys in left])])
                    value = np.concatenate([value, string_hashes(pa.array([y for ys in left for y in ys], pa.string()), seed=3)])
            order = np.argsort(at, kind="stable")
            count = np.bincount(at, minlength=len(n))
            blocks = _packed(key, first, count, value[order])
            is_first = np.zeros(len(n), bool)
            is_first[first] = True
            take = pa.array(row)
            out = pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("tie").take(take), pa.array((np.arange(len(row)) - x.offsets[row]).astype(np.int32)), pa.array(signed(key)), pa.array(n.astype(np.int32)), pa.array(signed(sim)), pa.array(count.astype(np.int32)), blocks, pc.if_else(pa.array(is_first), lines, pa.scalar(None, pa.string()))], ["doc_id", "tie", "line", "key", "n", "sim", "n_blocks", "blocks", "body"])
            yield out.filter(pa.array(n >= max(1, least)))

    return run


def _packed(key: np.ndarray, first: np.ndarray, count: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values of the classes at ``first``, about DEALT of them together, at the first class of each such part, as 64-bit words: number of classes, keys, counts, values. A row for each class would cost more than its values."""
    before = np.append(0, np.cumsum(count[first]))
    s = np.append(np.flatnonzero(np.diff(before[:-1] // DEALT, prepend=-1)), len(first))
    size = np.zeros(len(key), np.int64)
    size[first[s[:-1]]] = 8 * (1 + 2 * np.diff(s) + np.diff(before[s]))
    parts = []
    for i, j in zip(s[:-1], s[1:]):
        at = first[i:j]
        parts += [np.array([j - i]), signed(key[at]), count[at], signed(values[before[i] : before[j]])]
    data = np.concatenate(parts).tobytes() if parts else b""
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(pa.array(size > 0), packed, pa.scalar(None, pa.binary()))


def _values(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and the key of each, from what ``_packed`` made or from lists with a key beside each."""
    blocks = b.column("blocks")
    if pa.types.is_list(blocks.type):
        yield blocks.flatten().to_numpy(), np.repeat(b.column("key").to_numpy(), pc.fill_null(pc.list_value_length(blocks), 0).to_numpy())
        return
    for x in blocks.drop_null():
        x = np.frombuffer(x.as_buffer(), np.int64)
        n = int(x[0])
        yield x[2 * n + 1 :], np.repeat(x[1 : n + 1], x[n + 1 : 2 * n + 1])


def _deal(parts: int):
    """The values of classes by part: ``pairs`` are value and key of each, 16 bytes together. A part is in memory at once, with all classes of its values."""

    def run(it):
        held: list[np.ndarray] = []

        def dealt():
            rows = np.concatenate(held)
            part = ((mix(rows[:, 0].view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            s = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = (np.append(s, len(part)) * 16).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part[s]), pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(rows[order].tobytes())])], ["part", "pairs"])

        for b in it:
            for values, keys in _values(b):
                for i in range(0, len(values), DEALT):
                    held.append(np.stack([values[i : i + DEALT], keys[i : i + DEALT]], axis=1))
                    if sum(map(len, held)) >= DEALT:
                        yield dealt()
                        held.clear()
        if held:
            yield dealt()

    return run


def _meet(t: pa.Table) -> pa.Table:
    """Of a part the values that several classes have: each with its classes and the least of them."""
    rows = np.frombuffer(b"".join(t.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
    order = np.argsort(rows[:, 0])
    v = rows[order, 0]
    same = v[1:] == v[:-1]
    keep = np.append(False, same) | np.append(same, False)
    v, key = v[keep], rows[order[keep], 1]
    order = np.lexsort((key, v))
    v, key = v[order], key[order]
    begins = np.append(True, v[1:] != v[:-1])[: len(v)]
    new = begins | np.append(True, key[1:] != key[:-1])[: len(v)]
    v, key, s = v[new], key[new], np.flatnonzero(begins[new])
    many = np.diff(np.append(s, len(v)))
    shared = np.repeat(many > 1, many)
    return pa.table({"v": v[shared], "key": key[shared], "ck": np.repeat(key[s], many)[shared]})


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel, a column of the table being two integers of any length."""
    m, left = len(a), len(b)
    if not m or not left:
        return max(m, left) <= most
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    mask, top, pv, mv, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    for i in range(0, left, 64):
        for ch in b[i : i + 64]:
            eq = at.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 | 1
            pv = (mh << 1 | (mask & ~(xv | ph))) & mask
            mv = ph & xv & mask
        if score - max(0, left - i - 64) > most:
            return False
    return score <= most


_STEPS = sorted(((i, j) for i in range(5) for j in range(5) if i or j), key=lambda s: (max(s), abs(s[0] - s[1])))


def word_bound(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance, from one alignment of whole words; beyond ``most`` it stops."""
    x, y = a.split(" "), b.split(" ")
    nx, ny, i, j, total = len(x), len(y), 0, 0, 0
    while i < nx and j < ny:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for di, dj in _STEPS:
            if i + di < nx and j + dj < ny and x[i + di] == y[j + dj]:
                break
        else:
            di, dj = nx - i, ny - j
        total += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[j : j + dj])) + dj)
        if total > most:
            return total
        i, j = i + di, j + dj
    return total + max(sum(map(len, x[i:])) + nx - i, sum(map(len, y[j:])) + ny - j)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """The texts without common prefix and suffix, which have the same edit distance."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    head, lo, hi = lo, 0, min(len(a), len(b)) - lo
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    return a[head : len(a) - lo], b[head : len(b) - lo]


def many_within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """``distance_within`` of many pairs. Where enough have a band of one width they go side by side, whatever their lengths: a column of all tables at once."""
    out = np.zeros(len(pairs), bool)
    pairs = [(a, b, k) if len(a) <= len(b) else (b, a, k) for a, b, k in pairs]
    # Lengths that differ too much and empty texts need no table.
    wide = np.array([k // 64 + 1 if a and len(b) - len(a) <= k < len(b) else 0 for a, b, k in pairs])
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        if not w or len(rows) < PAYS * w:
            for i in rows:
                out[i] = distance_within(*pairs[i])
            continue
        rows = rows[np.argsort([len(pairs[i][1]) for i in rows], kind="stable")]
        step = max(PAYS * w, 8192 // w)
        for x in range(0, len(rows), step):
            out[rows[x : x + step]] = _side_by_side([pairs[i] for i in rows[x : x + step]], int(w))
    return out


def _side_by_side(pairs: list[tuple[str, str, int]], wide: int) -> np.ndarray:
    """Only the diagonals that a distance up to ``most`` can touch are computed, most + 1 of them in ``wide`` words; what lies beyond is taken for no less than it is, so distances up to ``most`` are exact.

    From one column to the next the words move down by a row. Their last bit is ``reach``
    rows below the main diagonal; the score follows it down to the last row, then along that.
    """
    m, n, most = (np.array(x, np.int64) for x in zip(*((len(a), len(b), k) for a, b, k in pairs)))
    flat = np.frombuffer("".join(a + b for a, b, _ in pairs).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(flat.max()) + 1, bool)
    used[flat] = True
    code = (np.cumsum(used) - 1)[flat]
    size, u, bits = int(used.sum()), len(pairs), 64 * wide
    begin = np.cumsum(m + n) - m - n
    reach = (most - (n - m)) // 2
    deep = int((n.max() - 1) // 64) + wide + 1
    if u * size * deep > CELLS:
        # Many different characters, or long texts: fewer pairs at once.
        if u <= PAYS:
            return np.array([distance_within(*p) for p in pairs])
        return np.concatenate([_side_by_side(pairs[: u // 2], wide), _side_by_side(pairs[u // 2 :], wide)])
    # Where each character is in the shorter text, so placed that column j has bits j to j + bits of it.
    pair = np.repeat(np.arange(u), m)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    at = row + np.repeat(bits - 1 - reach, m)
    cell = ((at // 64) * u + pair) * size + code[begin[pair] + row]
    # The bits of a cell differ, so that their sum is their union; halves of 32 bits are exact in doubles.
    bit = 2.0 ** (at % 32)
    upper = at % 64 >= 32
    halves = [np.bincount(cell[half], bit[half], u * size * deep).astype(np.uint64) for half in (~upper, upper)]
    eqs = (halves[0] | halves[1] << np.uint64(32)).reshape(-1, u * size)
    one, top = np.uint64(1), np.uint64(63)
    # In column 0 values grow by one from row to row, from row 1 on.
    zeros = bits - 1 - reach
    pv = [~np.uint64(0) << np.clip(zeros - 64 * w, 0, 63).astype(np.uint64) for w in range(wide)]
    pv = [np.where(zeros - 64 * w < 64, x, np.uint64(0)) for w, x in enumerate(pv)]
    mv = [np.zeros(u, np.uint64) for _ in range(wide)]
    live, out = np.arange(u), np.zeros(u, bool)
    score, turn, place, text = reach.copy(), m - reach, np.arange(u) * size, begin + m
    last = int(n.max())
    for j in range(last):
        if j % 16 == 0:
            done = n <= j
            out[live[done]] = score[done] <= most[done]
            keep = ~done & (score - np.minimum(n - j, n - turn) <= most)
            if not keep.all():
                live, score, turn, place, text, m, n, most = (x[keep] for x in (live, score, turn, place, text, m, n, most))
                pv, mv = [x[keep] for x in pv], [x[keep] for x in mv]
            if not len(live):
                return out
            if len(live) * last < PAYS * wide * (last - j):
                for i in live:
                    out[i] = distance_within(*pairs[i])
                return out
            first, shift = j // 64, j % 64
        here = place + code[np.minimum(text + j, len(code) - 1)]
        off = np.uint64(shift + j % 16)
        words = [eqs[first + w][here] for w in range(wide + 1)]
        diagonals, ups, downs, down = [], [], [], np.uint64(0)
        for w in range(wide):
            p, q = pv[w], mv[w]
            e = words[w] >> off | words[w + 1] << one << (top - off) | down
            d = (((e & p) + p) ^ p) | e | q
            diagonals.append(d)
            ups.append(q | ~(d | p))
            downs.append(d & p)
            down = downs[w] >> top
        # Past its last row a pair's score follows that row, which moves up in the words.
        flat_now, going = j >= turn, n > j
        if not flat_now.any():
            score += (diagonals[-1] >> top ^ one).astype(np.int64)
        else:
            row = np.maximum(bits - 2 - (j - turn), 0)
            by = (row % 64).astype(np.uint64)
            change = np.zeros(len(live), np.int64)
            for w in range(wide):
                change += (((ups[w] >> by & one).astype(np.int64) - (downs[w] >> by & one).astype(np.int64))) * (row // 64 == w)
            score += np.where(flat_now, change, (diagonals[-1] >> top ^ one).astype(np.int64)) * going
        for w in range(wide):
            d = diagonals[w] >> one | (diagonals[w + 1] << top if w + 1 < wide else np.uint64(0))
            pv[w], mv[w] = downs[w] | ~(d | ups[w]), d & ups[w]
    out[live] = score <= most
    return out


class Joined:
    """Which groups the links found so far connect."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def same(self, pair: tuple[int, int]) -> bool:
        return self.root(pair[0]) == self.root(pair[1])

    def join(self, pair: tuple[int, int]) -> None:
        self.up[self.root(pair[0])] = self.root(pair[1])


def similar_lines(pairs: list[tuple[str, str]], similar: float, groups: list[tuple[int, int]] | None = None, joined: Joined | None = None) -> np.ndarray:
    """Of each pair whether the edit distance is at most 1 - similar of the longer line's length. Bounds decide most pairs before the distance itself.

    With groups, the two of each pair, pairs whose groups the links found connect already
    are left out: what is connected stays the same.
    """
    out, rest, where = np.zeros(len(pairs), bool), [], []
    if groups is not None:
        joined = joined or Joined()
    for i, (a, b) in enumerate(pairs):
        most = int((1 - similar) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > most or groups is not None and joined.same(groups[i]):
            continue
        if word_bound(a, b, most) > most:
            rest.append((a, b, most))
            where.append(i)
        else:
            out[i] = True
            if groups is not None:
                joined.join(groups[i])
    if groups is None:
        out[where] = _within(rest)
        return out
    # Of two groups one pair is decided first, then four more, sixteen and so on, until they are joined or no pair is left.
    left, most = list(range(len(rest))), 1
    while left:
        now, later, count = [], [], {}
        for k in left:
            x, y = map(joined.root, groups[where[k]])
            if x == y:
                continue
            both = (x, y) if x < y else (y, x)
            count[both] = count.get(both, 0) + 1
            (now if count[both] <= most else later).append(k)
        for k, ok in zip(now, _within([rest[k] for k in now])):
            if ok:
                out[where[k]] = True
                joined.join(groups[where[k]])
        left, most = later, 4 * most
    return out


def _within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """``many_within`` of the texts without what they begin and end with in common."""
    out, rest, where = np.ones(len(pairs), bool), [], []
    for i, (a, b, most) in enumerate(pairs):
        a, b = trimmed(a, b)
        if max(len(a), len(b)) > most:
            rest.append((a, b, most))
            where.append(i)
    if rest:
        out[where] = many_within(rest)
    return out


def _verify(similar: float):
    """The pairs that link; with the groups ga and gb of each, enough of them to connect the same groups."""

    def run(it):
        held: list[pa.RecordBatch] = []
        joined = Joined()

        def decided():
            rows = pa.Table.from_batches(held).combine_chunks()
            groups = list(zip(rows.column("ga").to_pylist(), rows.column("gb").to_pylist())) if "ga" in rows.column_names else None
            if len(joined.up) > SEEN:
                joined.up.clear()
            ok = similar_lines(list(zip(rows.column("la").to_pylist(), rows.column("lb").to_pylist())), similar, groups, joined)
            return rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).to_batches()

        # Pairs are gathered up to PAIRS or 64 MB, as many of one width are compared at once.
        for b in it:
            held.append(b)
            if sum(x.num_rows for x in held) >= PAIRS or sum(x.nbytes for x in held) >= 64 << 20:
                yield from decided()
                held.clear()
        if held:
            yield from decided()

    return run


def letter_counts(lines: list[str]) -> np.ndarray:
    """The characters of each line in LETTERS classes of them: an edit changes two of the counts by one at most."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(row * LETTERS + flat % LETTERS, minlength=len(lines) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def near_in_values(v: np.ndarray, n: np.ndarray, sim: np.ndarray, group: np.ndarray, mine: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one value, of different groups, that may link by their lengths and SimHashes: pairs of row numbers, some NEAR compared at a time. Only rows that are ``mine`` come first in a pair."""
    order = np.lexsort((n, v))
    v, n, sim, group, mine = (x[order] for x in (v, n, sim, group, mine))
    value = np.cumsum(np.append(True, v[1:] != v[:-1])[: len(v)])
    longest = np.floor(n / similar).astype(np.int64) + 1
    while len(much := np.flatnonzero(similar * longest > n)):
        longest[much] -= 1
    wide = int(longest.max()) + 1
    end = np.searchsorted(value * wide + n, value * wide + longest, side="right")
    count = np.where(mine, end - np.arange(len(v)) - 1, 0)
    at = np.flatnonzero(count)
    total = np.cumsum(count[at])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + NEAR, side="right")))
        i = np.repeat(at[a:b], count[at[a:b]])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[at[a:b]]) - count[at[a:b]], count[at[a:b]])
        ok = np.flatnonzero((np.bitwise_count((sim[i] ^ sim[j]).view(np.uint64)) <= BITS) | (n[i] < SHORT))
        i, j = i[ok], j[ok]
        ok = group[i] != group[j]
        if ok.any():
            yield order[i[ok]], order[j[ok]]
        a = b


def _common(x: pa.ListArray, y: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least value that the lists i of x and j of y share; where none, the largest number."""
    none = np.iinfo(np.int64).max
    out = np.full(len(i), none)
    sides = []
    for lists, at in ((x, i), (y, j)):
        off, size = lists.offsets.to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
        sides.append((lists.values.to_numpy(), off[at], size[at]))
    (xv, xo, xn), (yv, yo, yn) = sides
    both = np.flatnonzero((xn > 0) & (yn > 0))
    for k in range(0, len(both), 4096):
        at = both[k : k + 4096]
        xs, ys = np.arange(xn[at].max()), np.arange(yn[at].max())
        left = xv[np.minimum(xo[at, None] + xs, len(xv) - 1)]
        same = left[:, :, None] == yv[np.minimum(yo[at, None] + ys, len(yv) - 1)][:, None, :]
        same &= (xs < xn[at, None])[:, :, None] & (ys < yn[at, None])[:, None, :]
        out[at] = np.where(same.any(axis=2), left, none).min(axis=1)
    return out


def _rest(similar: float):
    """Of whole values, with the lines of their classes, the pairs of different groups that link, enough of them to connect the same groups.

    ``vs`` are all values of a class, ``cs`` those whose centre it is. A pair is looked at
    with the least value that it shares, and not if one of the two was the other's centre.
    """
    joined = Joined()

    def run(t: pa.Table) -> pa.Table:
        v, key, n, sim, group, way, ways = (t.column(c).to_numpy() for c in ("v", "key", "n", "sim", "group", "way", "ways"))
        lines, vs, cs = (t.column(c).combine_chunks() for c in ("body", "vs", "cs"))
        mine = mix(key.view(np.uint64)) % ways.astype(np.uint64) == way.astype(np.uint64)
        # Copies of a value for several tasks are apart.
        copy = signed(mix(v.view(np.uint64) + way.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        found: list[np.ndarray] = []
        links = []

        def decided():
            i, j = np.concatenate(found, axis=1)
            found.clear()
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            text = lines.take(pa.array(used)).to_pylist()
            counts, size = letter_counts(text), np.array([len(x) for x in text])
            x, y = at.reshape(2, -1)
            most = ((1 - similar) * np.maximum(size[x], size[y]) + 1e-9).astype(np.int64)
            ok = np.concatenate([np.abs(counts[x[k : k + 8192]] - counts[y[k : k + 8192]]).sum(axis=1) for k in range(0, len(x), 8192)]) <= 2 * most
            i, j, x, y = i[ok], j[ok], x[ok], y[ok]
            if len(joined.up) > SEEN:
                joined.up.clear()
            ok = similar_lines([(text[a], text[b]) for a, b in zip(x.tolist(), y.tolist())], similar, list(zip(group[i].tolist(), group[j].tolist())), joined)
            links.append(np.stack([key[i[ok]], key[j[ok]]]))

        for i, j in near_in_values(copy, n, sim, group, mine, similar) if len(v) else ():
            ok = _common(vs, vs, i, j) == v[i]
            i, j = i[ok], j[ok]
            none = np.iinfo(np.int64).max
            ok = (_common(cs, vs, i, j) == none) & (_common(vs, cs, i, j) == none)
            found.append(np.stack([i[ok], j[ok]]))
            if sum(x.shape[1] for x in found) >= PAIRS:
                decided()
        if sum(x.shape[1] for x in found):
            decided()
        a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    return run


def line_groups(docs: DataFrame, similar: float = 0.9, ws: Workspace | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``occurrences(doc_id, tie, line, key, n)`` and ``roots(node, root)`` of linked classes.

    Lines whose normal form has fewer than ``least`` characters, or none, take no part.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = ws or Workspace(spark, "lines")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    seen = ws.table(source.mapInArrow(_lines(least, similar), "doc_id long, tie long, line int, key long, n int, sim long, n_blocks int, blocks binary, body string"), "lines", dictionary=False)
    first_seen = seen.where("body is not null")
    # Every class has some ten values, few of them shared: what else is known of a class joins those only.
    # The values go by parts of some PART each, so many to a row that rows cost nothing; all of one value go to one part.
    parts = 1 + int(seen.agg(F.sum("n_blocks")).first()[0] or 0) // PART
    dealt = seen.select("blocks").where("blocks is not null").mapInArrow(_deal(parts), "part int, pairs binary")
    met = ws.table(dealt.groupBy("part").applyInArrow(_meet, "v long, key long, ck long"), "met", dictionary=False)
    needed = ws.table(met.select("key").distinct(), "needed", dictionary=False)
    maybe = write_filter(needed, "key", ws, "needed", 16)

    def wanted(it):
        # Lines that no value shares stay where they are, and are not shuffled.
        for b in it:
            yield b.filter(pa.array(in_filter(maybe, b.column("key").to_numpy())))

    shared_lines = first_seen.select("key", "n", "sim", "body").mapInArrow(wanted, "key long, n int, sim long, body string")
    body = ws.table(shared_lines.join(needed, "key", "left_semi").dropDuplicates(["key"]), "bodies")
    ws.drop("needed", "needed.filter")
    shared = ws.table(met.join(body.select("key", "n", "sim"), "key"), "shared")

    def close(a: str, b: str):
        """Lengths and SimHashes of two classes that may link."""
        m, n = F.col("n" + a), F.col("n" + b)
        bits = F.bit_count(F.col("sim" + a).bitwiseXOR(F.col("sim" + b))) <= BITS
        return (F.least(m, n) >= F.lit(similar) * F.greatest(m, n)) & (bits | (F.least(m, n) < SHORT))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        la, lb = (body.select(F.col("key").alias(k), F.col("body").alias("l" + k)) for k in "ab")
        return ws.table(pairs.join(la, "a").join(lb, "b").select(*pairs.columns, "la", "lb").mapInArrow(_verify(similar), "a long, b long"), name)

    of = body.select(F.col("key").alias("ck"), F.col("n").alias("nc"), F.col("sim").alias("simc"))
    stars = shared.where("key <> ck").select("key", F.col("n").alias("nk"), F.col("sim").alias("simk"), "ck").distinct().join(of, "ck")
    stars = ws.table(stars.where(close("c", "k")).select(F.col("ck").alias("a"), F.col("key").alias("b")), "stars")
    first = verified(stars, "first")
    group = first.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("group"))
    grouped = shared.join(group, "key", "left").select("v", "key", "ck", "n", "sim", F.coalesce("group", "key").alias("group"))
    open_values = grouped.groupBy("v").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.ceil(F.count("*") / HOT).alias("ways")).where("lo < hi").select("v", "ways")
    grouped = ws.table(grouped.join(open_values, "v"), "grouped")
    # The pairs that share a value by chance grow as the square of the table: they are made where all lines of the value are, and never written.
    is_centre = F.col("key") == F.col("ck")
    spots = grouped.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "sim", "group")), F.collect_list(F.when(~is_centre, F.struct("v", "ways"))).alias("at"), F.collect_list(F.when(is_centre, F.col("v"))).alias("cs"))
    spots = spots.join(body.select("key", "body"), "key").select("key", "n", "sim", "group", "body", F.col("at.v").alias("vs"), "cs", F.explode("at").alias("x"))
    spots = spots.select("key", "n", "sim", "group", "body", "vs", "cs", "x.v", "x.ways", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.ways") - 1)).alias("way"))
    parts = 1 + grouped.count() // SPOTS
    second = ws.table(spots.groupBy(F.pmod(F.xxhash64("v", "way"), F.lit(parts)).alias("part")).applyInArrow(_rest(similar), "a long, b long"), "second")
    roots = connected_components(first.unionByName(second), ws)
    ws.drop("met", "shared", "bodies", "stars", "grouped")
    return seen.select("doc_id", "tie", "line", "key", "n"), roots


def removed_lines(docs: DataFrame, similar: float = 0.9, least: int = 1) -> DataFrame:
    """``(_id, _tie, _removed array<int>)``: the lines of each document that repeat an earlier one of their group.

    The first occurrence by (doc_id, hash of the text, line) stays; a null doc_id is first.
    Groups are reduced with map-side minima; occurrences then meet their group's first in an
    equi-join that AQE splits.
    """
    ws = Workspace(docs.sparkSession, "lines", {HASHED: HASHED_MOST})
    seen, roots = line_groups(docs, similar, ws, least)
    # Most lines occur once and link with nothing; a root has two classes at least.
    repeated = seen.groupBy("key").count().where("count > 1").select("key")
    groups = repeated.join(roots.withColumnRenamed("node", "key"), "key", "full").select("key", F.coalesce("root", "key").alias("root"))
    grouped = ws.table(seen.join(groups, "key").select("root", "doc_id", "tie", "line"), "in-groups")
    least_of = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "tie", "line")).alias("first"))
    least_of = least_of.select("root", F.col("first.doc_id").alias("d0"), F.col("first.tie").alias("t0"), F.col("first.line").alias("l0"))
    hit = grouped.join(least_of, "root").where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("tie") == F.col("t0")) & (F.col("line") == F.col("l0"))))
    removed = ws.table(hit.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.array_sort(F.collect_set("line")).alias("_removed")), "removed")
    ws.drop("lines", "in-groups", "first", "second")
    return removed


def _with_removed(docs: DataFrame, similar: float, least: int) -> tuple[DataFrame, str]:
    """docs with the lines to remove of each row, null where none, in a column whose name docs does not have."""
    names = {c: free_name(docs, c) for c in ("_id", "_tie", "_removed", "_hash")}
    removed = removed_lines(docs.select("doc_id", "text"), similar, least)
    removed = removed.select(*(F.col(c).alias(names[c]) for c in removed.columns)).hint("shuffle_hash")
    keyed = docs.withColumn(names["_hash"], F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(names["_id"])) & (F.col(names["_hash"]) == F.col(names["_tie"]))
    return keyed.join(removed, same, "left"), names["_removed"]


def _kept(removed: str):
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")


def deduplicate_lines(docs: DataFrame, similar: float = 0.9, least: int = 1) -> DataFrame:
    """The documents without their repeated lines, with the columns they had; n_chars, where there, follows the text.

    Lines are split at \\n and keep their order and bytes. Lines whose normal form has
    fewer than ``least`` characters, or none, always stay. Null and empty texts stay as they are,
    and documents that lose all lines stay with an empty text. Repeated rows (one doc_id,
    one text) count as one document and keep the same lines. Empty tables give no rows.
    Other columns, whatever their names, stay as they are.
    """
    joined, removed = _with_removed(docs, similar, least)
    kept, none = _kept(removed), F.col(removed).isNull()
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(none, F.col("text")).otherwise(kept).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(none, F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return joined.select(*cols)


def line_report(docs: DataFrame, similar: float = 0.9, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the UTF-8 text left) per row.

    A null text counts as empty: one line, nothing removed. Repeated rows (one doc_id, one
    text) are one document and report alike; a null doc_id comes first. An empty table gives
    no rows; other columns are not read.
    """
    joined, removed = _with_removed(docs.select("doc_id", "text"), similar, least)
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.col(removed).isNull(), text).otherwise(_kept(removed))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
