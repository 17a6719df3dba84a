"""SentencePiece encoding and decoding by Viterbi search over a bounded window.

The search keeps, per position, the best score and the piece that ends there. No piece
is longer than L characters, so only the last L positions can still be extended: once
the backpointers of all of them run through one boundary, everything before it is final
and is committed. Where no piece of the vocabulary holds the space mark after another
character, every space is such a boundary, so texts fall apart into segments whose ids
do not depend on their surroundings: distinct segments of a batch are searched together
in numpy, and long ones by the window.

Which paths survive depends on the model. A unigram model keeps the path of the best sum
of scores. A merge (BPE) model keeps, for every position, the one piece whose pair with
the piece before it no earlier merge would have torn apart; a chain of such pairs is the
result of merging in order, so the ids are the library's own, from the same forward pass,
window and commits.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparrowlint.llm.common import Memo, slices, spread, texts
from sparrowlint.runtime import ship

MARK = "▁"
CELLS, MEMO = 1 << 17, 300_000


def _fields(raw: bytes):
    """The fields of a protobuf message: number and value."""

    def varint(i):
        v = shift = 0
        while True:
            v |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return v, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            v, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            v, i = raw[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            v, i = raw[i : i + n], i + n
        yield tag >> 3, v


def merges_in_order(path: str) -> bool:
    """Whether the model file declares merges (model_type 2) rather than unigrams."""
    with open(path, "rb") as f:
        spec = b"".join(v for k, v in _fields(f.read()) if k == 2)
    return 2 in [v for k, v in _fields(spec) if k == 3]


class Codec:
    """Pieces and scores of one model file, a trie in sorted arrays, and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.bytes = np.full(256, self.unk, np.int64)
        self.pieces: dict[str, int] = {}
        self.out: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                self.out.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.out.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.out.append(p.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.pieces[p] = i
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        used = list(self.pieces.values())
        self.unk_score = self.scores[used].min() - 10 if used else -10.0
        self.longest = max(map(len, self.pieces), default=1)
        self.merging = merges_in_order(path)
        if self.merging:
            self._merges()
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.memo, self.commits = Memo(MEMO), 0
        self._trie()

    def _trie(self) -> None:
        step: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        size = 1
        for p, i in self.pieces.items():
            at = 0
            for ch in map(ord, p):
                if (at, ch) not in step:
                    step[at, ch] = size
                    size += 1
                at = step[at, ch]
            ends[at] = i
        self.step = step
        keys = np.array([(a << 21) | c for a, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(step.values()), np.int64)[order]
        self.end = np.full(size, -1, np.int64)
        for at, i in ends.items():
            self.end[at] = i

    def _merges(self) -> None:
        """Ranks by merge order (characters first), each piece's last merge, and the pairs that merge."""
        order = sorted(self.pieces.items(), key=lambda x: (len(x[0]) > 1, -self.scores[x[1]], x[1]))
        rank = {p: r for r, (p, _) in enumerate(order)}
        n = len(order)
        # Rank n stands for a character without a piece.
        self.rank = np.full(len(self.scores) + 1, n, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs: dict[int, int] = {}
        for p, i in order:
            self.rank[i] = rank[p]
            parts = list(p)
            while len(parts) > 2:
                k, best = -1, n
                for j in range(len(parts) - 1):
                    r = rank.get(parts[j] + parts[j + 1], n)
                    if r < best:
                        k, best = j, r
                if k < 0:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(p) > 1 and (len(parts) != 2 or parts[0] not in rank or parts[1] not in rank):
                del self.pieces[p]
            elif len(p) > 1:
                self.left[rank[p]], self.right[rank[p]] = rank[parts[0]], rank[parts[1]]
                pairs[rank[parts[0]] << 21 | rank[parts[1]]] = rank[p]
        self.chars = sum(len(p) == 1 for p in rank)
        keys = np.array(list(pairs), np.int64)
        o = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[o], np.array(list(pairs.values()), np.int64)[o]

    def holds(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between two pieces: walks down both until a merge across it would come first, or none can."""
        a, b = self.rank[before], self.rank[after]
        limit = np.full(len(a), 1 << 40, np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 21 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            torn = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            out[live[torn]] = False
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            take_x = ((x > y) & ~whole_x) | (whole_y & ~whole_x)
            go = ~torn & ~(whole_x & whole_y)
            limit[live] = np.where(take_x, x, y + 1)
            a[live], b[live] = np.where(take_x, self.right[x], x), np.where(take_x, y, self.left[y])
            live = live[go]
        return out

    def segments(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments one after another and their number in each; as many are searched side by side as hold CELLS characters."""
        lens = np.fromiter(map(len, items), np.int64, len(items))
        order = np.argsort(lens, kind="stable")
        found, at = [], 0
        while at < len(order):
            longest = lens[order[at:]] * np.arange(1, len(order) - at + 1)
            to = at + max(1, int(np.searchsorted(longest, CELLS)))
            rows = order[at:to]
            lane, place, ids = self._search([items[k] for k in rows], lens[rows])
            found.append((rows[lane], place, ids))
            at = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane, place, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, lane))
        return ids[order], np.bincount(lane, minlength=len(items))

    def _search(self, items: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, place, id) of every piece, in no order.

        All segments advance by one character at a time. Boundary p of a segment lies in
        column p modulo the window; after every ``longest`` characters the paths that can
        still be extended are walked back until they meet, and what lies before is final.
        The window grows only where paths do not meet.
        """
        u, reach = len(items), self.longest
        flat = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(lens) - lens
        window = 3 * reach
        best = np.full((u, window), -np.inf, np.float64)
        best[:, 0] = 0
        piece, size = np.full((u, window), -1, np.int32), np.zeros((u, window), np.int32)
        base, out = np.zeros(u, np.int64), []

        def commit(rows: np.ndarray, to: np.ndarray) -> None:
            at = to.copy()
            live = np.flatnonzero(at > base[rows])
            while len(live):
                r, p = rows[live], at[live]
                out.append((r, p, piece[r, p % window], flat[begin[r] + p - 1]))
                at[live] = p - size[r, p % window]
                live = live[at[live] > base[rows[live]]]
            base[rows] = to

        rows = np.arange(u)
        for i in range(int(lens.max(initial=0))):
            over = lens[rows] == i
            if over.any():
                commit(rows[over], np.full(int(over.sum()), i))
                rows = rows[~over]
            if i and i % reach == 0:
                self._settle(i, rows, base, size, window, commit)
                if i + reach - base[rows].min() >= window:
                    columns = np.arange(i - window + reach + 1, i + reach) % window
                    to = np.arange(i - window + reach + 1, i + reach) % (2 * window)
                    grown = []
                    for a, empty in ((best, -np.inf), (piece, -1), (size, 0)):
                        b = np.full((u, 2 * window), empty, a.dtype)
                        b[:, to] = a[:, columns]
                        grown.append(b)
                    (best, piece, size), window = grown, 2 * window
            c = (i + reach) % window
            best[rows, c], piece[rows, c], size[rows, c] = -np.inf, -1, 0
            here = i % window
            base_score, before = best[rows, here], piece[rows, here]
            state, single = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            live, rest = np.arange(len(rows)), lens[rows] - i
            for d in range(1, reach + 1):
                live = live[rest[live] >= d]
                key = (state[live] << 21) | flat[begin[rows[live]] + i + d - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                live, at = live[ok], at[ok]
                if not len(live):
                    break
                state[live] = self.next[at]
                ends = self.end[state[live]]
                hit = ends >= 0
                k, e, c = live[hit], ends[hit], (i + d) % window
                if d == 1:
                    single[k] = True
                r = rows[k]
                if self.merging:
                    better = self.holds(before[k], e) if i else np.ones(len(k), bool)
                    score = np.zeros(len(k))
                else:
                    score = base_score[k] + self.scores[e]
                    better = score > best[r, c]
                r, e = r[better], e[better]
                best[r, c], piece[r, c], size[r, c] = score[better], e, d
            c = (i + 1) % window
            none = ~single & (self.merging | (base_score + self.unk_score > best[rows, c]))
            r = rows[none]
            best[r, c], piece[r, c], size[r, c] = base_score[none] + self.unk_score, -1, 1
        commit(rows, lens[rows])
        if not out:
            return (np.zeros(0, np.int64),) * 3
        lane, place, ids, last = (np.concatenate(x) for x in zip(*out))
        place = place * 4
        if len(none := np.flatnonzero(ids < 0)):
            # A character without a piece becomes its bytes, in order.
            parts = [self.bytes[list(chr(c).encode("utf-8", "replace"))] for c in last[none].tolist()]
            n = np.ones(len(ids), np.int64)
            n[none] = [len(p) for p in parts]
            at = np.repeat((np.cumsum(n) - n)[none], n[none])
            lane, place, ids = np.repeat(lane, n), np.repeat(place, n), np.repeat(ids, n).astype(np.int64)
            within = np.arange(len(at)) - np.repeat(np.cumsum(n[none]) - n[none], n[none])
            ids[at + within] = np.concatenate(parts)
            place[at + within] += within
        return lane, place, ids

    def _settle(self, i: int, rows: np.ndarray, base: np.ndarray, size: np.ndarray, window: int, commit) -> None:
        """Commits, per segment, all before the one boundary through which every path runs that ends at i or will be reached from before i."""
        low = int(base[rows].min()) if len(rows) else i
        heads = np.zeros((len(rows), i - low + 1), bool)
        heads[:, -1] = True
        for p in range(i + 1, i + self.longest):
            n = size[rows, p % window]
            k = np.flatnonzero(n)
            heads[k, p - n[k] - low] = True
        count = heads.sum(axis=1)
        for p in range(i, low, -1):
            k = np.flatnonzero((count > 1) & heads[:, p - low])
            if len(k):
                q = p - size[rows[k], p % window] - low
                count[k] -= heads[k, q]
                heads[k, p - low], heads[k, q] = False, True
        met = low + heads.argmax(axis=1)
        k = np.flatnonzero((count == 1) & (met > base[rows]))
        self.commits += len(k)
        commit(rows[k], met[k])

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and offsets. The dummy prefix is added to every row with characters."""
        odd = pc.or_(pc.or_(pc.match_substring(arr, "  "), pc.match_substring(arr, MARK)), pc.or_(pc.starts_with(arr, " "), pc.equal(pc.binary_length(arr), 0)))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.splits)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        lists = pc.split_pattern(arr.take(pa.array(plain)), " ")
        coded = lists.flatten().dictionary_encode()
        flat, off = self._assemble([MARK + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64))
        if not len(rest):
            return flat, off
        names: dict[str, int] = {}
        codes, offs = [], [0]
        for x in arr.take(pa.array(rest)).to_pylist():
            marked = MARK + x.replace(" ", MARK) if x else ""
            codes += [names.setdefault(s, len(names)) for s in (re.findall(f"{MARK}+[^{MARK}]*", marked) if self.splits else [marked] * bool(marked))]
            offs.append(len(codes))
        more, moff = self._assemble(list(names), np.array(codes, np.int64), np.array(offs, np.int64))
        size = np.zeros(len(arr), np.int64)
        size[plain], size[rest] = np.diff(off), np.diff(moff)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), np.int64)
        for rows, ids, o in ((plain, flat, off), (rest, more, moff)):
            n = size[rows]
            out[np.repeat(ends[rows] - n - o[:-1], n) + np.arange(len(ids))] = ids
        return out, np.append(0, ends)

    def _assemble(self, names, codes, offsets):
        slot = self.memo.slots((names, self.segments))[codes]
        flat, ends = spread(self.memo.table, self.memo.start[slot], self.memo.size[slot])
        return flat, ends[offsets - offsets[0]]

    def decode(self, ids) -> str:
        raw = b"".join([self.out[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, text)`` for each row: the ids of the whole text, and what they decode to.

    Null and empty texts have no ids and decode to an empty text. Repeated rows and null
    doc_ids are encoded like any other; an empty table gives no rows; other columns are
    not read.
    """
    ship(docs.sparkSession)

    def run(it):
        c = codec(model)
        for b in slices(it, "text", 2 << 20):
            flat, off = c.encode(texts(b))
            all_ids, at = flat.tolist(), off.tolist()
            back = [c.decode(all_ids[a:z]) for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32))), pa.array(back, pa.string())], ["doc_id", "ids", "text"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_equals.

    A null or empty text has no ids; repeated rows and null doc_ids count like any other; an
    empty table gives no rows; other columns are not read. decoded_equals is whether decoding gives the text again (null as empty). It is false
    only where the text itself holds the space mark U+2581, which decodes to a space.
    """
    ship(docs.sparkSession)

    def run(it):
        c = codec(model)
        for b in slices(it, "text", 2 << 20):
            arr = texts(b)
            flat, off = c.encode(arr)
            n, crc, same = np.diff(off), [], []
            for i, x in enumerate(arr.to_pylist()):
                ids = flat[off[i] : off[i + 1]]
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(c.decode(ids.tolist()) == x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "decoded_equals"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_equals boolean")
