"""Exact removal of repeated 100-byte strings, by suffix arrays over what can repeat at all.

A window is a string of L bytes in one document. Its anchor is the K-byte gram in it with
the least hash (leftmost on ties), so equal windows have equal anchors at equal offsets.
Consecutive windows on one anchor form a run of at most L - K + 1 windows; its content
holds all of their bytes.

1. Anchors that occur once in the corpus cannot lie in a repeated window; their runs end
   here. Occurrences are counted over all documents.
2. Of runs with equal anchor and content only the first needs comparing: the windows of
   the others all start earlier elsewhere.
3. First runs whose anchor has other contents are compared byte by byte: their contents go
   to shards by anchor, each shard builds a suffix array (Larsson-Sadakane refinement of
   eight-byte ranks in numpy) and common prefixes (Kasai, many stretches of text in
   lockstep), and neighbours that share L bytes are one window. An anchor with very many
   contents is spread over several shards, whose sorted windows are then merged by binary
   search. Other shards share no windows, so they need no merging.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlint.llm.common import _BASE, _INVERSE, byte_table, in_filter, mix, power, signed, slices, texts, write_filter
from sparrowlint.runtime import Workspace, ship

L, K = 100, 48
CHUNK = 1 << 21
SHARD_BYTES, HOT = 1 << 20, 4096
#: The least words with one, two, up to eight bytes.
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)

def minima(h: np.ndarray, w: int, step: int = 1 << 27) -> np.ndarray:
    """Of every w values in a row the place of the least by its upper 36 bits, leftmost on ties; a step at a time, as places take 28 bits."""
    low, out = np.uint64((1 << 28) - 1), []
    for a in range(0, max(1, len(h) - w + 1), step):
        part = h[a : a + step + w - 1]
        x = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        k = 1
        while 2 * k <= w:
            x = np.minimum(x[:-k], x[k:])
            k *= 2
        if k < w:
            x = np.minimum(x[: len(x) - (w - k)], x[w - k :])
        out.append((x & low).astype(np.int64) + a)
    return np.concatenate(out)


def runs(raw: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of documents laid one after another: anchor, content, row, start in the row, number of windows."""
    n, w = len(raw), L - K + 1
    none = np.zeros(0, np.int64)
    if n < L:
        return {"a": none, "r": none, "row": none, "s": none, "n": none, "at": none}
    pw, inv = power(_BASE, n + 1), power(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_table(17)[raw] * pw[:n], dtype=np.uint64, out=sums[1:])
    grams = mix((sums[K:] - sums[:-K]) * inv[: n - K + 1])
    q = minima(grams, w)
    starts = np.append(0, ends[:-1])
    row = np.searchsorted(ends, np.arange(len(q)), side="right")
    inside = np.arange(len(q)) + L <= ends[row]
    new = inside.copy()
    new[1:] &= (q[1:] != q[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    if not len(s):
        return {"a": none, "r": none, "row": none, "s": none, "n": none, "at": none}
    e = np.minimum(np.append(s[1:], n), (ends - L + 1)[row[s]])
    content = mix((sums[e + L - 1] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return {"a": signed(grams[q[s]]), "r": signed(content), "row": row[s], "s": s - starts[row[s]], "n": e - s, "at": s}


def _raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off[1:] - off[0]


def _place(did: np.ndarray, tie: np.ndarray, s: np.ndarray) -> np.ndarray:
    return signed(mix(mix(did.view(np.uint64) ^ mix(tie.view(np.uint64))) + s.astype(np.uint64)))


def suffix_array(b: np.ndarray, depth: int = L) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of at least their first ``depth`` bytes, and eight bytes from each position as one number.

    Sorted by eight bytes first; then groups still unsorted, and only those, are sorted by
    the rank of the position h further, h doubling.
    """
    n = len(b)
    pad = np.concatenate([b, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | pad[k : k + n]
    sa = np.argsort(word, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    new = np.ones(n, bool)
    new[1:] = word[sa[1:]] != word[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        pos = sa[at]
        key = (rank[pos] << 32) | rank[np.minimum(pos + h, n)]
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[at] = pos
        step = np.ones(len(at), bool)
        step[1:] = key[1:] != key[:-1]
        new[at] |= step
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa[at]] = first[at] + 1
        h *= 2
    return sa, word


def common_prefixes(b: np.ndarray, sa: np.ndarray, word: np.ndarray, cap: int = L, stretch: int = 256) -> np.ndarray:
    """Kasai: the bytes that each suffix in the array shares with the one before it, up to ``cap``.

    Every stretch of text carries its own match length from position to position; all
    stretches advance together. A length carries over to the next position only where the
    one compared there last, a byte further, is before it in the array: suffixes that share
    more than the array's depth are in any order, and those of their next bytes may not be.
    """
    n = len(b)
    out, place = np.zeros(n, np.int64), np.empty(n, np.int64)
    place[sa] = np.arange(n)
    begins = np.arange(0, n, stretch)
    h, last = np.zeros(len(begins), np.int64), np.full(len(begins), n - 1)
    for t in range(stretch):
        i = begins + t
        live = np.flatnonzero((i < n) & (place[np.minimum(i, n - 1)] > 0))
        ii = i[live]
        jj = sa[place[ii] - 1]
        after = last[live] + 1
        g = np.where((after < n) & (place[np.minimum(after, n - 1)] < place[ii]), np.maximum(h[live] - 1, 0), 0)
        todo = np.arange(len(live))
        while len(todo):
            a, c = ii[todo] + g[todo], jj[todo] + g[todo]
            left = np.minimum(n - a, n - c)
            a, c = np.minimum(a, n - 1), np.minimum(c, n - 1)
            same = 8 - np.searchsorted(_BYTES, word[a] ^ word[c], side="right")
            same = np.minimum(same, np.maximum(left, 0))
            g[todo] = np.minimum(g[todo] + same, cap)
            todo = todo[(same == 8) & (g[todo] < cap)]
        h[:] = 0
        h[live], last[live] = g, jj
        out[place[ii]] = g
    return out


def windows_in(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all windows in the joined contents, in suffix order, and the first of the equal ones for each; where each content begins."""
    b = np.frombuffer(b"".join(contents), np.uint8)
    lens = np.array([len(c) for c in contents], np.int64)
    begins = np.cumsum(lens) - lens
    sa, word = suffix_array(b)
    same = common_prefixes(b, sa, word) >= L
    group = np.cumsum(~same) - 1
    valid = np.zeros(len(b), bool)
    valid[np.repeat(begins, lens - L + 1) + np.arange(int((lens - L + 1).sum())) - np.repeat(np.cumsum(lens - L + 1) - (lens - L + 1), lens - L + 1)] = True
    keep = valid[sa]
    pos, group = sa[keep], group[keep]
    first = np.full(int(group.max()) + 1 if len(group) else 0, len(b), np.int64)
    np.minimum.at(first, group, pos)
    return pos, first[group], begins


def _stretches(pos: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window positions as maximal stretches within one content: the content, first and last offset."""
    pos = np.sort(pos)
    c = np.searchsorted(begins, pos, side="right") - 1
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1] + 1) | (c[1:] != c[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(pos)) - 1
    return c[s], pos[s] - begins[c[s]], pos[e] - begins[c[s]]


def repeated_spans(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``(did, tie, spans array<struct<s, e>>)``: byte ranges [s, e) to remove, of the documents that have any."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("tie"), "text")

    def anchors(it):
        for b in slices(it, "text", CHUNK):
            a, c = np.unique(runs(*_raw(texts(b)))["a"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.minimum(c, 2).astype(np.int8))], ["a", "c"])

    twice = ws.table(source.select("text").mapInArrow(anchors, "a long, c byte").groupBy("a").agg(F.sum("c").alias("c")).where("c > 1").select("a"), "twice", dictionary=False)
    maybe = write_filter(twice, "a", ws, "maybe", 8)
    ws.drop("twice")

    def repeated(it):
        for b in slices(it, "text", CHUNK):
            f = runs(*_raw(texts(b)))
            ok = in_filter(maybe, f["a"])
            did, tie = (b.column(c).to_numpy()[f["row"][ok]] for c in ("did", "tie"))
            s = f["s"][ok]
            yield pa.RecordBatch.from_arrays([pa.array(f["a"][ok]), pa.array(f["r"][ok]), pa.array(did), pa.array(tie), pa.array(s.astype(np.int32)), pa.array(f["n"][ok].astype(np.int16)), pa.array(_place(did, tie, s))], ["a", "r", "did", "tie", "s", "n", "p"])

    found = ws.table(source.mapInArrow(repeated, "a long, r long, did long, tie long, s int, n short, p long"), "runs")
    variants = found.groupBy("a", "r").agg(F.min(F.struct("did", "tie", "s", "p", "n")).alias("first"), F.count("*").alias("c"))
    variants = ws.table(variants, "variants")
    later = found.join(variants.where("c > 1").select("a", "r", F.col("first.p").alias("p0")), ["a", "r"]).where("p <> p0")
    spans = later.select("did", "tie", "s", (F.col("s") + F.col("n") + (L - 1)).cast("int").alias("e"))

    several = ws.table(variants.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several")
    flagged = ws.table(variants.join(several.select("a"), "a", "left_semi").select(F.col("first.p").alias("p")), "flagged", dictionary=False)
    wanted = write_filter(flagged, "p", ws, "wanted", 16)
    ws.drop("flagged")

    def contents(it):
        for b in slices(it, "text", CHUNK):
            raw, ends = _raw(texts(b))
            f = runs(raw, ends)
            did, tie = (b.column(c).to_numpy()[f["row"]] for c in ("did", "tie"))
            p = _place(did, tie, f["s"])
            ok = np.flatnonzero(in_filter(maybe, f["a"]) & in_filter(wanted, p))
            data = raw.tobytes()
            body = [data[f["at"][i] : f["at"][i] + f["n"][i] + L - 1] for i in ok]
            yield pa.RecordBatch.from_arrays([pa.array(f["a"][ok]), pa.array(did[ok]), pa.array(tie[ok]), pa.array(f["s"][ok].astype(np.int32)), pa.array(p[ok]), pa.array(body, pa.binary())], ["a", "did", "tie", "s", "p", "body"])

    body = ws.table(source.mapInArrow(contents, "a long, did long, tie long, s int, p long, body binary"), "contents")
    total = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    hot = several.where(F.col("m") > HOT).select("a", F.ceil(F.col("m") / HOT).cast("int").alias("ways"))
    body = body.join(hot, "a", "left").withColumn("shard", F.pmod(F.xxhash64("a", F.when(F.col("ways").isNotNull(), F.pmod("p", F.col("ways")))), F.lit(shards)))

    def shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("did", "ascending"), ("tie", "ascending"), ("s", "ascending")])
        c = t.column("body").combine_chunks().to_pylist()
        pos, first, begins = windows_in(c)
        did, tie, s = (t.column(x).to_numpy() for x in ("did", "tie", "s"))
        k, lo, hi = _stretches(pos[pos != first], begins)
        rows = [did[k], tie[k], s[k] + lo, s[k] + hi + L]
        ways = t.column("ways").to_pandas().notna().to_numpy()
        lead = pos[pos == first]
        own = np.searchsorted(begins, lead, side="right") - 1
        lead, own = lead[ways[own]], own[ways[own]]
        data = b"".join(c)
        names = [hashlib.blake2b(data[i : i + L], digest_size=16).digest() for i in lead.tolist()]
        n, m = len(k), len(lead)
        at = s[own] + lead - begins[own]
        cat = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int64))
        return pa.table({"did": cat(rows[0], did[own]), "tie": cat(rows[1], tie[own]), "s": cat(rows[2], at), "e": cat(rows[3], at + L), "name": pa.array([None] * n + names, pa.binary()), "shard": pa.array(np.full(n + m, t.column("shard")[0].as_py()))})

    def merge(t: pa.Table) -> pa.Table:
        """Sorted windows of several shards, merged one shard at a time by binary search; all but the first of equal ones are repeats."""
        t = t.sort_by([("did", "ascending"), ("tie", "ascending"), ("s", "ascending")])
        names = np.array(t.column("name").to_pylist(), dtype="S16")
        parts = t.column("shard").to_numpy()
        seen, owner, drop = names[:0], np.zeros(0, np.int64), []
        for k in np.unique(parts):
            mine = np.flatnonzero(parts == k)
            mine = mine[np.argsort(names[mine], kind="stable")]
            at = np.minimum(np.searchsorted(seen, names[mine]), max(0, len(seen) - 1))
            same = seen[at] == names[mine] if len(seen) else np.zeros(len(mine), bool)
            drop.append(np.maximum(owner[at[same]], mine[same]))
            owner[at[same]] = np.minimum(owner[at[same]], mine[same])
            where = np.searchsorted(seen, names[mine[~same]])
            seen, owner = np.insert(seen, where, names[mine[~same]]), np.insert(owner, where, mine[~same])
        return t.take(pa.array(np.concatenate(drop))).select(["did", "tie", "s", "e"])

    schema = "did long, tie long, s long, e long, name binary, shard long"
    compared = ws.table(body.select("shard", "did", "tie", "s", "body", "ways").groupBy("shard").applyInArrow(shard, schema), "compared")
    leads = compared.where("name is not null")
    tasks = max(1, -(-leads.count() // 50_000))
    merged = leads.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(tasks))).groupBy("part").applyInArrow(merge, "did long, tie long, s long, e long")
    every = spans.select("did", "tie", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).unionByName(compared.where("name is null").select("did", "tie", "s", "e")).unionByName(merged)
    out = ws.table(every.groupBy("did", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    ws.drop("runs", "variants", "several", "contents", "compared", "maybe.filter", "wanted.filter")
    return out


def _cut(text: bytes, spans) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes left."""
    parts, at, removed, count = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        if s > end:
            count += 1
            parts.append(text[at:s])
        removed += max(0, e - max(s, end))
        end = max(end, e)
        at = end
    parts.append(text[at:])
    return removed, count, b"".join(parts)


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; with_bytes adds ``kept``, the bytes left.

    A byte goes if a string of 100 bytes that covers it also starts earlier: at a smaller
    doc_id, or earlier in the same document; overlaps count, and strings are judged on the
    input. A null text counts as empty; texts under 100 bytes keep everything. A null
    doc_id comes before all others; rows of one doc_id with different texts follow each
    other by the hash of their text, and rows that repeat both are one document. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "substrings")
    spans = repeated_spans(docs.select("doc_id", "text"), ws)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("tie"))
    joined = keyed.join(spans, ["did", "tie"], "left").select("doc_id", "text", "spans")

    def cut(it):
        for b in slices(it, "text"):
            rows = []
            for x, spans in zip(texts(b).to_pylist(), b.column("spans").to_pylist()):
                raw = x.encode()
                removed, count, kept = _cut(raw, [(p["s"], p["e"]) for p in spans or ()])
                rows.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows))
            arrays = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())] + [pa.array(cols[4], pa.binary())] * with_bytes
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
