"""Token ids in a content-addressed store.

A document's id stream is cut where a rolling hash over its last 32 ids has its low bits
set, so equal passages give equal chunks wherever they stand. The store has

- ``packs/N.pack``: the unique chunks whose first occurrence lies in staged file N:
  ``MAGIC``, then payloads one after another, each the width of an id in bytes (2 or 4)
  and a zstd frame of the ids as little-endian integers of that width. A chunk's name is
  the BLAKE2b-128 digest of its ids at width 4; it is stored once.
- ``recipes`` (Parquet, in doc_id order): per document the part and range it lies in,
  where its ids begin in the part, their number, where each of its chunks lies (digest,
  pack, offset, length), and the Merkle root over its chunk digests.
- ``manifest`` (Parquet): ``ranges``, the root over each 4,096 documents that follow one
  another; ``parts``, where each part begins in the whole stream and the root over its
  ranges; ``store``, the root over the parts.

Reading recomputes the roots up to the store's from the recipes, then resolves recipes
against pack files by offset, so no payload is ever shuffled; every chunk's digest and
every document's root is checked.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowlint.llm.common import file_system, mix, slices, spread, string_hashes, texts, words
from sparrowlint.runtime import Workspace, ship

MAGIC = b"CASPACK1"
WINDOW, MASK_BITS, LEAST, MOST = 32, 8, 64, 4096
RANGE_BITS = 12
MEMO, STEP = 1_000_000, 4 << 20


def cut_points(ids: np.ndarray) -> np.ndarray:
    """The ends that the rolling hash proposes; those in the first WINDOW ids of a stream count for nothing, as LEAST is larger."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    k = 1
    while k < min(WINDOW, len(h)):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        k *= 2
    return np.flatnonzero((mix(h) >> np.uint64(64 - MASK_BITS)) == 0) + 1


def ends_of(points, begin: int, end: int) -> list[int]:
    """The ends of the chunks of the stream from begin to end: content-defined, from LEAST to MOST ids long."""
    out, at = [], begin
    for c in [*points, end]:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST or c == end and c > at:
            out.append(c)
            at = c
    return out


def cuts(ids: np.ndarray) -> np.ndarray:
    return np.array(ends_of(cut_points(ids).tolist(), 0, len(ids)), np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node moves up alone, no leaves hash as the empty string."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _classes() -> np.ndarray:
    """Of each byte: 1 letter, 2 digit, 3 other, 4 lead byte of Latin-1 letters, 0 what single bytes cannot tell."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = 3
    out[ord("'")] = 0
    for a, z, k in (("0", "9", 2), ("A", "Z", 1), ("a", "z", 1)):
        out[ord(a) : ord(z) + 1] = k
    out[0xC3] = 4
    return out


def _raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins in them, with the end."""
    off = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


class Pieces:
    """The ids of strings seen before, in one table; past ``most`` strings only those of the last batch are kept.

    Strings are found by a sorted 64-bit hash and compared byte by byte. One whose hash
    another string has already is not found again, but encoded whenever it comes.
    """

    def __init__(self, most: int):
        self.most = most
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.off, self.hash = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        self.table, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.zeros(0, np.int64)

    def _find(self, raw: np.ndarray, off: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each string, -1 of new ones."""
        if not len(self.key) or not len(h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        slot = self.slot[at]
        ok = (self.key[at] == h) & (np.diff(self.off)[slot] == np.diff(off))
        rows = np.flatnonzero(ok)
        size = np.diff(off)[rows]
        mine, ends = spread(raw, off[:-1][rows], size)
        differ = np.flatnonzero(mine != spread(self.raw, self.off[:-1][slot[rows]], size)[0])
        ok[rows[np.searchsorted(ends, differ, side="right") - 1]] = False
        return np.where(ok, slot, -1)

    def slots(self, strings: pa.Array, encode) -> np.ndarray:
        """Where each of the distinct strings lies in start and size; encode takes the rows of new ones and gives ids and sizes."""
        (raw, off), h = _raw(strings), string_hashes(strings, seed=5)
        if len(self.hash) + len(h) > self.most and len(self.hash):
            keep = self.last
            self.table, ends = spread(self.table, self.start[keep], self.size[keep])
            self.start, self.size = ends[:-1], np.diff(ends)
            self.raw, self.off = spread(self.raw, self.off[:-1][keep], np.diff(self.off)[keep])
            self.hash = self.hash[keep]
            self.key, self.slot = np.unique(self.hash, return_index=True)
        out = self._find(raw, off, h)
        new = np.flatnonzero(out < 0)
        if len(new):
            ids, size = encode(new)
            out[new] = len(self.hash) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.table) + np.cumsum(size) - size])
            self.size, self.table = np.concatenate([self.size, size]), np.concatenate([self.table, ids])
            more, ends = spread(raw, off[:-1][new], np.diff(off)[new])
            self.raw, self.off = np.concatenate([self.raw, more]), np.concatenate([self.off, self.off[-1] + ends[1:]])
            self.hash = np.concatenate([self.hash, h[new]])
            # Only hashes that the index lacks join it, where they sort.
            fresh, first = np.unique(h[new], return_index=True)
            at = np.searchsorted(self.key, fresh)
            lack = (np.append(self.key, np.uint64(0))[at] != fresh) | (at == len(self.key))
            self.key, self.slot = np.insert(self.key, at[lack], fresh[lack]), np.insert(self.slot, at[lack], out[new[first[lack]]])
        self.last = out
        return out


class Encoder:
    """Encodes each distinct piece of the texts once, as long as it is remembered.

    Where the tokenizer's pre-tokens never span white space and no token keeps any, as
    tested on construction, the pieces are words. Where it lower-cases and then parts
    letters, single digits and the rest, as its file says, words of printable ASCII and
    Latin-1 letters without apostrophes are parted likewise and the pieces are pre-tokens:
    many go to the library in one text, and the marks of word ends part their ids again.
    They are lower-cased and parted already, so that text needs no normalizer and its
    pre-tokens end at the spaces.
    Other tokenizers encode whole texts.
    """

    PROBE = ["Ab cd", "a  b\n\nc", "it's a\tb", " lead", "x, y.z 12 3"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [a for a in self.tok.get_added_tokens_decoder().values()]
        self.added = [a.content for a in added]
        self.by_word = all(sum((self.whole([w])[0] for w in t.split()), []) == self.whole([t])[0] for t in self.PROBE) and not any(any(c.isspace() for c in a.content) or a.lstrip or a.rstrip or a.single_word for a in added)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        end = spec["model"].get("end_of_word_suffix")
        self.by_piece = self.by_word and bool(end) and norms == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and (parts[0].get("pattern") or {}).get("Regex") == self.SPLIT and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = bool(end) and token.endswith(end)
        self.classes = _classes()
        self.memo = Pieces(MEMO)
        self.plain = self.tok
        if self.by_piece:
            from tokenizers import normalizers, pre_tokenizers

            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, items: list[str], plain: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.plain if plain else self.tok).encode_batch_fast(items, add_special_tokens=False)]

    def _pretokens(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that are one pre-token each."""
        got = [np.array(x, np.uint32) for x in self.whole([" ".join(items[i : i + 4096]) for i in range(0, len(items), 4096)], plain=True)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(size) == len(items) and size.sum() == len(ids):
            return ids, size
        return self._each(items)

    def _each(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x for i in range(0, len(items), 4096) for x in self.whole(items[i : i + 4096])]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size

    def _split(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
        """The pieces of each distinct word: codes into the distinct pieces, offsets by word, the pieces, and how many are pre-tokens."""
        n = len(distinct)
        if not self.by_piece or not n:
            return np.arange(n), np.arange(n + 1), distinct, 0
        raw, off = _raw(distinct)
        raw = raw.copy()
        kind = self.classes[raw]
        after = np.append(False, kind[:-1] == 4) & (raw >= 0x80) & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7)
        kind[after] = 1
        simple = np.logical_and.reduceat(kind > 0, off[:-1])
        for content in self.added:
            simple &= ~pc.match_substring(distinct, content).to_numpy(zero_copy_only=False)
        kind[kind == 4] = 1
        raw[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
        raw[after & (raw < 0x9F)] += 0x20
        new = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        new[off[:-1]] = True
        per = np.add.reduceat(new, off[:-1], dtype=np.int64)
        odd = np.flatnonzero(~simple)
        flat = raw
        if len(odd):
            keep = np.repeat(simple, np.diff(off))
            flat, new = raw[keep], new[keep]
            per[odd] = 1
        at = np.append(np.flatnonzero(new), len(flat)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(flat)).dictionary_encode()
        one = len(pieces.dictionary)
        ends = np.append(0, np.cumsum(per))
        if not len(odd):
            return pieces.indices.to_numpy(), ends, pieces.dictionary, one
        codes = np.empty(int(ends[-1]), np.int64)
        rare = ends[1:][odd] - 1
        codes[rare] = one + np.arange(len(odd))
        common = np.ones(len(codes), bool)
        common[rare] = False
        codes[common] = pieces.indices.to_numpy()
        return codes, ends, pa.concat_arrays([pieces.dictionary, distinct.take(pa.array(odd))]), one

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and the offset of each row."""
        if not self.by_word:
            flat, size = self._each(arr.to_pylist())
            return flat, np.append(0, np.cumsum(size))
        codes, offsets, distinct = words(arr)
        parts, off, pieces, one = self._split(distinct)

        def new(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            names, k = pieces.take(pa.array(rows)).to_pylist(), int(np.searchsorted(rows, one))
            got = [self._pretokens(names[:k]), self._each(names[k:])]
            return np.concatenate([ids for ids, _ in got]), np.concatenate([size for _, size in got])

        slot = self.memo.slots(pieces, new)[parts]
        table, by_part = spread(self.memo.table, self.memo.start[slot], self.memo.size[slot])
        off = by_part[off]
        flat, by_word = spread(table, off[:-1][codes], np.diff(off)[codes])
        return flat, by_word[offsets]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _stage(path: str, end_id: int):
    def run(it):
        enc = encoder(path)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in slices(it, "text", STEP):
            ids, off = enc.encode(texts(b))
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            width = 2 if ids.max() < 65536 else 4
            long, short, mark = ids.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes(), bytes([width])
            points = cut_points(ids)
            at = np.searchsorted(points, off, side="right").tolist()
            points, off = points.tolist(), off.tolist()
            blobs, names, sizes = [], [], []
            for i in range(b.num_rows):
                ends = ends_of(points[at[i] : at[i + 1]], off[i], off[i + 1])
                begins = [off[i], *ends[:-1]]
                packed = [mark + squeeze(short[width * a : width * z]) for a, z in zip(begins, ends)]
                blobs.append(b"".join(packed))
                sizes.append([len(p) for p in packed])
                names.append([digest(long[4 * a : 4 * z]) for a, z in zip(begins, ends)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(sizes, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.binary())), pa.array([merkle(x) for x in names], pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "sizes", "names", "root", "blob"])

    return run


STAGED = "doc_id long, n_tokens long, sizes array<int>, names array<binary>, root binary, blob binary"
RECIPES = "doc_id long, n_tokens long, chunks array<struct<pos: int, name: binary, pack: int, offset: bigint, size: int>>, root binary"


def _number(it):
    """Adds the part, the range of 4,096 documents in it, the place in the range, and where the document's ids begin in the part."""
    part, n, at = TaskContext.get().partitionId(), 0, 0
    for b in it:
        size = b.column("n_tokens").to_numpy()
        k = np.arange(n, n + b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(k >> RANGE_BITS), pa.array(k), pa.array(at + np.cumsum(size) - size)], [*b.schema.names, "part", "range", "k", "inner"])
        n, at = n + b.num_rows, at + int(size.sum())


def _roots(it):
    for b in it:
        roots = [merkle([x["root"] for x in sorted(rows, key=lambda x: x["k"])]) for rows in b.column("leaves").to_pylist()]
        yield b.drop_columns(["leaves"]).append_column("root", pa.array(roots, pa.binary()))


def levels(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Merkle roots of ranges and of parts, from the documents' roots: no group holds more than 4,096 documents, or the ranges of one part."""
    sums = "long, n_docs long, n_tokens long, root binary"
    ranges = recipes.groupBy("part", "range").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("k", "root")).alias("leaves")).mapInArrow(_roots, f"part long, range {sums}")
    parts = ranges.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct(F.col("range").alias("k"), "root")).alias("leaves")).mapInArrow(_roots, f"part {sums}")
    return ranges, parts


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, ws: Workspace) -> None:
    """Encode the documents and write packs, recipes and manifest under ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.select("doc_id", "text").mapInArrow(_stage(tokenizer, end_id), STAGED).write.mode("overwrite").option("compression", "none").parquet(ws.at("staged"))
    # One write gives all its files one name but for the number of the task.
    named = spark.read.schema(STAGED).parquet(ws.at("staged")).select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_name").alias("as"))
    one = named.select("as").first()
    tail = re.sub(r"^part-\d+", "", one["as"]) if one else ""
    staged = named.select("doc_id", "n_tokens", "sizes", "names", "root", "file", "row")
    each = staged.select("file", "row", F.posexplode(F.arrays_zip("names", "sizes")).alias("pos", "c")).select("file", "row", "pos", F.col("c.names").alias("name"), F.col("c.sizes").alias("size"))
    owners = ws.table(each.groupBy("name").agg(F.min(F.struct("file", "row", "pos", "size")).alias("at")), "owners")
    # A pack holds its file's chunks in order of (row, pos): offsets are sums within the file.
    rows = owners.groupBy("at.file", "at.row").agg(F.array_sort(F.collect_list(F.struct("at.pos", "name", "at.size"))).alias("own"))
    rows = rows.withColumn("bytes", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["size"]))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("bytes").over(w), F.lit(0)) + len(MAGIC))
    placed = ws.table(placed.select("file", "row", "own", "at"), "placed")
    source, target = ws.at("staged"), f"{path}/packs"

    def pack(t: pa.Table) -> pa.Table:
        n = t.column("file")[0].as_py()
        order = pc.sort_indices(t.column("row"))
        rows = t.column("row").take(order).to_pylist()
        picks = [[o["pos"] for o in x] for x in t.column("own").take(order).to_pylist()]
        (fs, root), (out_fs, packs) = file_system(source), file_system(target)
        out_fs.create_dir(packs)
        tmp, at, k = f"{packs}/.{n}.{os.getpid()}.{TaskContext.get().taskAttemptId()}.tmp", 0, 0
        with out_fs.open_output_stream(tmp) as out, fs.open_input_file(f"{root}/part-{n:05d}{tail}") as f:
            out.write(MAGIC)
            for batch in pq.ParquetFile(f).iter_batches(512, columns=["sizes", "blob"]):
                while k < len(rows) and rows[k] < at + batch.num_rows:
                    i = rows[k] - at
                    sizes, blob = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    ends = np.cumsum(sizes)
                    for p in picks[k]:
                        out.write(blob[ends[p] - sizes[p] : ends[p]])
                    k += 1
                at += batch.num_rows
        out_fs.move(tmp, f"{packs}/{n}.pack")
        return pa.table({"file": pa.array([n], pa.int32())})

    placed.select("file", "row", F.transform("own", lambda o: F.struct(o["pos"].alias("pos"))).alias("own")).groupBy("file").applyInArrow(pack, "file int").write.mode("overwrite").format("noop").save()

    spread = placed.select("file", "at", F.posexplode("own").alias("k", "o"), "own").select(F.col("o.name").alias("name"), F.col("file").alias("pack"), (F.col("at") + F.aggregate(F.slice("own", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["size"])).alias("offset"), F.col("o.size").alias("size"))
    where = each.select("file", "row", "pos", "name").join(spread, "name").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "pack", "offset", "size"))).alias("chunks"))
    recipes = staged.select("doc_id", "n_tokens", "root", "file", "row").join(where, ["file", "row"])
    # Ranges are cut over (doc_id, file, row), so rows of one or no doc_id also spread; what lies before a part is summed over parts.
    recipes = recipes.repartitionByRange(parts, "doc_id", "file", "row").sortWithinPartitions("doc_id", "file", "row").select("doc_id", "n_tokens", "chunks", "root")
    recipes.mapInArrow(_number, f"{RECIPES}, part long, range long, k long, inner long").write.mode("overwrite").parquet(f"{path}/recipes")
    ranges, by_part = levels(spark.read.parquet(f"{path}/recipes"))
    ranges.write.mode("overwrite").parquet(f"{path}/manifest/ranges")
    found = sorted(by_part.collect(), key=lambda r: r.part)
    base = np.cumsum([0] + [r.n_tokens for r in found]).tolist()
    spark.createDataFrame([(r.part, b, r.n_docs, r.n_tokens, r.root) for r, b in zip(found, base)], "part long, start long, n_docs long, n_tokens long, root binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/parts")
    spark.createDataFrame([(sum(r.n_docs for r in found), base[-1], merkle([r.root for r in found]))], "n_docs long, n_tokens long, root binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/store")
    ws.drop("staged", "owners", "placed")


FETCH_ROWS = 256


def _fetch(path: str, bases: dict[int, int], digests: bool):
    def run(it):
        expand = zstandard.ZstdDecompressor().decompress
        (fs, packs), handles = file_system(path), {}
        for b in (batch.slice(i, FETCH_ROWS) for batch in it for i in range(0, batch.num_rows, FETCH_ROWS)):
            out, want = [], b.column("n_tokens").to_pylist()
            for n, chunks, root in zip(want, b.column("chunks").to_pylist(), b.column("root").to_pylist()):
                parts = []
                for c in chunks:
                    f = handles.get(c["pack"])
                    if f is None:
                        if len(handles) > 256:
                            handles.popitem()[1].close()
                        f = handles[c["pack"]] = fs.open_input_file(f"{packs}/{c['pack']}.pack")
                    raw = f.read_at(c["size"], c["offset"])
                    try:
                        raw = np.frombuffer(expand(raw[1:]), f"<u{raw[0]}").astype("<u4").tobytes()
                    except (zstandard.ZstdError, ValueError, TypeError, IndexError) as e:
                        raise ValueError(f"pack {c['pack']}: the chunk at {c['offset']} is broken") from e
                    if digest(raw) != c["name"]:
                        raise ValueError(f"pack {c['pack']}: the chunk at {c['offset']} does not have its digest")
                    parts.append(raw)
                ids = b"".join(parts)
                if len(ids) != 4 * n or merkle([c["name"] for c in chunks]) != root:
                    raise ValueError("a document does not match its root")
                out.append(zlib.crc32(ids) if digests else ids)
            start = [bases[p] + s for p, s in zip(b.column("part").to_pylist(), b.column("inner").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(start, pa.int64()), b.column("n_tokens"), pa.array(out, pa.int64() if digests else pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def read_store(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files alone; ids are little-endian unsigned 32-bit integers. With digests, their CRC-32 instead.

    Raises ValueError where the manifest does not match the recipes; a task fails where a
    chunk, its place or a document's recipe was changed.
    """
    ship(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = sorted(spark.read.parquet(f"{path}/manifest/parts").collect(), key=lambda r: r.part)
    store = spark.read.parquet(f"{path}/manifest/store").first()
    ranges, by_part = levels(recipes)
    found = sorted(by_part.collect(), key=lambda r: r.part)
    if [tuple(r) for r in found] != [(r.part, r.n_docs, r.n_tokens, r.root) for r in parts] or merkle([r.root for r in found]) != store.root or np.cumsum([0] + [r.n_tokens for r in found]).tolist() != [*(r.start for r in parts), store.n_tokens]:
        kept = spark.read.parquet(f"{path}/manifest/ranges")
        bad = [tuple(r) for r in ranges.exceptAll(kept).select("part", "range").limit(5).collect()]
        raise ValueError(f"the recipes do not match the manifest; first ranges that differ: {bad}")
    rows = recipes.select("doc_id", "n_tokens", "chunks", "root", "part", "inner")
    return rows.mapInArrow(_fetch(f"{path}/packs", {r.part: r.start for r in parts}, digests), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary"))


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode, store, read back: doc_id, start, n_tokens, ids_crc32 per document.

    A null or empty text has the end id alone. Rows that repeat a doc_id are documents of
    their own, one after another; a null doc_id comes first. An empty table gives an empty
    store. Other columns are not read. The text is tokenized whole, with the library's
    defaults but for add_special_tokens=False.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "tokens")
    write_store(docs, tokenizer, end_id, ws.at("store"), ws)
    return read_store(spark, ws.at("store"), digests=True)
