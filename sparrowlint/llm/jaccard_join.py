"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct shingles. A pair with similarity t shares a token
among the first n - ceil(t n) + 1 tokens of both sets under *any* total order. The first
order is rarest first, with rarity read from a sketch of fixed size that counts every
document; it drives the candidate join, so a passage that many documents share takes
part only where a document has little else. The candidates are then intersected with
the prefix filters of further hashed orders, for which only those prefixes, a tenth of
the sets each, are fetched; whole sets are fetched and compared for what passes all.

Equal sets are one class throughout: copies are counted, never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowlint.llm.common import bitmap_of, free_name, in_bitmap, mix, rows_of, segment_hashes, signed, slices, string_hashes, texts, window_hashes, words
from sparrowlint.llm.components import connected_components
from sparrowlint.runtime import Workspace, ship

SKETCH_BITS = 21
_SLOT_BITS = 14
ORDERS = (0x51ED270B, 0x2545F491)
SEEN = 1 << 16


def shingle_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, as one flat array with offsets."""
    codes, offsets, distinct = words(pc.ascii_lower(arr))
    h = string_hashes(distinct)[codes]
    n = np.diff(offsets)
    row = rows_of(offsets)
    w = window_hashes(h, k)
    inside = np.arange(len(w)) + k <= offsets[1:][row[: len(w)]]
    w, wrow = w[inside], row[: len(inside)][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        w = np.concatenate([w, segment_hashes(h, offsets[:-1][short], offsets[1:][short])])
        wrow = np.concatenate([wrow, short])
    order = np.lexsort((w, wrow))
    w, wrow = w[order], wrow[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (wrow[1:] != wrow[:-1])
    w, wrow = w[new], wrow[new]
    return w, np.concatenate([[0], np.cumsum(np.bincount(wrow, minlength=len(arr)))]).astype(np.int64)


def set_keys(w: np.ndarray, off: np.ndarray) -> np.ndarray:
    return segment_hashes(mix(w + np.uint64(7)), off[:-1], off[1:])


def needed(n, t: int):
    """Least overlap of a set of n tokens with any set of similarity t percent."""
    return (t * n + 99) // 100


def _describe(k: int):
    def run(it):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in slices(it, "text"):
            w, off = shingle_sets(texts(b), k)
            counts += np.bincount((w >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(np.diff(off)), pa.array(signed(set_keys(w, off))), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "tie", "n", "cls", "slot", "counts"])
        for s, part in enumerate(counts.reshape(-1, 1 << _SLOT_BITS)):
            if part.any():
                null = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["doc_id", "tie", "n", "cls", "slot", "counts"])

    return run


def _add(it):
    total: dict[int, np.ndarray] = {}
    for b in it:
        for s, c in zip(b.column("slot").to_pylist(), b.column("counts")):
            part = np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
            total[s] = total[s] + part if s in total else part
    for s, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["slot", "counts"])


def _prefixes(k: int, t: int, sketch):
    def run(it):
        seen: set[int] = set()
        rarity = sketch.value
        for b in slices(it, "text"):
            w, off = shingle_sets(texts(b), k)
            keys = signed(set_keys(w, off))
            n = np.diff(off)
            _, first = np.unique(keys, return_index=True)
            take = np.zeros(len(keys), bool)
            take[[i for i in first if keys[i] not in seen]] = True
            if len(seen) > SEEN:
                seen.clear()
            seen.update(keys[take].tolist())
            row = rows_of(off)
            rank = (rarity[(w >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (mix(w) >> np.uint64(32))
            order = np.lexsort((rank, row))
            w, pos = w[order], np.arange(len(w)) - off[:-1][row]
            keep = take[row] & (pos < (n - needed(n, t) + 1)[row])
            classes = np.flatnonzero(take & (n > 0))
            per = np.bincount(row[keep], minlength=len(keys))[classes]
            toks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(signed(w[keep])))
            yield pa.RecordBatch.from_arrays([pa.array(keys[classes]), pa.array(n[classes].astype(np.int32)), toks], ["cls", "n", "toks"])

    return run


def _sets(k: int, t: int, bits):
    """Whole sets of the classes wanted, and their prefixes under the hashed orders."""

    def prefix(x: np.ndarray, seed: int) -> np.ndarray:
        p = len(x) - needed(len(x), t) + 1
        return signed(x[np.argpartition(mix(x ^ np.uint64(seed)), p - 1)[:p]] if p < len(x) else x)

    def run(it):
        seen: set[int] = set()
        names = ["cls", "toks", *(f"p{i}" for i in range(len(ORDERS)))]
        for b in slices(it, "text"):
            w, off = shingle_sets(texts(b), k)
            keys = signed(set_keys(w, off))
            _, first = np.unique(keys, return_index=True)
            take = [i for i in first[in_bitmap(bits.value, keys[first]) & (np.diff(off)[first] > 0)] if keys[i] not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(int(keys[i]) for i in take)
            if take:
                sets = [w[off[i] : off[i + 1]] for i in take]
                lists = [[signed(x) for x in sets], *([prefix(x, s) for x in sets] for s in ORDERS)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[take]), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names)

    return run


def _verify(t: int):
    def run(it):
        for b in it:
            keep = []
            left, right = b.column("ta"), b.column("tb")
            for i in range(b.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= t * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 90, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """``described(doc_id, tie, n, cls)`` and the verified links ``(a, b)`` between classes of equal sets.

    tie is a hash of the text, cls a 64-bit hash of the whole set. Empty sets have n = 0 and link with nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = ws or Workspace(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    both = ws.table(docs.withColumn("tie", F.xxhash64("text")).mapInArrow(_describe(k), "doc_id long, tie long, n long, cls long, slot int, counts binary"), "described")
    described = both.where("slot is null").select("doc_id", "tie", "n", "cls")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in both.where("slot is not null").select("slot", "counts").repartition(8, "slot").mapInArrow(_add, "slot int, counts binary").toLocalIterator():
        sketch[row.slot << _SLOT_BITS : (row.slot + 1) << _SLOT_BITS] = np.frombuffer(row.counts, np.int64)
    shared = spark.sparkContext.broadcast(np.minimum(sketch, (1 << 31) - 1).astype(np.int32))

    # Classes that several tasks met become one row each before their tokens part; the join places its own shuffle, so that AQE splits a hot token.
    posts = docs.mapInArrow(_prefixes(k, percent, shared), "cls long, n int, toks array<long>").dropDuplicates(["cls"])
    posts = ws.table(posts, "posts").select("cls", "n", F.posexplode("toks").alias("pos", "tok"))
    x, y = (posts.select("tok", *(F.col(c).alias(c + s) for c in ("cls", "n", "pos"))) for s in "xy")
    possible = (100 + percent) * (1 + F.least(F.expr("nx - posx"), F.expr("ny - posy")) - 1) >= percent * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, "tok").where("clsx < clsy").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).where(possible)
    pairs = ws.table(pairs.select(F.col("clsx").alias("a"), F.col("clsy").alias("b")).distinct(), "pairs")
    bits = spark.sparkContext.broadcast(bitmap_of(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), "a"))
    orders = [f"p{i}" for i in range(len(ORDERS))]
    sets = docs.mapInArrow(_sets(k, percent, bits), "cls long, toks array<long>, " + ", ".join(f"{p} array<long>" for p in orders)).dropDuplicates(["cls"])
    sets = ws.table(sets, "sets")

    def fetched(df: DataFrame, cols: list[str]) -> DataFrame:
        one, two = (sets.select(F.col("cls").alias(k), *(F.col(c).alias(c + k) for c in cols)) for k in "ab")
        return df.join(one, "a").join(two, "b")

    passed = ws.table(fetched(pairs, orders).where(" and ".join(f"arrays_overlap({p}a, {p}b)" for p in orders)).select("a", "b"), "passed")
    joined = fetched(passed, ["toks"]).select("a", "b", F.col("toksa").alias("ta"), F.col("toksb").alias("tb"))
    links = ws.table(joined.mapInArrow(_verify(percent), "a long, b long"), "links")
    ws.drop("posts", "pairs", "passed", "sets")
    return described, links


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id.

    Words are runs without ASCII white space, with A-Z lower-cased. A text of fewer than
    k words has its whole sequence as its one shingle; null, empty and blank texts have
    none and link with nothing. Two documents link when 100 * |x & y| >= percent * |x | y|;
    n_similar counts every other document so linked, copies included; component_id is the
    least doc_id that links reach. A repeated row counts as a document of its own; a null
    doc_id stays null and is named by no component that has another. Empty tables give no
    rows; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    described, links = similar_sets(docs, k, percent, ws)
    full = described.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = ws.table(classes, "classes")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(classes.select(F.col("cls").alias("b"), "size"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("linked"))
    roots = connected_components(links, ws).withColumnRenamed("node", "cls")
    named = roots.join(classes.select("cls", "rep"), "cls")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("cls", "least")
    info = classes.join(linked, "cls", "left").join(named, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("least", "rep").alias("component_id"))
    out = full.join(info, "cls").select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id")
    empty = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def keep_one_per_group(docs: DataFrame, k: int = 5, percent: int = 90) -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id stays.

    A null doc_id comes last; of rows with one doc_id the one whose text has the least hash
    stays, and of repeated rows one. Rows of different components all stay, whether or not
    they share a doc_id or have none. Rows with an empty set stay: null, empty and blank
    texts. An empty table gives no rows. All columns of docs, whatever their names, are kept.
    """
    ws = Workspace(docs.sparkSession, "onepergroup")
    described, links = similar_sets(docs.select("doc_id", "text"), k, percent, ws)
    full = described.where("n > 0")
    classes = full.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"))
    rooted = classes.join(connected_components(links, ws).withColumnRenamed("node", "cls"), "cls", "left")
    least = rooted.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first"))
    keep, tie, whole, key, rank = (free_name(docs, c) for c in ("_keep", "_tie", "_whole", "_key", "_rank"))
    stay = least.select(F.col("first.doc_id").alias(keep), F.col("first.tie").alias(tie), F.lit(True).alias(whole))
    stay = ws.table(stay.unionByName(described.where("n = 0").select(F.col("doc_id").alias(keep), F.col("tie").alias(tie), F.lit(False).alias(whole)).distinct()), "stay")
    kept = docs.withColumn(key, F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(key) == F.col(tie)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    repeated = not full.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
    ws.drop("described", "links")
    if repeated:
        w = Window.partitionBy(keep, tie).orderBy(key)
        once = kept.where(F.col(whole)).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1)
        return once.select(*names).unionByName(kept.where(~F.col(whole)).select(*names))
    return kept.select(*names)
