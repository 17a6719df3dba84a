"""Mixing sources to target weights, in blocks of fixed length.

The words of a source's documents, one after another in doc_id order, are packed into
blocks of BLOCK words. A source's target becomes a number of slots. The output consists of
shards of SHARD_SLOTS slots, and how many slots of a shard each source gets is multinomial,
given the totals: the slots of a run of shards are divided between its two halves at
random, from all shards down to one. Whatever the draws, totals are met; each shard's
numbers follow from the seed and its own path down, so no task and no driver walks all
shards. A source's slots are numbered through all shards; slot j holds block
p(j mod blocks), where p is a pseudorandom permutation of the source's block indices (a
keyed Feistel network, evaluated per index, never stored). The documents of a slot follow
from an equi-join on (source, block).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowlint.llm.common import free_name, mix, slices, texts, words
from sparrowlint.runtime import Workspace, ship

BLOCK, SHARD_SLOTS = 64, 4096
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Target words by source: weights in code-point order (null last), repeating; what exceeds ``most`` times a source is reshared by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(out[s] for s in over)
        open_ -= over
    return out


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 at i: four Feistel rounds over the least even number of bits, walking cycles until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(4):
            a, b = b, a ^ (mix(b + k * np.uint64(5) + np.uint64(r)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def halve(slots: np.ndarray, first: int, seed: list[int]) -> np.ndarray:
    """How many of each source's slots lie in the first ``first`` of them all, in random order: hypergeometric, source by source."""
    rng, rest, out = np.random.default_rng(seed), int(slots.sum()), np.zeros_like(slots)
    for k, c in enumerate(slots.tolist()):
        rest -= c
        low, high = max(0, first - rest), min(c, first)
        if low < high:
            if c + rest < 10**9:
                x = int(rng.hypergeometric(c, rest, first))
            else:
                # numpy draws below 1e9 only; above, the normal limit differs by less than a slot in a thousand.
                p, n = first / (c + rest), c + rest
                x = round(rng.normal(c * p, np.sqrt(c * p * (1 - p) * (n - c) / max(1, n - 1))))
            low = min(max(x, low), high)
        out[k] = low
        first -= low
    return out


class Draw:
    """The slots of any shard by source, from the totals; the path down is kept, so that shards in order cost two steps each."""

    def __init__(self, slots: np.ndarray, seed: int, per_shard: int):
        self.slots, self.seed, self.per_shard = slots, seed, per_shard
        self.shards = -(-int(slots.sum()) // per_shard)
        self.path: list[tuple[int, int, np.ndarray, np.ndarray]] = [(0, self.shards, np.zeros_like(slots), slots)]

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each source's slots before the shard, and in it."""
        while not self.path[-1][0] <= k < self.path[-1][1]:
            self.path.pop()
        while (top := self.path[-1])[1] - top[0] > 1:
            a, z, before, here = top
            m = (a + z) // 2
            left = halve(here, (m - a) * self.per_shard, [self.seed, a, z])
            self.path.append((a, m, before, left) if k < m else (m, z, before + left, here - left))
        return self.path[-1][2:]


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, tie)``: the number of words of each text, and a hash of it."""
    ship(docs.sparkSession)

    def run(it):
        for b in slices(it, "text"):
            _, off, _ = words(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.diff(off)), b.column("tie")], ["doc_id", "source", "size", "tie"])

    return docs.select("doc_id", "source", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, source string, size long, tie long")


def _place(it):
    """Adds the part, the words of the source before the row in it, and the number of the row among those equal in (source, doc_id)."""
    part, now, at, same, nth = TaskContext.get().partitionId(), None, 0, None, 0
    for b in it:
        inner, number = [], []
        for s, d, n in zip(b.column("source").to_pylist(), b.column("doc_id").to_pylist(), b.column("size").to_pylist()):
            if (s,) != now:
                now, at = (s,), 0
            nth = nth + 1 if (s, d) == same else 1
            same = (s, d)
            inner.append(at)
            number.append(nth)
            at += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(inner, pa.int64()), pa.array(number, pa.int64())], [*b.schema.names, "part", "inner", "nth"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a table of a known number of rows, if that is at most 10,000."""
    return F.broadcast(df) if rows <= 10_000 else df


def plan(docs: DataFrame, ws: Workspace, block: int = BLOCK, seed: int = 5, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, dict]:
    """``(doc_id, source, size, tie, nth, at, picks)`` and the targets.

    at is where the document begins in its source; picks lists (lo, hi, times, shards): runs
    of its words, in document order, that lie in drawn blocks, how often those are drawn,
    and for which output shards. nth tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = ws.table(sized(docs), "sized")
    order = ("source", "doc_id", "tie")
    # Range partitions cut a hot source, and rows without an id, by what follows in the order.
    placed = base.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_place, "doc_id long, source string, size long, tie long, part int, inner long, nth long")
    placed = ws.table(placed, "placed")
    sums = sorted(((r.source, r.part, r.s) for r in placed.groupBy("source", "part").agg(F.sum("size").alias("s")).collect()), key=lambda r: r[1])
    sizes: dict = {}
    bases = []
    for s, p, n in sums:
        bases.append((s, p, sizes.get(s, 0)))
        sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = np.array([-(-sizes[s] // block) for s in names], np.int64)
    want = np.array([goal[s] / (sizes[s] / n if n else 1) for s, n in zip(names, blocks)])
    slots = np.minimum(np.rint(want).astype(np.int64), MOST * blocks)
    keys = np.array([zlib.crc32(repr(s).encode()) for s in names], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)

    def fill(it):
        found = Draw(slots, seed, shard_slots)
        for b in it:
            for k in b.column("id").to_pylist():
                before, here = found.shard(k)
                own = np.repeat(np.arange(len(names)), here)
                j = np.arange(len(own)) - np.repeat(np.cumsum(here) - here, here) + before[own]
                n = blocks[own]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(own)), pa.array(permute(j % n, n, keys[own])), pa.array(np.full(len(own), k))], ["source", "block", "shard"])

    shards = spark.range(0, -(-int(slots.sum()) // shard_slots), 1, parts)
    times = shards.mapInArrow(fill, "source string, block long, shard long").groupBy("source", "block").agg(F.count("*").alias("times"), F.array_sort(F.collect_list("shard")).alias("shards"))

    before = small(spark.createDataFrame(bases, "s2 string, p2 int, base long"), len(bases))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2"))).select("doc_id", "source", "size", "tie", "nth", (F.col("base") + F.col("inner")).alias("at"))
    spans = placed.where("size > 0").select("doc_id", "source", "tie", "nth", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    times = times.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "times", "shards")
    # The planner takes the draws for small, as they come from a range; they grow with the corpus.
    hit = spans.join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at"))
    picks = hit.groupBy("source", "doc_id", "tie", "nth").agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi"), "times", "shards"))).alias("picks"))
    picks = picks.select(*(F.col(c).alias("_" + c) for c in ("source", "doc_id", "tie", "nth")), "picks")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("tie").eqNullSafe(F.col("_tie")) & (F.col("nth") == F.col("_nth"))
    return placed.join(picks, same, "left").select("doc_id", "source", "size", "tie", "nth", "at", "picks"), {"sizes": sizes, "targets": goal, "placed": placed}


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards, first_shard of every document.

    size counts words (null: 0). taken counts the words the mix takes of it, repeats
    included: at most twice its size. n_shards counts the output shards that hold any of
    them and first_shard is the least (null: none). A source's total lies within one block of its target.
    A null source is a source of its own, the last. Repeated rows are documents of their
    own; a null doc_id comes last in its source. An empty table gives no rows. The number
    of sources must fit the driver; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows, found = plan(docs, ws)
    table = docs.sparkSession.createDataFrame([(s, int(n), float(found["targets"][s])) for s, n in found["sizes"].items()], "s3 string, source_size long, target double")
    taken = F.coalesce(F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + (p["hi"] - p["lo"]) * p["times"]), F.lit(0))
    drawn = F.array_sort(F.array_distinct(F.flatten(F.transform("picks", lambda p: p["shards"]))))
    out = rows.join(small(table, len(found["sizes"])), F.col("source").eqNullSafe(F.col("s3"))).withColumn("drawn", drawn)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.coalesce(F.size("drawn"), F.lit(0)).cast("long").alias("n_shards"), F.get("drawn", F.lit(0)).alias("first_shard"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as mixed, with the columns they had: one row per document and pass.

    A pass takes the document's words that lie in blocks drawn that often; where these are
    all its words the row is the document itself, else its text is those words' stretches
    of the text, joined by a space, and n_chars is its length. Documents of no words, null
    and empty texts among them, are kept as they are, once. Repeated rows are documents of
    their own, each with its own draws. A null source is a source of its own, the last; a
    null doc_id is the first in its source. An empty table gives no rows. Other columns,
    whatever their names, stay as they are.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixdocs")
    rows, found = plan(docs.select("doc_id", "source", "text"), ws)
    names = docs.columns
    key, copy, pid, psource, ptie, pcopy, pset = (free_name(docs, c) for c in ("_key", "_copy", "_pid", "_psource", "_ptie", "_pcopy", "_pset"))
    keyed, one = docs.withColumn(key, F.xxhash64("text")), F.lit(1)
    repeated = not found["placed"].groupBy("doc_id", "source", "tie").count().where("count > 1").isEmpty()
    # The nth copy of a row takes the draws of the nth such row of the plan; copies differ in nothing the plan knows of.
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy("nth")) if repeated else one)
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", "source", key).orderBy(key)) if repeated else one)
    picks = rows.where("picks is not null or size = 0").select(F.col("doc_id").alias(pid), F.col("source").alias(psource), F.col("tie").alias(ptie), F.col("copy").alias(pcopy), F.struct("size", "picks").alias(pset))
    joined = keyed.join(picks, F.col("doc_id").eqNullSafe(F.col(pid)) & F.col("source").eqNullSafe(F.col(psource)) & (F.col(key) == F.col(ptie)) & (F.col(copy) == F.col(pcopy)))

    def cut(it):
        import re

        word = re.compile(r"[^\x20\x09-\x0d]+")
        for b in it:
            text, sets = b.column("text").to_pylist(), b.column(pset).to_pylist()
            keep, new = [], []
            for i, (x, s) in enumerate(zip(text, sets)):
                if not s["size"]:
                    keep.append(i)
                    new.append(x)
                    continue
                spans = None
                for e in range(1, max(p["times"] for p in s["picks"]) + 1):
                    runs: list[list[int]] = []
                    for p in s["picks"]:
                        if p["times"] >= e:
                            if runs and runs[-1][1] == p["lo"]:
                                runs[-1][1] = p["hi"]
                            else:
                                runs.append([p["lo"], p["hi"]])
                    if runs == [[0, s["size"]]]:
                        piece = x
                    else:
                        spans = spans or [m.span() for m in word.finditer(x)]
                        piece = " ".join(x[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs)
                    keep.append(i)
                    new.append(piece)
            out = b.select(names).take(pa.array(keep, pa.int64()))
            cols = [pa.array(new, pa.string()) if n == "text" else pa.array([None if t is None else len(t) for t in new], out.schema.field(n).type) if n == "n_chars" else out.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*(F.col(f"`{c}`") for c in names), pset).mapInArrow(cut, docs.schema)
