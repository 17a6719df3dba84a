"""The queries of operators that SQL cannot express, against brute force on small tables, and what breaks them."""

import glob
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from sparrowlint.llm import ann, jaccard_join, langid, line_dedup, mixing, quality_rules, queries, sentencepiece_viterbi, token_store, warc
from sparrowlint.runtime import Workspace, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    """The smallest table with null and empty texts, null ids and sources, repeated rows, and a long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    rows += rows[:3] + [(None, rows[0][1], "en", None, 1), (900001, None, None, "web", 0), (900002, "", "en", None, 0), (900003, " \n\t ", None, "web", 4), (900004, "lorem ipsum " * 4000, "en", rows[0][3], 48000)]
    return rows, spark.createDataFrame(rows, docs.schema)


def saved(df, tmp_path, name="documents"):
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_mix_query(spark, some, tmp_path):
    rows, df = some
    got = queries.op6_mix(spark, saved(df, tmp_path)).collect()
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    by_source = {}
    for (_, _, _, s, _), n in zip(rows, sizes):
        by_source[s] = by_source.get(s, 0) + n
    names = sorted((s for s in by_source if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by_source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, 1.5 * sum(sizes), list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * by_source[s]]
        for s in over or free:
            target[s] = float(2 * by_source[s]) if over else rest * weight[s] / total
        if not over:
            break
        rest -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    want = sorted((str(r[0]), n, by_source[r[3]], round(target[r[3]], 6)) for r, n in zip(rows, sizes))
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == want
    assert all(0 <= r.taken <= 2 * r["size"] and (r.n_shards > 0) == (r.taken > 0) for r in got)
    taken = {}
    for r in got:
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(n - t) <= 2 * mixing.BLOCK for (_, t), n in taken.items())
    again = queries.op6_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_are_drawn():
    slots = np.array([4000, 1500, 37, 0, 9000])
    draw = mixing.Draw(slots, 5, 64)
    parts = [draw.shard(k) for k in range(draw.shards)]
    here = np.array([h for _, h in parts])
    assert (here.sum(axis=0) == slots).all() and set(here.sum(axis=1)[:-1]) == {64}
    assert (np.array([b for b, _ in parts]) == np.cumsum(here, axis=0) - here).all()
    # Any shard on its own gives the same draw; another seed another one; the spread is that of a draw without replacement.
    assert all((mixing.Draw(slots, 5, 64).shard(k)[1] == here[k]).all() for k in (0, 17, draw.shards - 1))
    other = mixing.Draw(slots, 6, 64)
    assert any((other.shard(k)[1] != here[k]).any() for k in range(5))
    p = slots[0] / slots.sum()
    assert 0.7 < here[:-1, 0].std() / np.sqrt(64 * p * (1 - p)) < 1.3
    big = mixing.halve(np.array([6 * 10**11, 4 * 10**11]), 5 * 10**11, [1, 2])
    assert big.sum() == 5 * 10**11 and abs(big[0] - 3 * 10**11) < 10**7


def test_draws_decide_the_output(spark, some, tmp_path):
    _, df = some
    from sparrowlint.runtime import Workspace

    plans = {}
    for per in (16, 64):
        rows, _ = mixing.plan(df, Workspace(spark, f"draw{per}"), shard_slots=per)
        plans[per] = {(r.doc_id, r.source, r.tie, r.nth): r.picks for r in rows.collect()}
    taken = {per: {k: sum((p.hi - p.lo) * p.times for p in v or ()) for k, v in x.items()} for per, x in plans.items()}
    assert taken[16] == taken[64]
    shards = {per: [s for v in x.values() for p in v or () for s in p.shards] for per, x in plans.items()}
    assert max(shards[16]) > 3 * max(shards[64]) > 0 and all(p.times == len(p.shards) for v in plans[16].values() for p in v or ())


def test_quality_counts(spark, some, tmp_path):
    rows, df = some
    saved(df, tmp_path)
    saved(spark.read.parquet(f"{SF}/labels.parquet"), tmp_path, "labels")
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, marked = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                marked.update(k for i in at for k in range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        want.append((str(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), failed))
    got = queries.op8_quality(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed) and sum(r.kept for r in got) > len(got) // 2


def test_language_held_out(spark, some, tmp_path):
    rows, df = some
    got = queries.op4_language(spark, saved(df, tmp_path)).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(r[0]), held(r[0])) for r in rows)
    lang = {r[0]: r[2] for r in rows if r[2] is not None and r[1] and re.search(r"[^\W\d_]", r[1])}
    tested = [(r.lang_pred, lang[r.doc_id]) for r in got if r.held_out and r.doc_id in lang]
    assert len(tested) > 20 and np.mean([a == b for a, b in tested]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (900001, 900002, 900003)} == {"und"}
    # The label of a held-out row, source and id are no input: other ones change nothing.
    other = [(d, t, "xx" if held(d) else lg, "q", n) for d, t, lg, _, n in rows]
    again = langid.predict_documents(spark.createDataFrame(other, df.schema)).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in got) == sorted((str(r.doc_id), r.lang_pred, r.score) for r in again)


def test_store_tells_tampering(spark, some, tmp_path):
    from sparrowlint.runtime import Workspace

    _, df = some
    path, ws = f"file://{tmp_path}/store", Workspace(spark, "tamper")
    token_store.write_store(df, public_tokenizers.path("word_bpe_49k.json"), 1, path, ws)
    assert token_store.read_store(spark, path).count() == df.count()
    packs = sorted(glob.glob(f"{tmp_path}/store/packs/*.pack"))
    names = [c.name for r in spark.read.parquet(f"{path}/recipes").collect() for c in r.chunks]
    stored = sum(1 for _ in spark.read.parquet(f"{path}/recipes").selectExpr("explode(chunks) c").select("c.name", "c.pack", "c.offset").distinct().collect())
    assert len(names) > stored == len(set(names))
    with open(packs[0], "r+b") as f:
        f.seek(300)
        old = f.read(1)
        f.seek(300)
        f.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="digest|broken"):
        token_store.read_store(spark, path, True).collect()
    with open(packs[0], "r+b") as f:
        f.seek(300)
        f.write(old)
    assert token_store.read_store(spark, path, True).count() == df.count()
    recipes = spark.read.parquet(f"{path}/recipes")
    from pyspark.sql import functions as F

    recipes.withColumn("root", F.when(F.col("doc_id") == 3, F.unhex(F.lit("00" * 16))).otherwise(F.col("root"))).write.parquet(f"{path}/changed")
    import shutil

    shutil.rmtree(f"{tmp_path}/store/recipes")
    shutil.move(f"{tmp_path}/store/changed", f"{tmp_path}/store/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, path)


def test_encoder_equals_library():
    enc = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    import pyarrow as pa

    assert enc.by_piece
    texts = ["".join(rng.choice("aB9 '.,<|endoftext|>éÉßÿ×÷Àİŉ Σσς́​\x1c\x85\n\tñ日本ªº²½_-") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "it's <|endoftext|>x a<|endoftext|>b <|startoftext|>", "É’s I'LL don't"]
    flat, off = enc.encode(pa.array(texts))
    assert [flat[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == enc.whole(texts)
    other = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    flat, off = other.encode(pa.array(texts))
    assert not other.by_word and [flat[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == other.whole(texts)


def test_links_between_joined_groups():
    """Pairs of groups that links connect already are left out, and what is connected stays the same as by all pairs."""
    import pyarrow as pa

    rng = random.Random(4)
    lines = []
    for _ in range(6):
        base = [rng.choice("abcdefgh") for _ in range(120)]
        lines += ["".join(c if rng.random() > 0.035 else rng.choice("abcdefgh") for c in base) for _ in range(20)]
    lines += ["one two three " * 6 + x for x in "abcdefgh"]
    group = [i // 4 for i in range(len(lines))]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if group[i] != group[j]]
    rng.shuffle(pairs)
    columns = {"a": [i for i, _ in pairs], "b": [j for _, j in pairs], "ga": [group[i] for i, _ in pairs], "gb": [group[j] for _, j in pairs], "la": [lines[i] for i, _ in pairs], "lb": [lines[j] for _, j in pairs]}
    table = pa.table(columns)

    def connected(links):
        root = {g: g for g in group}
        for i, j in links:
            x, y = root[group[i]], root[group[j]]
            root = {g: x if r == y else r for g, r in root.items()}
        return {frozenset(h for h in root if root[h] == root[g]) for g in root}

    every = [p for p in pairs if line_dedup.distance_within(lines[p[0]], lines[p[1]], int(0.1 * max(len(lines[p[0]]), len(lines[p[1]])) + 1e-9))]
    got = [(r["a"], r["b"]) for b in line_dedup._verify(0.9)(iter(table.to_batches(max_chunksize=500))) for r in b.to_pylist()]
    assert set(got) <= set(every) and connected(got) == connected(every)
    assert 6 < len(got) < len(every) / 4


def test_encoder_remembers(monkeypatch):
    """Pieces of an early batch are not encoded again after 400,000 others; equal hashes, and a full memo, change no ids."""
    import pyarrow as pa

    enc = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    batches = [pa.array([" ".join(map(name, range(i, i + 80_000)))]) for i in range(0, 400_000, 80_000)]
    first = [enc.encode(b)[0].tolist() for b in batches][0]
    whole, asked = enc.whole, []
    monkeypatch.setattr(enc, "whole", lambda items, *a, **k: asked.extend(items) or whole(items, *a, **k))
    assert enc.encode(batches[0])[0].tolist() == first and not asked

    enc = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.memo.most = 500
    monkeypatch.setattr(token_store, "string_hashes", lambda arr, seed: np.array([len(x) for x in arr.to_pylist()], np.uint64))
    rng = random.Random(2)
    for _ in range(20):
        rows = [" ".join(rng.choice(["a", "Bc", "é", "日本", "x1", "12,", "it's"]) * rng.randrange(1, 6) + rng.choice("abcdef") for _ in range(40)) for _ in range(10)]
        flat, off = enc.encode(pa.array(rows))
        assert [flat[off[i] : off[i + 1]].tolist() for i in range(10)] == enc.whole(rows)


def test_window_commits():
    """Text without spaces goes through the same window, which commits before the text ends."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_viterbi.Codec(path)
    rng = random.Random(5)
    items = ["".join(rng.choice(["the", "in", "ab", "q", "ä", "日", "1"]) for _ in range(k)) for k in (1, 9, 40, 400, 2000)] + ["a" * 3000, "=" * 500]
    import pyarrow as pa

    flat, off = c.encode(pa.array(items))
    assert [flat[off[i] : off[i + 1]].tolist() for i in range(len(items))] == [lib.encode(x) for x in items] and c.commits > 50


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_model(tmp_path):
    """A hand-made model of type unigram, against the library."""
    import struct

    import pyarrow as pa
    import sentencepiece

    def field(k, v):
        return _varint(k << 3 | 2) + _varint(len(v)) + v

    rng = random.Random(9)
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bca", "abcabc", "▁cab", "aa", "aaa"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(n, -1 - 7 * rng.random(), 1) for n in names]
    model = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    model += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    path = tmp_path / "unigram.model"
    path.write_bytes(model)
    lib, c = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_viterbi.Codec(str(path))
    assert not c.merging
    items = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 200))).strip() for _ in range(200)]
    flat, off = c.encode(pa.array(items))
    assert [flat[off[i] : off[i + 1]].tolist() for i in range(len(items))] == [lib.encode(x) for x in items]


def test_forest_recall(spark):
    """Isotropic vectors with groups of near copies: recall at least 0.9, not by looking at everything, and less of it the larger the table."""
    shares = []
    for n in (1500, 12000):
        rng = np.random.default_rng(7)
        x = rng.standard_normal((n, 24)).astype(np.float32)
        x[: n // 10] = x[0] + 0.05 * x[: n // 10]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        got = ann.nearest(df, leaf=64).collect()
        found, m = {}, x.astype(float)
        for r in got:
            found.setdefault(r.query_id, []).append(r.vec_id)
        hits = 0
        for q in range(0, n, 20):
            s = m @ m[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(found[q]))
        assert hits >= 0.9 * 20 * len(found) and set(found) == set(range(0, n, 20))
        assert all(abs(r.score - float((m[r.query_id] * m[r.vec_id]).sum())) < 1e-9 for r in got[:200])
        shares.append(got[0].visited)
    assert shares[1] < shares[0] and shares[1] < 0.6


def test_other_columns_stay(spark):
    """Columns of the names that the stages use themselves, and of any type."""
    names = ["_t", "_id", "_keep", "_n", "_removed", "_sets", "_key", "_tie", "_copy", "_hash", "_whole", "_rank", "_pid", "_pset", "size", "at", "picks", "key", "nth"]
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(50)) for _ in range(40)) for _ in range(12)]
    data = [(i % 10 if i != 7 else None, t, "en", f"s{i % 3}", len(t), *(f"{n}{i}" for n in names)) for i, t in enumerate(base + base[:2])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    own = {r[5][2:]: tuple(r)[5:] for r in data}
    for stage in (langid.keep_identified, line_dedup.deduplicate_lines, jaccard_join.keep_one_per_group, mixing.mix_documents):
        out = stage(df)
        rows = out.collect()
        assert out.columns == df.columns and rows and all(tuple(r)[5:] == own[r["_t"][2:]] for r in rows), stage
        assert stage(df.limit(0)).count() == 0


def test_warc_stream_and_repeated_ids(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nETag: \"%d\"\r\n\r\n" + b"x" * 200_000
    parts = [warc.write_record("response", f"r{i}", f"http://x.org/{i}", "2024-01-01T00:00:00Z", body % i) for i in range(30)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(parts)[:-40])
    (tmp_path / "w/b.warc").write_bytes(b"junk" + __import__("gzip").decompress(parts[3]))
    (tmp_path / "w/c.warc").write_bytes(b"")
    (tmp_path / "w/d.warc.gz").write_bytes(warc.write_record("response", "bad", "http://x.org/d", "no date", b"HTTP/1.1 200 OK\r\n\r\n"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.record_id for r in got) == sorted([f"r{i}" for i in range(29)] + ["r3", "bad"]) and all(len(r.payload) == 200_000 for r in got if r.record_id != "bad")
    assert [r.ts for r in got if r.record_id == "bad"] == [None]
    rows = [("a", "response", "http://x.org/1", 1, {"etag": "1"}, None), ("a", "response", "http://x.org/2", 1, {"etag": "2"}, None)]
    rows += [("n", "revisit", f"http://x.org/{k}", 5, {"etag": str(e)}, None) for k, e in ((1, 1), (2, 9), (3, 1))]
    out = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS)).where("kind = 'revisit'").collect()
    assert sorted((r.url, r.outcome) for r in out) == [("x.org/1", "resolved"), ("x.org/2", "changed"), ("x.org/3", "missing")]
    assert [r.merged for r in out if r.outcome == "resolved"] == [{"etag": "1"}]


def test_pipeline_against_its_parts(spark, some, tmp_path):
    """Every stage on what the one before it kept, held against brute force."""
    import corpus_pipeline
    import sentencepiece

    rows, df = some
    docs = df
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = [r.asDict() for r in docs.collect()]
    first, lines, near, mixed, last = kept.values()
    lettered = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert 0.95 * len(lettered) <= len(first) <= len(lettered) and all(set(r) == set(df.columns) for x in (first, lines, near, mixed) for r in x)
    assert len(lines) == len(first) and sum(len(r["text"]) for r in lines) < sum(len(r["text"]) for r in first)
    sets = []
    for r in lines:
        w = [x.lower() for x in WORD.findall(r["text"])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert len(near) == len({find(a) for a in range(len(sets)) if sets[a]}) + sum(not s for s in sets)
    sizes = sum(len(WORD.findall(r["text"])) for r in near)
    words = sum(len(WORD.findall(r["text"])) for r in mixed)
    assert 0.9 * 1.5 * sizes <= words <= 1.1 * 1.5 * sizes or words <= 2 * sizes
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in last) == sorted((str(r["doc_id"]), lib.encode(r["text"])) for r in mixed)
    assert all(r["text"] == lib.decode(list(r["ids"])) for r in last)


def test_steps_leave_no_shuffle_files(spark, some, tmp_path):
    """What a written table shuffled is gone at once, and of the steps of line dedup and the Jaccard join only what the result reads stays."""
    _, df = some
    docs = spark.read.parquet(saved(df, tmp_path) + "/documents.parquet")
    folders = shared_dir(spark).removeprefix("file://") + "/*/*"
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    Workspace(spark, "shuffles").table(docs.groupBy("source").count(), "counts")
    assert not files() - before
    for stage in (line_dedup.deduplicate_lines, jaccard_join.keep_one_per_group):
        held, result = set(glob.glob(folders)), stage(docs)
        new = {p.rsplit("/", 1)[1] for p in set(glob.glob(folders)) - held}
        assert not new & {"lines", "first", "second", "described", "links", "posts", "sets"} and result.count() > 0


def _shuffled(spark):
    """Records that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_that_share_a_value_by_chance_are_not_shuffled(spark):
    took = {}
    for n in (300, 1200):
        r = random.Random(3)
        lines = [" ".join(["zq", "at", *("".join(r.choices("abe", k=4)) for _ in range(3))]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        before = _shuffled(spark)
        assert line_dedup.line_groups(docs)[1].count()
        took[n] = _shuffled(spark) - before
    assert took[1200] < 6 * took[300], took
