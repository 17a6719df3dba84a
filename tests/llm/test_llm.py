import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from sparrowlint.llm import ann, components, jaccard_join, langid, line_dedup, mixing, quality_rules, sentencepiece_viterbi, substring_dedup, token_store, warc
from sparrowlint.runtime import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randrange(2, 7))) for _ in range(60)]


def prose(n):
    return "".join(R.choice(WORDS) + R.choice([" ", " ", " ", "\n", ". "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(R.randrange(1, 90)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i]) for i in range(8)]
    out += [(200 + i, base[i] + " tail") for i in range(8)]
    out += [(300, None), (301, ""), (302, " \n "), (303, "x"), (304, "word " * 3000), (None, "a null id"), (305, "12 34 !"), (305, "12 34 !")]
    return [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), "x", "y") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(spark, rows, docs, none):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    linked = {a: set() for a in range(len(sets))}
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            linked[a].add(b)
            linked[b].add(a)

    def least(a):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [sets[b][0] for b in seen if sets[b][0] is not None]
        return min(ids) if ids else None

    key = lambda r: (r[0] is None, r)
    want = sorted(((i, len(s), len(linked[a]), least(a)) for a, (i, s) in enumerate(sets)), key=key)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_groups(docs).collect()), key=key)
    assert got == want
    assert jaccard_join.jaccard_groups(none).count() == 0
    kept = [r.doc_id for r in jaccard_join.keep_one_per_group(docs).collect()]
    assert not {100, 107} & set(kept) and {0, 300, 301, None} <= set(kept)


def test_one_per_group_keeps_every_component(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    data = [(None, base[i]) for i in range(5)] + [(None, base[0]), (None, ""), (None, ""), (1, base[5]), (1, base[6]), (1, base[6]), (2, base[5]), (3, base[1]), (4, base[7] + " y"), (4, base[7]), (5, None), (5, base[8])]
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one_per_group(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    sevens = [r for r in got if r[0] == 4]
    want = [(None, base[0]), (None, base[2]), (None, base[3]), (None, base[4]), (None, ""), (None, ""), (1, base[5]), (1, base[6]), (3, base[1]), (5, None), (5, base[8])]
    assert len(sevens) == 1 and sorted((r for r in got if r[0] != 4), key=str) == sorted(want, key=str)


def test_substrings(spark, rows, docs, none, monkeypatch):
    def brute():
        seen, out = set(), {}
        for i, t, *_ in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
            b = (t or "").encode()
            m = np.zeros(len(b) + 1, int)
            for s in range(len(b) - 99):
                if b[s : s + 100] in seen:
                    m[s] += 1
                    m[s + 100] -= 1
                seen.add(b[s : s + 100])
            c = np.cumsum(m)[:-1] > 0
            out[i] = (len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest())
        return out

    want = brute()
    for hot in (4096, 1):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = substring_dedup.remove_repeats(docs).collect()
        assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_minima_by_steps():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) & ~np.uint64((1 << 40) - 1)
    h[100:160] = h[100]
    want = [i + int(np.argmin(h[i : i + 53] >> np.uint64(28))) for i in range(len(h) - 52)]
    assert all(substring_dedup.minima(h, 53, step).tolist() == want for step in (1 << 27, 1000, 64))


def test_suffix_array():
    b = np.frombuffer(b"banana" * 40 + b"bandana" * 20, np.uint8)
    sa, word = substring_dedup.suffix_array(b, len(b))
    raw = b.tobytes()
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: raw[i:])
    lcp = substring_dedup.common_prefixes(b, sa, word, cap=100, stretch=16)
    for k in range(1, len(sa)):
        x, y = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[k] == min(n, 100)


def test_prefixes_of_suffixes_longer_alike_than_sorted():
    # What follows the 128 bytes puts the later windows in the other order than the first; other shares 8 bytes with them and those from the 99th on.
    common = bytes(random.Random(1).choices(b"mnop", k=128))
    other = common[1:9] + b"a" * 90 + common[99:]
    pos, first, begins = substring_dedup.windows_in([common + b"z", common + b"a", other])
    assert sorted(pos[pos != first].tolist()) == list(range(129, 158))


def test_token_store(spark, rows, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    at = 0
    got = sorted(token_store.stored_documents(docs, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, t, *_) in zip(got, order):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.stored_documents(none, path).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40000, 20000).astype(np.uint32)
    ends = token_store.cuts(x)
    assert ends[-1] == len(x) and (np.diff(np.r_[0, ends]) <= token_store.MOST).all() and (np.diff(np.r_[0, ends])[:-1] >= token_store.LEAST).all()
    moved = token_store.cuts(np.r_[x[:7], x])
    assert len(set(moved - 7) & set(ends)) > 0.9 * len(ends)


def test_sentencepiece():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_viterbi.Codec(path)
    items = ["", "a", " ", "  a  b ", "x\ty\n", "ü€𐍈 z", "a" * 300, prose(200), "ab" * 200, "é" * 120, "日本語 text"] + ["".join(R.choice("ab the in \nä") for _ in range(80)) for _ in range(50)]
    flat, off = c.encode(pa.array(items))
    for k, x in enumerate(items):
        ids = flat[off[k] : off[k + 1]].tolist()
        assert ids == lib.encode(x) and c.decode(ids) == x


def test_sentencepiece_documents(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert all(r.decoded_equals for r in sentencepiece_viterbi.round_trip(docs, path).collect())
    assert sentencepiece_viterbi.encode_documents(none, path).count() == 0


def test_language(spark, rows, docs, none):
    got = langid.predict_documents(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (300, 301, 302, 305)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.predict_documents(none).count() == 0
    two = [(i, " ".join(R.choice(v) for _ in range(30)), k) for k, v in (("aa", ["kata", "kuto", "kiti"]), ("bb", ["zelo", "zuli", "zaro"])) for i in range(k == "bb", 60, 2)]
    r = langid.predict_documents(spark.createDataFrame([(i, t, k) for i, t, k in two], "doc_id long, text string, lang string")).collect()
    assert all(x.lang_pred == ("aa" if x.doc_id % 2 == 0 else "bb") for x in r)


def test_mixing(spark, rows, docs, none):
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_sizes(docs).collect()), key=str)
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mix_documents(docs).columns == docs.columns
    t = mixing.targets({"a": 100, "b": 100, "c": 100, None: 100})
    assert sum(t.values()) == pytest.approx(600) and max(t.values()) <= 200
    n = np.full(1000, 1000)
    assert sorted(mixing.permute(np.arange(1000), n, np.full(1000, 5, np.uint64))) == list(range(1000))


def test_mixed_copies_emit_their_own_draws(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(200)) for i in range(3)]
    data = [(i, t, s, len(t)) for i, t in enumerate(texts) for s in ("a", "b") for _ in range(4)] + [(9, "", "a", 0)] * 2 + [(None, texts[0], None, 5)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    want, got = {}, {}
    for r in mixing.mixed_sizes(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in (mixed := mixing.mix_documents(df).collect()):
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want and sum(r.doc_id == 9 for r in mixed) == 2


def test_quality(spark, rows, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == len(rows) and all(r.base_failed or r.n_words >= 20 for r in got) and not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judged(none, labels.limit(0)).count() == 0
    x = {"a": np.arange(300.0), "b": np.random.default_rng(0).random(300)}
    rules = quality_rules.learn(x, x["a"] > 200)
    assert rules and (rules[0].covers(x) == (x["a"] > 200)).mean() > 0.98


def test_lines(spark, docs, none, rows):
    line = "the quick brown fox jumps over the lazy dog and runs away from all the other animals in the wood"
    data = [(1, f"{line}\nshort\nunique line number one that nobody repeats"), (2, f"{line.upper()}!\nshort"), (3, line), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in data], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(df, least=20).collect()}
    assert out == {1: data[0][1], 2: "short", 3: "", 4: None, 5: ""}
    out = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(df).collect()}
    assert out == {1: data[0][1], 2: "", 3: "", 4: None, 5: ""}
    assert len(line_dedup.line_report(docs).collect()) == len(rows) and line_dedup.line_report(none).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def normal(line):
    return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())


def test_edit_similarity_is_exact():
    rng, pairs = random.Random(2), []
    for _ in range(400):
        x = [rng.choice(WORDS) for _ in range(rng.randrange(1, 40))]
        y = list(x)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        a, b = " ".join(x), " ".join(y)
        pairs.append((a, b))
    got = line_dedup.similar_lines(pairs, 0.9).tolist()
    assert got == [distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9) for a, b in pairs] and 100 < sum(got) < 390
    close = [(a, b, d + e) for a, b in pairs for d, e in ((distance(a, b), rng.choice([-1, 0, 1])),)]
    assert line_dedup.many_within(close).tolist() == [distance(a, b) <= k for a, b, k in close]


def test_line_report_against_brute_force(spark):
    """Links by edit similarity alone, over all pairs: recall of links at least 0.9, and nothing else is removed."""
    rng, lines = random.Random(3), []
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    for n in (6, 10, 20, 40, 60):
        for _ in range(12):
            w = [rng.choice(words) for _ in range(n)]
            lines.append(" ".join(w))
            for edits in range(1, 1 + max(1, n // 14)):
                v = list(w)
                for _ in range(edits):
                    k = rng.randrange(len(v))
                    v[k] = rng.choice([v[k][:-1] + "q", v[k] + "x", rng.choice(words)])
                lines.append(", ".join(v))
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    names = [normal(x) for x in lines]
    near = [(a, b) for a, b in combinations(range(len(lines)), 2) if min(len(names[a]), len(names[b])) >= 0.9 * max(len(names[a]), len(names[b])) and distance(names[a], names[b]) <= 0.1 * max(len(names[a]), len(names[b]))]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in near:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {a for a in range(len(lines)) if find(a) != a}
    got = {r.doc_id for r in line_dedup.line_report(df).collect() if r.n_removed}
    assert len(near) > 80 and got <= want and len(got) >= 0.9 * len(want)


def test_line_dedup_finds_one_changed_word(spark):
    rng, lines = random.Random(11), []
    for n in (5, 8, 12, 20, 40):
        for _ in range(40):
            w = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(n)]
            k = rng.randrange(n)
            lines += [" ".join(w), " ".join([*w[:k], w[k][:-1] + "é", *w[k + 1 :]])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.line_report(df).collect() if r.n_removed}
    # Each pair is one edit apart in at least 20 characters; edit similarity alone says that all 200 repeat.
    assert all(i % 2 for i in got) and len(got) >= 196


def test_short_lines_repeat(spark, tmp_path):
    import corpus_pipeline
    from sparrowlint.llm import queries

    data = [(1, "Short\n\nb\nabcdefghijklm"), (2, "short!\n\nB\nc"), (3, "abcdefghijklx\n \nc\nb c")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in data], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert out == {1: data[0][1], 2: "\nc", 3: " \nb c"}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, x[3].tolist(), 0), (1080, x[3].tolist(), 0)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["vec_id", "embedding", "score"]), "vec_id long, embedding array<float>, score int")
    got = {}
    # All queries are calibrated on, so that with recall 1 the answer is exact.
    for r in ann.nearest(df, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, m = np.r_[np.arange(400), 1060, 1080], np.vstack([x, x[3], x[3]]).astype(float)
    for q, found in got.items():
        s = [(-float((m[list(ids).index(q)] * v).sum()), i) for i, v in zip(ids, m) if i != q]
        assert [v for _, v, _ in sorted(found)] == [i for _, i in sorted(s)[:20]]
    assert set(got) == {i for i in ids if i % 20 == 0} and ann.nearest(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nX-Old: 1\r\n\r\nbody"
    data = warc.write_record("response", "r1", "http://www.x.org/a?utm_x=1", "2024-01-01T00:00:00Z", http) + warc.write_record("revisit", "n1", "https://x.org/a#z", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nX-New: 2\r\n\r\n") + warc.write_record("revisit", "n2", "https://x.org/a", "2023-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(data)
    records = warc.read_warc(spark, str(tmp_path))
    got = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert (got["n1"].outcome, got["n1"].resolved_id, got["n1"].merged) == ("resolved", "r1", {"etag": 'W/"a"', "x-old": "1"})
    assert got["n2"].outcome == "missing" and got["r1"].outcome == "full"
    odd = spark.createDataFrame([("a", "revisit", None, 1, None, None), ("b", "response", "", None, {}, None), (None, "revisit", "x", 2, {}, "d")], warc.RECORDS)
    assert warc.resolve_revisits(odd).count() == 3 and warc.resolve_revisits(odd.limit(0)).count() == 0


def test_filter_grows_with_its_keys(spark, tmp_path):
    """No key is lost, and of other keys as few pass with many keys as with few."""
    from sparrowlint.llm.common import in_filter, write_filter
    from sparrowlint.runtime import Workspace

    ws = Workspace(spark, "filters")
    other = np.arange(1 << 40, (1 << 40) + 200_000)
    for n in (0, 1000, 3_000_000):
        path = write_filter(spark.range(n), "id", ws, f"f{n}", 16)
        assert in_filter(path, np.arange(n)).all()
        assert in_filter(path, other).mean() < 0.015


def test_values_meet_in_parts():
    """Dealt to any number of parts, the values that several classes share come with all their classes and the least of them, once each."""
    rng = random.Random(5)
    lists = [[rng.randrange(9000) for _ in range(rng.randrange(12))] for _ in range(4000)] + [[7] * 5, []]
    keys = [rng.getrandbits(62) for _ in lists]
    of = {}
    for k, vs in zip(keys, lists):
        for v in vs:
            of.setdefault(v, set()).add(k)
    want = {(v, k, min(ks)) for v, ks in of.items() if len(ks) > 1 for k in ks}
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lists, pa.list_(pa.int64()))], ["key", "blocks"])
    again = batch.slice(0, 500)
    for parts in (1, 13):
        pairs = {}
        for b in line_dedup._deal(parts)(iter([batch.slice(0, 900), batch.slice(900), again])):
            for row in b.to_pylist():
                pairs.setdefault(row["part"], []).append(row["pairs"])
        got = [tuple(r.values()) for p in pairs.values() for r in line_dedup._meet(pa.table({"pairs": pa.array(p, pa.binary())})).to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_values_come_packed(monkeypatch):
    """Values packed for many classes together are dealt like those in a list beside each key, in parts of any size."""
    rng = np.random.default_rng(3)
    first = np.arange(2, 1400, 2)
    count = np.zeros(1500, np.int64)
    count[first] = rng.integers(0, 9, len(first))
    key, values = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1500, count.sum()))
    ends = np.cumsum(count[first])
    lists = [values[e - n : e].view(np.int64).tolist() for e, n in zip(ends, count[first])]
    as_lists = pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], ["key", "blocks"])

    def pairs(batches):
        rows = [(r["part"], p.tobytes()) for b in line_dedup._deal(7)(iter(batches)) for r in b.to_pylist() for p in np.frombuffer(r["pairs"], np.int64).reshape(-1, 2)]
        return sorted(rows)

    want = pairs([as_lists])
    for dealt in (1 << 18, 50, 3):
        monkeypatch.setattr(line_dedup, "DEALT", dealt)
        packed = line_dedup._packed(key, first, count, values)
        assert len(packed) - packed.null_count == (1 if dealt > len(values) else len(set((ends - count[first]) // dealt)))
        batch = pa.RecordBatch.from_arrays([packed], ["blocks"])
        assert pairs([batch.slice(0, 333), batch.slice(333)]) == want
    assert line_dedup._packed(key, first[:0], count * 0, values[:0]).null_count == 1500


def test_pairs_of_all_lengths_go_side_by_side(monkeypatch):
    """Pairs no two of which have patterns of one width are decided together, up to the very distance; before, each went alone."""
    rng = random.Random(6)
    pairs = []
    for n in range(70, 1200, 10):
        a = "".join(rng.choice("abcdefgh é日") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(n // 8)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        pairs.append((a, "".join(b)))
    single = line_dedup.distance_within
    every = [(a, b, k) for a, b in pairs for k in range(0, min(126, len(a) // 5), 9)]
    want = [single(*p) for p in every]
    alone = []
    monkeypatch.setattr(line_dedup, "distance_within", lambda *p: alone.append(p) or single(*p))
    assert line_dedup.many_within(every).tolist() == want and 0 < sum(want) < len(want)
    at_tenth = [p for p in every if p[2] <= 126 and abs(len(p[0]) - len(p[1])) <= p[2]][::7]
    alone.clear()
    assert line_dedup.many_within(at_tenth).tolist() == [single(*p) for p in at_tenth]
    assert len(alone) < len(at_tenth) / 4


def test_simhash_of_many_features():
    """Beyond 127 features, too, a bit is set where it is in more than half of them."""
    rng = np.random.default_rng(4)
    sizes = [1, 126, 127, 128, 129, 254, 255, 256, 1000, 3]
    f = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    starts = np.cumsum([0, *sizes[:-1]])
    want = [sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in f[s : s + n]) > n) for s, n in zip(starts, sizes)]
    assert line_dedup.simhash(f, starts).tolist() == want
