"""Language identification, word first: known words score by their log frequency per
language; an unseen word backs off to its character n-grams, from five characters down
to one, and takes the longest length at which the model knows any of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowlint.llm.common import mix, rows_of, slices, string_hashes, texts, window_hashes, words
from sparrowlint.runtime import ship

FIT_DOCS, WORDS_PER_LANG, LONGEST = 20_000, 40_000, 5
EVIDENCE = 40.0


def letter_words(arr: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(arr), r"[^\p{L}]+", " ")


def _grams(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character windows of each word between boundary marks, and their words."""
    marked = [f"\x02{w}\x03" for w in names]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(names)), lens)
    h = window_hashes(mix(flat + np.uint64(n << 32)), n)
    ends = np.cumsum(lens)
    ok = np.arange(len(h)) + n <= ends[row[: len(h)]]
    return h[ok], row[: len(h)][ok]


class Model:
    """Sorted hashes with a row of log probabilities per language, for words and each n-gram length."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {x: i for i, x in enumerate(self.langs)}
        names = sorted({w for _, w, _ in counts})
        index = {w: i for i, w in enumerate(names)}
        table = np.zeros((len(names), len(self.langs)))
        for lang, w, c in counts:
            table[index[w], at[lang]] += c
        self.tables = {0: self._rank(string_hashes(pa.array(names, pa.string())), table)}
        for n in range(1, LONGEST + 1):
            h, row = _grams(names, n)
            u, inv = np.unique(h, return_inverse=True)
            sums = np.zeros((len(u), len(self.langs)))
            np.add.at(sums, inv, table[row])
            self.tables[n] = self._rank(u, sums)

    @staticmethod
    def _rank(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts))))
        # Relative to the mean over languages, so that only what tells languages apart counts.
        order = np.argsort(h)
        return h[order], (p - p.mean(axis=1, keepdims=True))[order].astype(np.float32) if p.size else p.astype(np.float32)

    def _look(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = self.tables[n]
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return (keys[at] == h, at) if len(keys) else (np.zeros(len(h), bool), at)

    def words(self, distinct: pa.Array) -> np.ndarray:
        """The score of each distinct word in each language."""
        out = np.zeros((len(distinct), len(self.langs)), np.float32)
        known, at = self._look(0, string_hashes(distinct))
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        names = distinct.take(pa.array(left)).to_pylist()
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, row = _grams(names, n)
            ok, at = self._look(n, h)
            sums, hits = np.zeros((len(left), len(self.langs)), np.float32), np.bincount(row[ok], minlength=len(left))
            picked = self.tables[n][1][at[ok]]
            for j in range(len(self.langs)):
                sums[:, j] = np.bincount(row[ok], picked[:, j], minlength=len(left))
            done = hits > 0
            out[left[done]] = sums[done] / hits[done, None]
            names = [w for w, d in zip(names, done) if not d]
            left = left[~done]
        return out

    def predict(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, off, distinct = words(letter_words(arr))
        n = np.diff(off)
        row = rows_of(off)
        by_word = self.words(distinct)
        sums = np.stack([np.bincount(row, by_word[codes, j], minlength=len(arr)) for j in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(arr), 0))
        if not self.langs:
            return ["und"] * len(arr), np.zeros(len(arr))
        logit = sums / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def fit(labelled: DataFrame, bound: int = FIT_DOCS, per_lang: int = WORDS_PER_LANG) -> Model:
    """A model from ``(doc_id, text, lang)``, null texts and labels aside.

    It is fitted on about ``bound`` rows: all of them, or those whose hashed doc_id falls
    below bound / rows. Of each language the ``per_lang`` commonest words are kept.
    """
    ship(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    share = min(1.0, bound / max(1, labelled.where("lang is not null").count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(it):
        for b in slices(it, "text"):
            names = b.column("lang").dictionary_encode()
            codes, off, distinct = words(letter_words(texts(b)))
            lang = names.indices.to_numpy()[rows_of(off)].astype(np.int64)
            key, c = np.unique(lang * len(distinct) + codes, return_counts=True)
            if len(key):
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // len(distinct))), distinct.take(pa.array(key % len(distinct))), pa.array(c)], ["lang", "word", "c"])

    sums = rows.mapInArrow(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("lang").orderBy(F.desc("c"), "word")
    top = sums.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_lang)
    return Model([(r.lang, r.word, r.c) for r in top.select("lang", "word", "c").toLocalIterator()])


def held_out(column):
    """crc32 of the id as text is divisible by 5; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the text alone decides.

    A null text or one without a letter is ``und`` with score 0; ties go to the first
    language by code point; with no labelled rows every text is ``und``. Repeated rows
    are predicted each; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it):
        for b in slices(it, "text"):
            lang, score = shared.value.predict(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    out = predict(docs, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with a score of at least ``least``; lang becomes the prediction.

    Null and empty texts and those without a letter go. Repeated rows are judged each, a null
    doc_id like any other; with no labelled rows nothing is identified and all go; an empty
    table gives no rows. Other columns, whatever their names, and their order stay as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(learned(docs))
    names = docs.columns

    def run(it):
        for b in slices(it, "text"):
            lang, score = shared.value.predict(texts(b))
            keep = pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist())], pa.bool_())
            cols = [pa.array(lang, pa.string()) if n == "lang" else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)
