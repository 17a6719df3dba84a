"""Quality rules: base statistics of whole texts and a learned decision list over them.

Sequential covering: on the labelled rows, conjunctions of threshold conditions on the
statistics are grown for low quality by information gain on two thirds of the rows and
pruned on the rest; the rows a rule covers are set aside and the next rule is grown,
until none is precise enough. The list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlint.llm.common import repeats, rows_of, slices, string_hashes, texts, window_hashes, words
from sparrowlint.runtime import Workspace, ship

FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}


def count(arr: pa.Array) -> dict[str, np.ndarray]:
    n = len(arr)
    codes, off, distinct = words(arr)
    row, per = rows_of(off), np.diff(off)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    h = string_hashes(distinct)[codes]
    out = {"n_words": per, "word_chars": np.bincount(row, lengths[codes], minlength=n).astype(np.int64)}
    out["n_symbols"] = pc.count_substring_regex(arr, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pc.split_pattern(arr, "\n")
    lo = lists.offsets.to_numpy().astype(np.int64)
    lrow, flat = rows_of(lo), lists.flatten()
    full = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    lines = flat.filter(pa.array(full)).dictionary_encode()
    _, earlier = repeats(string_hashes(lines.dictionary, 3)[lines.indices.to_numpy()], lrow[full])
    out["n_dup_lines"] = np.bincount(lrow[full], earlier, minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(lrow[full], minlength=n)
    w = window_hashes(h, 8)
    wrow = row[: len(w)]
    at = np.flatnonzero(np.arange(len(w)) + 8 <= off[1:][wrow])
    again, _ = repeats(w[at], wrow[at])
    mark = np.zeros(len(codes) + 1, np.int64)
    np.add.at(mark, at[again], 1)
    np.add.at(mark, at[again] + 8, -1)
    out["n_repeat_words"] = np.bincount(row, np.cumsum(mark)[:-1] > 0, minlength=n).astype(np.int64)
    _, before = repeats(h, row)
    out["n_distinct"] = np.bincount(row, ~before, minlength=n).astype(np.int64)
    for name, pattern in (("n_upper", r"\p{Lu}"), ("n_digits", r"[0-9]")):
        per_word = pc.count_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
        out[name] = np.bincount(row, per_word[codes], minlength=n).astype(np.int64)
    stops = pc.match_substring_regex(distinct, r"[.!?]$").to_numpy(zero_copy_only=False)
    out["n_stops"] = np.bincount(row, stops[codes], minlength=n).astype(np.int64)
    return out


ALL = (*COUNTS, "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of each whole text (null: none of anything)."""
    ship(docs.sparkSession)

    def run(it):
        for b in slices(it, "text"):
            c = count(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in ALL)], ["doc_id", *ALL])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in ALL))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, whether above, threshold); what it covers is low quality."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, t in self.conditions:
            out &= (x[f] > t) if above else (x[f] <= t)
        return out

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {'>' if above else '<='} {t!r}D" for f, above, t in self.conditions)


def _best(x, y, live):
    """The condition with the largest information gain among the covered rows."""
    p0, n0 = y[live].sum(), (~y[live]).sum()
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for f, v in x.items():
        order = np.argsort(v[live], kind="stable")
        s, t = v[live][order], y[live][order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(t)[cut], np.cumsum(~t)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, above, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
    return best[1]


def learn(x: dict[str, np.ndarray], low: np.ndarray, precision: float = 0.9, least: int = 5, longest: int = 4) -> list[Rule]:
    """An ordered list of rules for low quality. ``precision`` is what a rule must reach on the pruning rows."""
    rules: list[Rule] = []
    if not len(low):
        return rules
    prune = np.random.default_rng(3).permutation(len(low)) % 3 == 0
    left = np.ones(len(low), bool)
    while len(rules) < 20:
        grow = left & ~prune
        live, conditions = grow.copy(), []
        while len(conditions) < longest and (c := _best(x, low, live)):
            conditions.append(c)
            live = grow & Rule(tuple(conditions)).covers(x)
        best = None
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]))
            hit = rule.covers(x) & left
            p, n = (low & hit & prune).sum(), (~low & hit & prune).sum()
            if (low & hit).sum() >= least and p + n and p / (p + n) >= precision and (best is None or p - n > best[0]):
                best = (p - n, rule)
        if best is None:
            break
        rules.append(best[1])
        left &= ~best[1].covers(x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false at the first rule that covers the row, else true."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.sql()), F.lit(False)) if out is None else out.when(F.expr(r.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def fit(stats: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> list[Rule]:
    """Rules from the labelled rows that pass the base rules: all, or about ``bound`` of them by hashed doc_id."""
    marks = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    share = min(1.0, bound / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(f"not ({BASE})").join(marks, "doc_id").select("doc_id", "quality", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    t = rows.toArrow().sort_by([("doc_id", "ascending"), *((f, "ascending") for f in FEATURES)])
    return learn({f: t.column(f).to_numpy() for f in FEATURES}, t.column("quality").to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    kept is false where base_failed, else the learned list's verdict; without usable
    labels the list is empty and keeps the rest. A null text has no words and fails.
    Repeated rows are judged each; a null doc_id is judged but not learned from; of
    repeated labels the lower counts. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.table(statistics(docs), "stats")
    rules = fit(stats, labels)
    failed = F.expr(BASE)
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
