"""Rule-based quality filter whose cut-offs follow the data: mergeable quantile sketches per (lang, source).

A bound is the group's own outer fence, whether that is tight or wide: beyond the upper decile by the distance between
the deciles.  Quantiles of small groups lean on those of their language, and these on those of all rows.

Everything here is DataFrame expressions.  Word statistics stay inside the row (higher-order functions over the array
of words), so the text itself is never exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, valid_text

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Sketch size: ranks are right to one row in so many.
ACCURACY = 10_000
#: Sketched quantiles, and how many times their distance a value may be beyond either of them.
QUANTILES, FENCE = (0.1, 0.9), 1.0
#: Rows of the parent that a group's quantiles are averaged with.
PARENT_ROWS = 30
#: Symbols, exclamation marks or repeated lines that any text may have beyond its bound: single ones prove nothing.
SINGLES = 3
#: Counts that have an upper bound, and what they are counted against.
RATIOS = {"n_symbols": "n_words", "n_bangs": "n_words", "n_dup_lines": "n_lines"}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(value: Column, body) -> Column:
    """body(value) with ``value`` computed once: it is bound as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found at least twice in the array."""
    windows = lambda ids: F.transform(F.sequence(F.lit(0), F.size(ids) - WINDOW), lambda i: F.xxhash64(*[F.get(ids, i + k) for k in range(WINDOW)]))
    equal = lambda a, i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
    dup = lambda a: F.array_sort(F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x["i"].alias("i"), (equal(a, i, i - 1) | equal(a, i, i + 1)).alias("dup"))), lambda x: x["dup"]), lambda x: x["i"]))
    cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # most texts repeat no window: a set tells, and spares them the sort
    covered = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_once(_once(placed(h), dup), cover))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_once(F.transform(words, lambda w: F.xxhash64(w)), lambda ids: _once(windows(ids), covered)))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the word statistics of each row."""
    text = F.coalesce(valid_text(), F.lit(""))
    base = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    of_words = _once(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda s: F.translate(s, BLANKS, "") != "")
    of_lines = _once(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    less = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return base.select(
        "doc_id", "lang", "source", of_words.alias("w"), of_lines.alias("l"), F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"), less(SYMBOLS).alias("n_symbols"), less("!").alias("n_bangs")
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words", "n_bangs")


def thresholds(measured: DataFrame) -> DataFrame:
    """Per (lang, source): the upper bound of each ratio, and both bounds of the mean word length.

    One pass of mergeable sketches over the rows that pass the base rules gives the quantiles of the groups, of the
    languages and of all rows.
    """
    values = {c: F.col(c) / F.nullif(F.col(of), F.lit(0)) for c, of in RATIOS.items()} | {"word_chars": F.col("word_chars") / F.col("n_words")}
    sketch = [F.percentile_approx(v, list(QUANTILES), ACCURACY).alias(c) for c, v in values.items()]
    fine = measured.where(~F.col("base_failed"))
    every = fine.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *sketch)
    mine, of_lang, of_all = (every.where(F.col("level") == k) for k in (0, 1, 3))  # a row a group, a row a language, one row
    of_lang = of_lang.select(F.col("lang").alias("l_lang"), (F.col("level") + 2).alias("up"), *[F.col(c).alias(f"l_{c}") for c in ("n", *values)])
    of_all = of_all.select(F.col("level").alias("top"), *[F.col(c).alias(f"a_{c}") for c in ("n", *values)])
    both = mine.join(of_lang, mine["lang"].eqNullSafe(of_lang["l_lang"])).join(of_all, F.col("up") == F.col("top"))
    lean = lambda n, x, up: (n * x + PARENT_ROWS * up) / (n + PARENT_ROWS)
    low, high = ((lambda c, k=k: lean(F.col("n"), F.get(F.col(c), F.lit(k)), lean(F.col("l_n"), F.get(F.col(f"l_{c}"), F.lit(k)), F.get(F.col(f"a_{c}"), F.lit(k))))) for k in (0, 1))
    upper, lower = (lambda c: high(c) + FENCE * (high(c) - low(c))), (lambda c: low(c) - FENCE * (high(c) - low(c)))
    return both.select("lang", "source", *[upper(c).alias(f"max_{c}") for c in values], lower("word_chars").alias("min_word_chars"))


def judge(docs: DataFrame) -> DataFrame:
    """Word statistics and verdict for each row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.  A row is kept if
    it passes the base rules, no count exceeds its (lang, source) group's bound by more than SINGLES, and its mean word
    length is within the group's bounds.  Null text has no words and fails; bytes that are no UTF-8 read as U+FFFD; null
    lang or source form groups of their own; repeated rows are judged one by one (and weigh as often in the sketches);
    equal values rank alike; texts are read whole; empty tables give no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = materialize(metrics(docs).withColumn("base_failed", failed), "quality")
    t = thresholds(measured).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    row = measured.join(t, measured["lang"].eqNullSafe(t["t_lang"]) & measured["source"].eqNullSafe(t["t_source"]), "left")
    mean = F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))
    out = (mean < F.col("min_word_chars")) | (mean > F.col("max_word_chars"))
    for c, of in RATIOS.items():
        out = out | (F.col(c) > F.col(f"max_{c}") * F.col(of) + SINGLES)
    return row.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & ~F.coalesce(out, F.lit(False))).alias("kept"))
