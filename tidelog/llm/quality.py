r"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token n-grams are estimated: one from trusted
documents (all rows labelled as good), one from all raw documents. A document's score is the mean log ratio of its n-grams; those
below a fixed threshold are rejected, as are those that fail the base rules.
Everything runs as built-in expressions on the JVM.

Words are runs of characters other than space and U+0009 to U+000D; the
n-grams are taken over tokens, which are letters, digits, or one other
character, so that marks on words have n-grams of their own.

Cases with a defined result: a null or empty text has no words and fails the
base rules; without trusted documents all scores are 0 and only the base rules
decide; a label without an id or a repeated label changes nothing; repeated
rows each count and get the same verdict, rows of equal id are all trusted if
one is; a null id is never trusted; a text of any length is counted whole; other
columns are kept, except those named like an output; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
TOKENS = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"
SYMBOLS = "#*$%&|<>"
BUCKETS = 16384
#: Least mean log ratio of a document that stays.
THRESHOLD = -0.1
#: Up to so many different repeated windows are looked up one by one, more by sorting.
FEW = 24

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at the sorted positions."""
    ahead = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.element_at(starts, -1) + 3))
    return F.aggregate(F.zip_with(starts, ahead, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda n, x: n + x)


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def by_sorting(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
        kept = _let(pairs, lambda p: F.filter(p, lambda _, i: same(p, i, i - 1) | same(p, i, i + 1)))
        return _let(F.sort_array(F.transform(kept, lambda x: x["i"])), _covered)

    def counted(h: Column) -> Column:
        twice = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))

        def decide(d: Column) -> Column:
            few = _let(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull()), _covered)
            return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= FEW, few).otherwise(by_sorting(h))

        return _let(twice, decide)

    return F.when(n < 4, F.lit(0)).otherwise(_let(windows, counted))


def base_rules(df: DataFrame) -> DataFrame:
    """Adds the base counts and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = df.drop(*BASE, "_words", "_lines").withColumns({"_words": words, "_lines": lines})
    w = F.col("_words")
    counted = counts.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(w).cast("long"),
    }).drop("_words", "_lines")
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _buckets(text: Column) -> Column:
    """Hashed unigrams and bigrams of the tokens."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")

    def both(t: Column) -> Column:
        one = F.transform(t, lambda x: bucket(x))
        two = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: bucket(t[i], t[i + 1]))
        return F.when(F.size(t) < 2, one).otherwise(F.concat(one, two))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), both)


def flagged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(trusted, text) of all rows, ``trusted`` 1 or null.

    The join is a shuffled one at every size: ids of trusted documents grow with the
    input and are never broadcast, and they are hashed, as texts would take disk to sort.
    """
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    texts = df.select("doc_id", "text")
    # rows without an id go past the join, where they would all meet in one task
    known = texts.filter("doc_id is not null").join(trusted.hint("shuffle_hash"), "doc_id", "left").select("trusted", "text")
    return known.union(texts.filter("doc_id is null").select(F.lit(None).cast("int"), "text"))


def weights(df: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of each bucket's probability: trusted documents against all."""
    rows = (
        flagged(df, labels).select("trusted", F.explode(_buckets(F.col("text"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    )
    counts = {r["bucket"]: (r["raw"], r["good"]) for r in rows.collect()}  # BUCKETS rows at most
    all_raw, all_good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not all_good:
        return [0.0] * BUCKETS
    # both are smoothed towards the raw share, the trusted side by half a count for each bucket
    found = []
    for b in range(BUCKETS):
        raw, good = counts.get(b, (0, 0))
        q = (raw + 0.5) / (all_raw + 0.5 * BUCKETS)
        p = (good + 0.5) / (all_good + 0.5 * BUCKETS)
        found.append(round(math.log(p / q), 6))
    return found


def score(df: DataFrame, ratio: list[float]) -> DataFrame:
    """Adds ``llr``, the mean log ratio of the n-grams (0 without any)."""
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")  # folded into one literal
    mean = lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.aggregate(b, F.lit(0.0), lambda s, x: s + table[x]) / F.size(b))
    return df.withColumn("llr", _let(_buckets(F.col("text")), mean))


def judge(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``llr`` and ``kept`` to every document."""
    ratio = weights(df, labels)
    return score(base_rules(df.drop("llr", "kept")), ratio).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents with their own columns."""
    judged = judge(df.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in df.columns if c != "text"]).alias("_row")), labels)
    # the running number keeps the optimizer from copying the verdict's expressions into the filter
    barred = judged.select("text", "_row", "kept", F.monotonically_increasing_id().alias("_n"))
    kept = barred.filter(F.col("kept") & (F.col("_n") >= 0))
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in df.columns])
