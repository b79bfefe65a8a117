"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed 1- and 2-grams of a text's lower-cased runs of word characters and of
symbols: one from trusted documents, one from the whole corpus. A document's score is the mean,
over its n-grams, of log p(trusted) - log p(corpus); a document below the threshold fails, every
time and wherever it stands. The corpus side counts every document; the trusted side is a bounded sample of the
labelled ones, smoothed towards the corpus: the less trusted text there is, the nearer to 0 all scores
are, and without any they are 0, so that no document fails by its score. The model is one number a bucket. Everything is built-in expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import WHITE, fresh, let, whole, words

BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on, at the most.
MOST_TRUSTED = 20_000
#: Counts a bucket of the corpus; as many of the corpus multinomial are added to the trusted one.
SMOOTHING = 1.0
THRESHOLD = -0.5
#: Words of a repeat; a power of two.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _buckets(text: Column, buckets: int) -> Column:
    """Bucket of each 1-gram and 2-gram of a text: a 2-gram's is made of its two hashes."""
    grams = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0))
    bucket = lambda *h: F.pmod(F.xxhash64(*h), F.lit(buckets)).cast("int")

    def both(hashes: Column) -> Column:
        pairs = F.zip_with(hashes, F.slice(hashes, 2, F.size(hashes)), lambda a, b: bucket(a, b))
        ones = F.transform(hashes, lambda h: bucket(h))
        return F.concat(ones, F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))))

    return let(F.transform(grams, lambda g: F.xxhash64(g)), both)


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED, key: str = "doc_id") -> DataFrame:
    """Ids labelled good and not toxic in all their labels: the ``most`` of least hash."""
    good = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 AND t = 0").orderBy(F.xxhash64(key), key).limit(most).select(key)


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Weight of each bucket: its log probability among ``trusted`` (bounded, distinct ids) less that among all ``docs``.
    Without trusted documents every weight is 0."""
    trusted = trusted.select(F.col(key).alias("_key"), F.lit(1).alias("_good"))
    rows = docs.select(F.col(key).alias("_id"), _buckets(whole(text), buckets).alias("_grams"))
    rows = rows.join(F.broadcast(trusted), F.col("_id") == F.col("_key"), "left")
    counts = rows.select(F.explode("_grams").alias("b"), F.coalesce("_good", F.lit(0)).alias("g")).groupBy("b")
    found = {r.b: (r.good, r.n) for r in counts.agg(F.sum("g").alias("good"), F.count("*").alias("n")).collect()}
    added = SMOOTHING * buckets
    good_all = sum(g for g, _ in found.values()) + added
    raw_all = sum(n for _, n in found.values()) + added
    pairs = ((g, (n + SMOOTHING) / raw_all) for g, n in (found.get(b, (0, 0)) for b in range(buckets)))
    return [math.log((g + added * raw) / (good_all * raw)) for g, raw in pairs]


def score(text: Column, weights: list[float]) -> Column:
    """Mean weight of a text's n-grams; 0 for a text without."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

    return let(_buckets(text, len(weights)), mean)


def repeated_words(found: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text, the first included.

    Window hashes are sorted with their places, so that equal ones are neighbours; the places of
    those, sorted again, cover up to eight words each.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def twice(spans: Column) -> Column:
        """Places of the windows that have an equal neighbour."""
        with_next = F.zip_with(spans, F.slice(spans, 2, F.size(spans)), lambda a, b: a["h"].eqNullSafe(b["h"]))

        def places(equal: Column) -> Column:
            flags = F.zip_with(equal, F.concat(F.array(F.lit(False)), equal), lambda a, b: F.coalesce(a, F.lit(False)) | b)
            marked = F.zip_with(spans, flags, lambda s, f: F.when(f, s["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        return let(with_next, places)

    def of_windows(spans: Column) -> Column:
        pairs = F.array_sort(F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(spans)) < F.size(spans)
        return F.when(repeats, let(let(pairs, twice), covered)).otherwise(0)

    def joined(runs: Column, step: int) -> Column:
        """Hashes of runs of twice the length, of those that start ``step`` apart."""
        both = F.zip_with(runs, F.slice(runs, step + 1, F.size(runs)), lambda a, b: F.xxhash64(a, b))
        return F.slice(both, 1, F.greatest(F.size(runs) - step, F.lit(0)))

    def of_hashes(hashes: Column) -> Column:
        of_four = lambda fours: let(joined(fours, 4), of_windows)
        of_two = lambda twos: let(joined(twos, 2), of_four)
        return F.when(F.size(hashes) >= WINDOW, let(joined(hashes, 1), of_two)).otherwise(0)

    return let(F.transform(found, lambda w: F.xxhash64(w)), of_hashes)


def judge(df: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score
    and kept, which replace columns of those names.

    Words are runs of characters other than blank and 0x09-0x0D. A text of under 20 words, or with
    more than three words of ten in repeated windows, fails; so does one whose score is below the
    threshold. A null text counts as empty. Each row is judged alone, so repeated rows, ties and an
    empty table need no care.
    """
    body, counts = fresh(df, "body"), fresh(df, "counts")
    rows = df.withColumn(body, whole(text))
    lines = F.filter(F.split(body, "\n", -1), lambda s: F.length(F.btrim(s, F.lit(WHITE))) > 0)
    of_words = lambda found: F.struct(
        F.size(found).alias("n"),
        F.aggregate(found, F.lit(0), lambda s, w: s + F.length(w)).alias("chars"),
        repeated_words(found).alias("repeats"),
    )
    rows = rows.withColumn(counts, let(words(F.col(body)), of_words))
    as_long = lambda c: c.cast("long")
    rows = rows.withColumns({
        "n_words": as_long(F.col(counts)["n"]),
        "word_chars": as_long(F.col(counts)["chars"]),
        "n_repeat_words": as_long(F.col(counts)["repeats"]),
        "n_symbols": as_long(F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))),
        "n_dup_lines": as_long(let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))),
        "score": score(F.col(body), weights),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop(body, counts)
