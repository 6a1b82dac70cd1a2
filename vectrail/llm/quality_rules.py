"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base: counts of words, symbols, repeated lines and words in repeated 5-word windows; fixed rules fail a document.
Method: for each stratum and measure, cutoffs from a fixed grid are tested on labelled holdout documents
of quality 1. A cutoff is certified if the hypothesis "it rejects more than ``risk`` of the good documents" is
refuted by the exact binomial tail P(Bin(n, risk) <= k), k of n good documents rejected, at level
``delta`` / (strata x measures) (Bonferroni). Along a grid the rejected sets are nested, so cutoffs are
tested from the loosest on and stop at the first that fails: a fixed sequence, without a further correction.
``risk`` is the stratum's risk shared equally by the measures, so that by the union bound the rules together
falsely reject at most ``stratum_risk`` of each stratum with probability 1 - ``delta``. The tightest
certified cutoff is used if it also rejects ``lift`` times as large a share of the labelled bad documents.

Cases: a null or empty text has no words and fails the base; a null stratum is the stratum ``(null)``; a
stratum without enough good labels has no certified cutoff and rejects nothing; ties at a cutoff are kept; equal
rows are judged alike; a document with several labels counts once for each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, cut

NULL = "(null)"


@dataclass(frozen=True)
class Settings:
    stratum_risk: float = 0.02
    delta: float = 0.05
    lift: float = 10.0
    least_words: int = 10
    most_repeat_percent: int = 20
    window: int = 5
    #: Cutoffs of each measure, from loose to tight; a document is rejected above the cutoff.
    grid: dict[str, Sequence[float]] = field(
        default_factory=lambda: {
            "symbol_ratio": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
            "mark_ratio": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
            "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
            "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
            "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
        }
    )


def _repeat_words(words: Column, hashes: Column, window: int) -> Column:
    """Words within windows that are found twice or more, from the windows' hashes (materialised columns)."""
    # (hash, place) in order of hash; a place is repeated if a neighbour has its hash.
    n = F.size("__pairs")
    left = F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice("__pairs", 1, n - 1), lambda p: p["h"]))
    right = F.concat(F.transform(F.slice("__pairs", 2, n), lambda p: p["h"]), F.array(F.lit(None).cast("long")))
    flags = F.arrays_zip(F.col("__pairs").alias("p"), left.alias("l"), right.alias("r"))
    return F.array_sort(F.transform(F.filter(flags, lambda x: (x["p"]["h"] == x["l"]) | (x["p"]["h"] == x["r"])), lambda x: x["p"]["i"]))


def measured(docs: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks.

    Columns of ``docs`` with these names are replaced. Everything is computed within a row: windows are hashed (64 bits), and only documents in which a hash
    repeats sort their windows, so a row costs n log n at most and nothing is shuffled.
    """
    s = settings or Settings()
    t = F.coalesce(F.col(text), F.lit(""))
    k = s.window
    df = docs.withColumn("__w", F.filter(F.split(F.trim(t, F.lit(SPACE)), rf"{SPACE_CLASS}+"), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Window i: words i .. i+k-1, by the shifted lists beside each other.
    n = F.size("__w")
    shifted = [F.slice("__w", j + 1, F.greatest(n - (k - 1), F.lit(0))) for j in range(k)]
    zipped = F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(shifted)))
    df = df.withColumn("__h", F.when(n > k, F.transform(zipped, lambda x: F.xxhash64(*(x[f"w{j}"] for j in range(k))))))
    repeats = F.col("__h").isNotNull() & (F.size(F.array_distinct("__h")) < F.size("__h"))
    df = df.withColumn("__pairs", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__at", F.when(F.col("__pairs").isNotNull(), _repeat_words(F.col("__w"), F.col("__h"), k)))
    m = F.size("__at")
    gaps = F.zip_with(F.slice("__at", 1, m - 1), F.slice("__at", 2, m), lambda a, b: F.least(b - a, F.lit(k)))
    repeated = F.when(F.col("__at").isNotNull() & (m > 0), F.aggregate(gaps, F.lit(k).cast("long"), lambda acc, g: acc + g)).otherwise(F.lit(0).cast("long"))
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"}
    return df.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit(r"[!?|_~^=]")).cast("long").alias("n_marks"),
    )


def _measures() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "mark_ratio": F.col("n_marks") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }


def base_failed(s: Settings) -> Column:
    return (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.most_repeat_percent * F.col("n_words"))


def _lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 10, brought back by the recurrence."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = F.lit(0.0)
    for j in range(10):
        back = back + F.ln(x + j)
    return series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p (else 1): terms are added downwards from k, each from the one above.

    The logarithm of the terms is concave with a bend of at least 1/k, so the i-th term below k is at most
    exp(-i (i - 1) / 2k) of it: terms after the first 10 sqrt(k) + 10 are below double precision, and none
    that counts is left out, whatever the size of k.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(10 * F.sqrt(k)) + 10).cast("int"))
    # term(j - 1) = term(j) * j (1 - p) / ((n - j + 1) p), with j = k - i, relative to term(k)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    ratio = lambda i: (k - i) * (1 - p) / ((n - (k - i) + 1) * p)
    added = F.aggregate(steps, start, lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(i)).alias("term")))
    return F.when((n <= 0) | (k > n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * added["sum"]))


def thresholds(rows: DataFrame, labels: DataFrame, settings: Settings | None = None, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, measure, cutoff, n_good, k): one row at most for each stratum and measure.

    ``rows`` has the key, ``stratum``, ``base_failed`` and the measures. Labelled documents are reduced to counts
    for each stratum, measure and number of cutoffs passed, within tasks first.
    """
    s = settings or Settings()
    known = rows.where(~F.col("base_failed")).join(labels.select(F.col(key), F.col(label).alias("__y")).where(F.col("__y").isNotNull()), key)
    # How many cutoffs, from the loose end, a document doesn't exceed.
    passed = [F.struct(F.lit(m).alias("measure"), sum(((F.col(m) <= c).cast("int") for c in grid), F.lit(0)).alias("passed")) for m, grid in s.grid.items()]
    counts = known.select("stratum", F.col("__y").alias("y"), F.explode(F.array(*passed)).alias("m")).groupBy("stratum", "m.measure", "m.passed").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    grids = F.create_map(*(x for m, grid in s.grid.items() for x in (F.lit(m), F.array(*(F.lit(float(c)) for c in grid)))))
    # A document with passed = j is rejected by the cutoffs at places j, j+1, ...
    group = Window.partitionBy("stratum", "measure")
    upto = group.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    places = F.explode(F.sequence(F.lit(0), F.lit(max(map(len, s.grid.values()))))).alias("place")
    cells = counts.select("stratum", "measure").distinct().select("*", places)
    table = cells.join(counts.withColumnRenamed("passed", "place"), ["stratum", "measure", "place"], "left").na.fill(0, ["good", "bad"])
    table = table.select(
        "stratum", "measure", "place",
        F.sum("good").over(upto).alias("k"), F.sum("good").over(group).alias("n_good"),
        F.sum("bad").over(upto).alias("bad_k"), F.sum("bad").over(group).alias("n_bad"),
        F.get(F.try_element_at(grids, F.col("measure")), F.col("place")).alias("cutoff"),
    ).where(F.col("cutoff").isNotNull())
    strata = rows.agg(F.count_distinct("stratum")).first()[0]  # one number
    p = binomial_tail(F.col("n_good"), F.col("k"), s.stratum_risk / len(s.grid))
    certified = p <= F.lit(s.delta / max(1, strata * len(s.grid)))
    useful = (F.col("n_bad") > 0) & (F.col("bad_k") * F.col("n_good") >= F.lit(s.lift) * F.col("k") * F.col("n_bad")) & (F.col("bad_k") > 0)
    table = table.withColumn("ok", certified).withColumn("in_row", F.min("ok").over(upto)).where(F.col("in_row") & useful)
    return table.groupBy("stratum", "measure").agg(F.min("cutoff").alias("cutoff"), F.max_by("n_good", "place").alias("n_good"), F.max_by("k", "place").alias("k"))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Of each document: key, base counts, base_failed, the measures, ``rule`` (the first measure that rejects it) and kept."""
    s = settings or Settings()
    rows = measured(docs.select(F.col(key), F.col(text), F.coalesce(F.col(stratum), F.lit(NULL)).alias("stratum")), text, s).drop(text)
    # Numbers alone are written; the texts are read once.
    rows = cut(rows.withColumn("base_failed", base_failed(s)), "quality").withColumns(_measures())
    cutoffs = thresholds(rows, labels, s, key)
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("__cutoffs"))
    joined = rows.join(wide, "stratum", "left")
    rule = F.coalesce(*(F.when(F.col(m) > F.try_element_at("__cutoffs", F.lit(m)), F.lit(m)) for m in s.grid))
    return joined.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("__cutoffs")
