"""Mixing sources to target weights: a budget of tokens flows down a tree of domain, language and source.

Each node's budget is shared among its children by weight. A child can use at most its capacity (its tokens
times ``max_epochs``); what it can't use goes to its siblings by their weights, and since a node's capacity is
the sum of its children's, a shortage is first made up among siblings and reaches an ancestor only when the
whole subtree is short. With children in order of capacity / weight, the shares have a closed form in
prefix sums, so a level is one window over the children of a node: no iteration.

A leaf's budget is filled from epochs: each epoch is an order of the leaf's documents by a seeded hash. Whole
epochs are taken as long as they fit; the last one gives the longest prefix of documents that fits. The
prefix is found without sorting a leaf: its documents are dealt into ranges of the hash, range totals are
added up, and only the one range in which the budget ends is ordered.

Cases: null languages and sources are the text ``(null)``; a null or empty text has 0 tokens and belongs
to the prefix as far as its place in the order does; rows of one id are ordered by id and then by the hash of
their text, and equal rows are taken together by the sum of their tokens; a leaf without tokens gets no budget;
what has weight 0 gets none and its share goes to the others; a negative weight is an error;
an empty table gives an empty result. Tokens are white-space words. Columns of the result that the input already has are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut

NULL = "(null)"


@dataclass(frozen=True)
class Targets:
    """Weights by domain, by language and by source; what isn't named has weight 1. Weights are relative among siblings."""

    domains: dict[str, float] = field(default_factory=lambda: {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0})
    sources: dict[str, float] = field(default_factory=dict)
    n_domains: int = 4  # domains are a hash of the source, modulo this, where the input has no column domain
    budget: float = 0.5  # of the input's tokens
    max_epochs: int = 3
    seed: str = "mix-1"
    range_rows: int = 2_000  # documents of a range, about

    def __post_init__(self):
        if any(not 0 <= w < float("inf") for level in (self.domains, self.languages, self.sources) for w in level.values()):
            raise ValueError("weights are finite and not negative")


def n_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""), rf"{SPACE_CLASS}+")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.size(words)).otherwise(0).cast("long")


def domain_of(source: Column, n: int) -> Column:
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("string"))


def _weight(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, w in sorted(weights.items()):
        out = F.when(name == k, F.lit(float(w))).otherwise(out)
    return out


def _share(level: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each child from ``parent_budget``, ``weight`` and ``capacity``: water-filling in closed form."""
    # Children fill up in this order; the names make ties definite and change no share.
    names = [c for c in ("domain", "lang", "source") if c in level.columns and c not in parent]
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *names)
    before = F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    # The water's level if all earlier children are full and this one and the later ones share the rest. It rises as
    # long as children are full and falls from then on, so the level that holds is the highest one.
    level = level.withColumn("__water", (F.col("parent_budget") - before) / after)
    level = level.withColumn("__water", F.greatest(F.lit(0.0), F.max("__water").over(Window.partitionBy(*parent))))
    return level.withColumn("budget", F.least("capacity", F.col("weight") * F.col("__water"))).drop("__water")


def leaf_budgets(rows: DataFrame, t: Targets) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget): from the tokens of each leaf, one row per leaf throughout."""
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = cut(leaves.withColumn("capacity", F.col("tokens").cast("double") * t.max_epochs), "leaves")
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(t.budget)).cast("double")).first()[0]  # one number
    # What weighs nothing gets nothing, so it has no capacity in its ancestors either.
    for name, weights in (("domain", t.domains), ("lang", t.languages), ("source", t.sources)):
        leaves = leaves.where(_weight(F.col(name), weights) > 0)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = _share(domains.withColumn("parent_budget", F.lit(total)).withColumn("weight", _weight(F.col("domain"), t.domains)), [])
    mid = _share(langs.join(top.select("domain", F.col("budget").alias("parent_budget")), "domain").withColumn("weight", _weight(F.col("lang"), t.languages)), ["domain"])
    low = leaves.join(mid.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), t.sources))
    low = _share(low, ["domain", "lang"])
    return low.select("domain", "lang", "source", "tokens", "docs", F.floor(F.round("budget", 3)).cast("long").alias("budget"))


_LEAF = ["domain", "lang", "source"]
#: Most rows about leaves that are broadcast.
BROADCAST_ROWS = 50_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, targets: Targets | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``domain``, ``n_tokens`` and ``epoch``: one row for each epoch in which a document is taken.

    The columns named lang and source of the input give the tree; a column domain is used if there is one.
    """
    t = targets or Targets()
    source = F.coalesce(F.col("source"), F.lit(NULL))
    domain = F.coalesce(F.col("domain").cast("string"), F.lit(NULL)) if "domain" in docs.columns else domain_of(source, t.n_domains)
    kept = [c for c in docs.columns if c.lower() not in ("domain", "n_tokens", "epoch")]
    small = docs.select(
        domain.alias("domain"), F.coalesce(F.col("lang"), F.lit(NULL)).alias("lang"), source.alias("source"),
        F.coalesce(F.col(key).cast("string"), F.lit(NULL)).alias("id"), F.xxhash64(text).alias("row"), n_words(F.col(text)).alias("n"),
    )
    # Equal rows become one with the sum of their tokens; the texts stay behind until the choice is made.
    rows = cut(small.groupBy(*_LEAF, "id", "row").agg(F.sum("n").alias("tokens")), "mix-rows")
    leaves = cut(leaf_budgets(rows, t), "mix-leaves")
    # Whole epochs, and what the next one may still take.
    leaves = leaves.where((F.col("budget") > 0) & (F.col("tokens") > 0)).withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(t.range_rows))).cast("int"))
    ordered = rows.join(_small(leaves.select(*_LEAF, "whole", "rest", "ranges")), _LEAF)
    h = F.md5(F.concat_ws(":", F.lit(t.seed), F.col("whole").cast("string"), "id").cast("binary"))
    ordered = ordered.withColumn("h", h).withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.col("ranges")).cast("int"))
    # Where the budget ends: totals of the ranges, one row for each leaf and range.
    sums = ordered.groupBy(*_LEAF, "range").agg(F.sum("tokens").alias("in_range"))
    w = Window.partitionBy(*_LEAF).orderBy("range")
    sums = cut(sums.withColumn("upto", F.sum("in_range").over(w)), "mix-ranges")
    ordered = ordered.join(_small(sums), [*_LEAF, "range"])
    state = F.when(F.col("upto") <= F.col("rest"), "all").when(F.col("upto") - F.col("in_range") <= F.col("rest"), "some").otherwise("none")
    ordered = ordered.withColumn("state", state)
    inside = Window.partitionBy(*_LEAF, "range").orderBy("h", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    some = ordered.where(F.col("state") == "some").withColumn("last", (F.col("upto") - F.col("in_range") + F.sum("tokens").over(inside)) <= F.col("rest"))
    others = ordered.where(F.col("state") != "some").withColumn("last", F.col("state") == "all")
    chosen = some.unionByName(others).withColumn("times", F.col("whole") + F.col("last").cast("int")).where(F.col("times") > 0)
    chosen = chosen.select(*(F.col(c).alias(f"__{c}") for c in (*_LEAF, "id", "row", "times")))
    same = (F.col("__id") == F.coalesce(F.col(key).cast("string"), F.lit(NULL))) & (F.col("__row") == F.xxhash64(text))
    same &= (F.col("__lang") == F.coalesce(F.col("lang"), F.lit(NULL))) & (F.col("__source") == source) & (F.col("__domain") == domain)
    taken = docs.join(chosen, same)
    return taken.select(*(F.col(f"`{c}`") for c in kept), F.col("__domain").alias("domain"), n_words(F.col(text)).alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"))
