"""Mixing sources to target shares of the total size.

Budgets are propagated down a tree of domains, languages and sources by the
targets' weights. A node that cannot use its share (its texts times their allowed
repeats are too few) is filled, and the rest goes to its siblings by their
weights; only what all of them cannot use rises to the next ancestor. Each
source's budget is then taken from seeded epochs: whole passes over its texts in
seeded order, and of the last pass the prefix whose tokens come nearest to the rest.

Prefixes are found by tokens per hash bucket first and by single texts only
within the bucket where the budget ends, so a source with a third of all rows is
never one task.

Defined results: sources without a target, or with a share of 0 or null, give
nothing; a null ``max_repeats`` counts as 1; targets without texts are reported
with a share of 0; null sources have no target; empty texts are never drawn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    """A node of the tree; a leaf has a weight and a capacity of its own."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: float = 0.0

    def settle(self) -> None:
        for child in self.children.values():
            child.settle()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())


def spread(node: Node, amount: float) -> None:
    """Gives ``amount``, at most its capacity, to a node and down to its leaves."""
    node.budget = min(amount, node.capacity)
    open_ = [c for c in node.children.values() if c.weight > 0 and c.capacity > 0]
    given = {c.name: 0.0 for c in node.children.values()}
    left = node.budget
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_)
        short = [c for c in open_ if c.capacity <= given[c.name] + left * c.weight / total]
        if not short:
            for c in open_:
                given[c.name] += left * c.weight / total
            break
        for c in short:
            left -= c.capacity - given[c.name]
            given[c.name] = c.capacity
        open_ = [c for c in open_ if c not in short]
    for c in node.children.values():
        spread(c, given[c.name])


def budgets(sources: list[tuple], total: float | None = None) -> dict[str, float]:
    """Tokens to draw from each source; ``sources`` holds (source, domain, language,
    tokens, share, repeats). ``total`` is all tokens of sources with a target."""
    root = Node("")
    leaves = []
    for source, domain, language, tokens, share, repeats in sources:
        lang = root.children.setdefault(domain, Node(domain)).children.setdefault(language, Node(language))
        leaf = lang.children[source] = Node(source, share or 0.0, (tokens or 0) * max(repeats or 1, 1) if (share or 0) > 0 else 0.0)
        leaves.append(leaf)
    root.settle()
    spread(root, sum(t or 0 for _, _, _, t, s, _ in sources if s) if total is None else total)
    return {leaf.name: leaf.budget for leaf in leaves}


def domain_of(source: str):
    """A source's domain: the last word of its name before the top-level part."""
    return F.regexp_extract(source, r"([^_]+)_[^_]+$", 1)


def source_budgets(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, domain, language, target_share, max_repeats, available, budget, texts): a
    row a target. ``sizes`` is (doc_id, source, lang, n_tokens)."""
    lang = F.lower(F.regexp_extract("lang", r"^([A-Za-z]+)", 1))
    by = sizes.groupBy("source", F.when(lang != "", lang).alias("language")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    stats = by.groupBy("source").agg(F.sum("t").alias("available"), F.sum("n").alias("texts"), F.max_by("language", F.struct(F.when(F.col("language").isNotNull(), F.col("t")), "language")).alias("language"))
    goals = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = goals.join(stats, "source", "left").select("source", domain_of("source").alias("domain"), F.coalesce("language", F.lit("und")).alias("language"), "available", "target_share", "max_repeats", "texts")
    rows = [tuple(r) for r in known.collect()]  # a row a target
    drawn = budgets([r[:6] for r in rows], total)
    out = [(s, d, v, float(w or 0), int(m or 1), int(t or 0), float(drawn[s]), int(n or 0)) for s, d, v, t, w, m, n in rows]
    return sizes.sparkSession.createDataFrame(out, "source STRING, domain STRING, language STRING, target_share DOUBLE, max_repeats INT, available BIGINT, budget DOUBLE, texts BIGINT")


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, buckets: int | None = None, most: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(drawn, leaves): drawn (doc_id, source, n_tokens, repeats) holds every text of
    the collection, leaves the budgets. There are as many buckets as keep one of the
    largest source below ``most`` texts, so the bucket where a budget ends is a small sort."""
    leaves = source_budgets(sizes, targets, total)
    buckets = buckets or max(1024, (leaves.agg(F.max("texts")).first()[0] or 0) // most)
    wanted = leaves.where("budget > 0 AND available > 0").select("source", F.floor(F.col("budget") / F.col("available")).alias("_passes"), (F.col("budget") % F.col("available")).alias("_rest"))
    rows = sizes.where("n_tokens > 0").join(F.broadcast(wanted), "source")  # a row a target
    order = F.xxhash64(F.lit(seed), "_passes", "doc_id")
    rows = rows.select("doc_id", "source", "n_tokens", "_passes", "_rest", order.alias("_order")).withColumn("_bucket", F.pmod(F.shiftright("_order", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_in"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_bucket", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(sums, ["source", "_bucket"])
    edge = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in") > F.col("_rest"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.where(~edge).withColumn("_last", F.col("_before") + F.col("_in") <= F.col("_rest"))
    cut = placed.where(edge).withColumn("_last", F.col("_before") + F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2 <= F.col("_rest"))
    drawn = whole.unionByName(cut).select("doc_id", "source", "n_tokens", (F.col("_passes") + F.col("_last").cast("int")).cast("int").alias("repeats"))
    return drawn.where("repeats > 0"), leaves


def shares(drawn: DataFrame, leaves: DataFrame) -> DataFrame:
    """(source, domain, language, target_share, actual_share, tokens, texts, repeats,
    max_repeats): what each target reached."""
    leaves = leaves.drop("texts")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("repeats"))
    known = leaves.join(got, "source", "left").fillna(0, ["tokens", "texts", "repeats"])
    all_ = known.agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("_all"))
    # One row on the right.
    known = known.join(F.broadcast(all_), F.lit(True))
    return known.select("source", "domain", "language", "target_share", (F.col("tokens") / F.col("_all")).alias("actual_share"), "tokens", "texts", "repeats", "max_repeats")
