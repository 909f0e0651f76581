"""Mixing sources to target weights: hierarchical token budgets, with DataFrame operations only.

The tree is domain > language > source. A node's budget goes to its children in proportion to their weights; a child
that can't use its share (its rows times the epochs allowed) is filled up, and what is left over goes to its siblings
by weight. Only what a whole subtree can't use reaches the level above, since a node never gets more than its subtree
holds. Each leaf then gives whole epochs of its rows and, of the last epoch, the longest prefix in seeded order that
stays within the budget.

A budget is one closed form per level (siblings sorted by capacity over weight, running sums), over one row per leaf.
The cut in the last epoch is found in two steps: token sums for ranges of the order hash, whose number follows the number of
rows, then an exact running sum inside the one range where the budget ends, over one row for each hash. Texts are never shuffled.

Defined results: a null language or source is a node of its own; a null text has no tokens; rows with one id share
their place in the order; leaves without tokens give nothing; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import fresh, settle, stratum, words

#: Rows for a range of the order hash, about, and the least ranges, as a power of two.
RANGE_ROWS, LEAST_BITS = 1 << 18, 8
LEAF = ["_d", "_l", "_s"]


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers; siblings' weights are relative), the token budget as a share of all tokens, and the most epochs."""

    domains: tuple[tuple[str, str, int], ...]  # name, pattern on the source, weight; the first match counts
    other_domain: tuple[str, int]
    languages: dict[str, int]
    other_language: int
    sources: dict[str, int] = field(default_factory=dict)
    other_source: int = 10
    share: float = 0.75
    epochs: int = 4
    seed: int = 11


def _case(value: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in table.items():
        out = F.when(value == k, w).otherwise(out)
    return out.cast("long")


def domain_of(source: Column, mix: Mix) -> Column:
    out = F.lit(mix.other_domain[0])
    for name, pattern, _ in reversed(mix.domains):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """A number of 60 bits that shuffles keys anew in each epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _pour(nodes: DataFrame, group: list[str], name: str, weight: Column) -> DataFrame:
    """Share the column budget among the siblings in each group: at most cap each, else by weight. Gives the column given."""
    nodes = nodes.withColumn("w", weight).filter((F.col("w") > 0) & (F.col("cap") > 0))
    ordered = W.partitionBy(*group).orderBy(F.col("cap") / F.col("w"), name)
    before = F.sum("cap").over(ordered) - F.col("cap")
    from_here = F.sum("w").over(W.partitionBy(*group)) - F.sum("w").over(ordered) + F.col("w")
    nodes = nodes.withColumn("level", (F.col("budget") - before) / from_here).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy(*group))
    return nodes.withColumn("given", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).drop("w", "level", "full")


def quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: _d, _l, _s, tokens. One row per leaf with its quota (long), whole epochs and the rest."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    langs = leaves.groupBy("_d", "_l").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("_d").agg(F.sum("cap").alias("cap"))
    total = F.expr(f"sum(cap) over () div {mix.epochs}") * F.lit(mix.share)
    domain_weights = {name: w for name, _, w in mix.domains}
    by_domain = _pour(domains.withColumn("budget", total).withColumn("_root", F.lit(0)), ["_root"], "_d", _case(F.col("_d"), domain_weights, mix.other_domain[1]))
    by_lang = _pour(langs.join(by_domain.select("_d", F.col("given").alias("budget")), "_d"), ["_d"], "_l", _case(F.col("_l"), {f"={k}": w for k, w in mix.languages.items()}, mix.other_language))
    by_leaf = _pour(leaves.join(by_lang.select("_d", "_l", F.col("given").alias("budget")), ["_d", "_l"]), ["_d", "_l"], "_s", _case(F.col("_s"), {f"={k}": w for k, w in mix.sources.items()}, mix.other_source))
    quota = F.floor("given").cast("long")
    return by_leaf.select(*LEAF, "tokens", quota.alias("quota")).withColumn("full", F.expr("quota div tokens")).withColumn("rest", F.expr("quota - full * tokens"))


def _keys(df: DataFrame, mix: Mix, source: str, lang: str) -> DataFrame:
    return df.withColumn("_d", domain_of(F.col(source), mix)).withColumn("_l", stratum(F.col(lang))).withColumn("_s", stratum(F.col(source)))


def plan(df: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (_k, _d, _l, _s, _t tokens) and the leaves with quota, full and cut: a row is in epoch `full` if its hash is at most cut."""
    rows = _keys(df.select(F.col(key).alias("_k"), F.col(text).alias("_x"), F.col(lang).alias("_lang"), F.col(source).alias("_src")), mix, "_src", "_lang")
    rows = settle(rows.select("_k", *LEAF, F.size(words(F.col("_x"))).cast("long").alias("_t")), "mix-rows")
    leaves = settle(quotas(rows.groupBy(*LEAF).agg(F.sum("_t").alias("tokens")), mix), "mix-quotas")

    placed = rows.join(leaves, LEAF).withColumn("_h", order_hash(mix.seed, F.col("full"), F.col("_k")))
    low = 60 - max(LEAST_BITS, (rows.count() // range_rows).bit_length())
    placed = placed.withColumn("_b", F.shiftright("_h", low))
    sums = placed.groupBy(*LEAF, "_b").agg(F.sum("_t").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("n").over(W.partitionBy(*LEAF).orderBy("_b")) - F.col("n"))
    ends = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select(*LEAF, "_b", "before")
    ends = settle(ends, "mix-ends")
    inside = placed.join(ends, [*LEAF, "_b"]).groupBy(*LEAF, "_b", "_h").agg(F.sum("_t").alias("_t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("_t").over(W.partitionBy(*LEAF, "_b").orderBy("_h")))
    cuts = inside.groupBy(*LEAF).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("_h"))).alias("cut"))
    floor = ends.select(*LEAF, (F.shiftleft("_b", low) - 1).alias("floor"))
    cut = floor.join(cuts, LEAF, "left").select(*LEAF, F.coalesce("cut", "floor").alias("cut"))
    return rows, settle(leaves.join(cut, LEAF).select(*LEAF, "quota", "full", "cut"), "mix-cuts")


def _copies(df: DataFrame, leaves: DataFrame, mix: Mix, key: str, epoch: str) -> DataFrame:
    """One row for each epoch that a row is in; leaves is small and read from files, so Spark broadcasts it only if its size allows."""
    joined = df.join(leaves, LEAF)
    n = F.col("full") + F.when(order_hash(mix.seed, F.col("full"), F.col(key)) <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn(epoch, F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))))


def select_rows(df: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df's own columns, a row for each epoch that it is in."""
    _, leaves = plan(df, mix, key, text, lang, source)
    names = df.columns
    inner = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    out = _copies(_keys(inner, mix, at[source], at[lang]), leaves, mix, at[key], "_epoch")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def drawn(df: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, domain, lang, source, tokens, epoch and the leaf's quota for each row drawn."""
    rows, leaves = plan(df, mix, key, text, lang, source)
    out = _copies(rows, leaves, mix, "_k", "epoch")
    plain = lambda c: F.when(F.col(c) != "", F.expr(f"substring({c}, 2)"))
    return out.select(F.col("_k").alias(key), F.col("_d").alias("domain"), plain("_l").alias(lang), plain("_s").alias(source), F.col("_t").alias("tokens"), "epoch", "quota")
