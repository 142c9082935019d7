"""Mixing sources to target weights, with DataFrame functions only.

Sources are leaves of a tree domain - language - source; each node has a weight among its siblings. The token budget
is dealt out from the root: a node's share goes to its children by weight, and no child gets more than its subtree can
give (its tokens times the most epochs). What a child can't take goes to its siblings by weight, and only what a whole
family can't take reaches its parent's siblings: capacities are those of whole subtrees, so this is one closed form
for each level (children in order of capacity over weight fill up first).

A leaf with a budget of T tokens gives T // supply whole epochs and, of one more epoch, the prefix of rows whose
running sum of tokens stays within the rest; an epoch's order is that of md5(seed:epoch:doc_id). Running sums are made
for each leaf and first digits of the digest (two, more from GROUP_ROWS rows a group on) and joined to the sums of
the groups before, so a source that holds a third of all rows is no hot task.

Cases: null domain, language or source count as the value `unknown`; null and empty texts have no tokens and go with
any prefix that is not empty; leaves without weight get none; rows that share an id and a leaf go together; an empty
table gives an empty result; columns of the input other than those named are carried along, and those named like the
result's are replaced.

A leaf's rows are never brought together: budgets reach the rows by a broadcast, up to BROADCAST_LEAVES leaves by
count; beyond that they are copied SALTS times, and rows are joined by leaf and salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

BROADCAST_LEAVES, SALTS, GROUP_ROWS = 200_000, 64, 50_000
WORD = "[^ \\x09-\\x0D]++"


def token_count(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pour(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share `budget` of each family out among its children (weight, capacity): adds `given`."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), name)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumns({"_before": F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), "_rest": F.sum("weight").over(rest)})
    rows = rows.withColumn("_full", F.col("capacity") * F.col("_rest") <= F.col("weight") * (F.col("budget") - F.col("_before")))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(family), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family)
    rows = rows.withColumns({"_left": F.greatest(left, F.lit(0.0)), "_open": open_weight})
    given = F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("weight") * F.col("_left") / F.col("_open"))
    return rows.withColumn("given", given).drop("_before", "_rest", "_full", "_left", "_open")


def leaf_budgets(supply: DataFrame, weights: DataFrame, levels: Sequence[str], share: float, most_epochs: int) -> DataFrame:
    """supply: levels and tokens; weights: levels and w_<level> for each. Gives levels, tokens and budget (whole tokens)."""
    leaves = supply.join(weights, list(levels)).filter(" and ".join(f"w_{c} > 0" for c in levels))
    leaves = leaves.withColumn("capacity", (F.col("tokens") * most_epochs).cast("double"))
    total = supply.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("double").alias("budget"))
    above: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        own, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.max(f"w_{levels[depth - 1]}").cast("double").alias("weight"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(total))
        above = _pour(nodes, parent, levels[depth - 1]).select(*own, F.col("given").alias("budget"))
    out = above.join(leaves.select(*levels, "tokens"), list(levels))
    return out.select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _with_leaf(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with a table of one row for each leaf, without dealing rows by leaf."""
    if small.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(small), list(keys))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    return salted.join(small.select("*", salts), [*keys, "_salt"]).drop("_salt")


def mix_sources(docs: DataFrame, weights: DataFrame, levels: Sequence[str] = ("domain", "lang", "source"), share: float = 0.6, most_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows of docs with n_tokens and copies (how often the mix has the row).

    weights has levels and w_<level> columns, the weight of each node among its siblings; share is the mix's size in
    tokens over all tokens of docs.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "copies")]
    leaf = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in levels}
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    counted = docs.select(*carried, F.col(id_col).alias("_id"), *(e.alias(c) for c, e in leaf.items()), token_count(F.col(text_col)).alias("n_tokens"))
    slim = counted.groupBy("_id", *leaf).agg(F.sum("n_tokens").alias("size"))
    slim = cut(slim.withColumnsRenamed(dict(zip(leaf, levels, strict=True))), "tokens")
    budgets = leaf_budgets(slim.groupBy(*levels).agg(F.sum("size").alias("tokens")), weights, levels, share, most_epochs).filter("budget > 0 and tokens > 0")
    budgets = budgets.select(*levels, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"))

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    size = slim.count()
    digits = next(d for d in range(2, 17) if size <= GROUP_ROWS * 16**d)
    rows = _with_leaf(slim, cut(budgets, "budgets"), levels).withColumn("digest", digest).withColumn("part", F.substring("digest", 1, digits))
    parts = rows.groupBy(*levels, "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*levels, "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*levels, "part").orderBy("digest", "_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("start") + F.sum("size").over(inside)
    picked = rows.join(parts, [*levels, "part"]).withColumn("more", ((reach <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
    picked = picked.select("_id", *levels, (F.col("whole") + F.col("more")).cast("int").alias("copies")).filter("copies > 0")
    picked = picked.withColumnsRenamed({c: f"_{c}" for c in levels})
    out = counted.alias("d").join(picked.alias("p"), F.expr(" and ".join(f"d.{c} <=> p.{c}" for c in ("_id", *leaf))))
    return out.select(*(F.col(f"d.c{i}").alias(c) for i, c in enumerate(names)), "n_tokens", "copies")
