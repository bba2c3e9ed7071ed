"""Mixing sources to target weights by hierarchical budgets; columns and SQL only.

Leaves hang in a domain-language-source tree. A budget of tokens runs down from the root: among siblings it is
shared by weight, no child gets more than its subtree can give over the allowed epochs, and what a child cannot
take goes to its siblings before its parent gives anything back. Each leaf then takes a token prefix of its seeded
epochs, whose order is the md5 of seed, epoch and document. The prefix is found over hash bins summed first; only
the one bin a budget ends in is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
# Hex digits of the hash that name a bin.
BIN_DIGITS = 3
SALTS = 64


def token_count(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\t\\n\\x0B\\f\\r ]+")
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def shared(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Give every node its part of `budget` as `given`: by weight, at most `cap`, shortages to siblings, rounded down.

    Siblings stand in the order of cap over weight. Those whose weighted share of what is left covers their cap are
    full; the others share the rest. Products are decimals, so shares are exact.
    """
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    order = group.orderBy((F.col("cap") / F.col("w")).asc(), F.col(name).asc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = nodes.withColumn("w", weight.cast("long")).withColumns(
        {"rest": F.col("budget") - F.sum("cap").over(upto) + F.col("cap"), "open": F.sum("w").over(onward)}
    )
    ranked = ranked.withColumn("full", F.expr("CAST(cap AS DECIMAL(19,0)) * open <= CAST(rest AS DECIMAL(19,0)) * w"))
    # The first sibling that is not full has the largest rest and the largest open weight of those.
    edge = {c: F.max(F.when(~F.col("full"), F.col(c))).over(group) for c in ("rest", "open")}
    ranked = ranked.withColumns({"edge_rest": edge["rest"], "edge_open": edge["open"]})
    part = F.expr("CAST(w AS DECIMAL(19,0)) * edge_rest div edge_open")
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(part, F.lit(0)))
    return ranked.select(*nodes.columns, given.cast("long").alias("given"))


def budgets(leaves: DataFrame, weights: dict[str, Column], share_percent: int, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, avail) with `given`, from a budget of share_percent of all available tokens."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    parents: list[str] = []
    held = None
    for level in LEVELS:
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail"))
        if parents:
            nodes = nodes.join(held, parents)
        else:
            # The root's children are one row per domain.
            total = F.sum("avail").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("total", total).withColumn("budget", F.expr(f"total * {int(share_percent)} div 100")).drop("total")
        given = shared(nodes, parents, level, weights[level])
        parents = [*parents, level]
        held = given.select(*parents, F.col("given").alias("budget"))
    return given.select(*LEVELS, "avail", "given")


def mixed(docs: DataFrame, domain: Column, weights: dict[str, Column], seed: int, share_percent: int, max_epochs: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, n_taken): the documents each leaf's budget reaches.

    n_taken is below n_tokens only for the document a leaf's budget ends in. A null domain, lang or source is its own node; a
    null text has no tokens; repeated rows are each counted; a leaf without tokens gives nothing; other columns
    are ignored, but for those named in carried, which follow and break ties.
    """
    leaf = list(LEVELS)
    rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", token_count(F.col("text")).alias("n_tokens"), *carried)
    rows = rows.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in leaf), "n_tokens", *carried)
    plan = budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("avail")), weights, share_percent, max_epochs)
    epochs = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    part = F.least(F.greatest(F.col("given") - F.col("epoch") * F.col("avail"), F.lit(0)), F.col("avail"))
    epochs = epochs.withColumn("part", part).where("part > 0")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))
    # A hot leaf's rows are dealt over SALTS keys; the other side is a few rows per leaf.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)))
    epochs = epochs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = salted.join(epochs, [*leaf, "salt"]).drop("salt").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), name)))
    whole = placed.where("part = avail").withColumn("n_taken", F.col("n_tokens"))
    cut = placed.where("part < avail").withColumn("bin", F.substring("h", 1, BIN_DIGITS))
    key = [*leaf, "epoch", "bin"]
    before = F.sum("bin_tokens").over(Window.partitionBy(*leaf, "epoch").orderBy("bin")) - F.col("bin_tokens")
    bins = cut.groupBy(*key).agg(F.sum("n_tokens").alias("bin_tokens")).withColumn("before", before)
    cut = cut.join(bins, key).where("before < part")
    inside = cut.where("before + bin_tokens <= part").withColumn("n_taken", F.col("n_tokens"))
    order = Window.partitionBy(*key).orderBy("h", "doc_id", "n_tokens", *carried).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut.where("before + bin_tokens > part")
    last = last.withColumn("before", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")).where("before < part")
    last = last.withColumn("n_taken", F.least("n_tokens", F.col("part") - F.col("before")))
    columns = ["doc_id", *leaf, "epoch", "n_tokens", "n_taken", *carried]
    return whole.select(columns).unionByName(inside.select(columns)).unionByName(last.select(columns))
