"""Mixing sources to target weights by hierarchical budgets.

The columns of `levels` (for example domain, language, source) form a tree.
A token budget goes from the root to the leaves in proportion to the nodes'
weights.  No node gets more than its capacity (its tokens times the number of
epochs allowed); what a node can't take goes to its siblings first, and only
what the siblings can't take goes to the siblings of their parent, because a
parent's capacity is the sum of its children's.  Each leaf then fills its
budget with whole epochs and a prefix of one more epoch, whose order is a
seeded hash.

Everything is integer arithmetic in DataFrame operations.  A leaf with a third
of all rows is ranked in buckets of its hash order: sums of buckets locate the
one bucket in which the prefix ends, and only that is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import counted, materialize

#: Rows of a bucket of a leaf's hash order, on average.
BUCKET_ROWS = 2000
#: Buckets of the children of a node for each doubling of capacity per weight.
BUCKETS_A_DOUBLING = 16

WORD = r"[^\x20\x09-\x0D]+"


def _weight(column: str, weights: dict[str, int]) -> Column:
    given = F.lit(1)
    for value, w in weights.items():
        given = F.when(F.col(column) == value, F.lit(int(w))).otherwise(given)
    return given.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` over its children (`name`, w, cap): `share`.

    Children are met in the order of capacity per weight; the first that the
    remaining budget doesn't saturate fixes the level for it and all later.
    A parent may have millions of children (hosts), so their running sums are
    taken within buckets of like ratio, on top of the sums of the buckets.
    """
    nodes = nodes.withColumn("root", F.lit(0))
    keys = [*parent, "root"]
    ratio = F.try_divide(F.col("cap").cast("double"), F.col("w").cast("double"))
    bucket = F.when(F.col("w") == 0, 1 << 20).when(F.col("cap") == 0, -(1 << 20)).otherwise(F.floor(F.log2(ratio) * BUCKETS_A_DOUBLING))
    nodes = nodes.withColumn("bucket", bucket.cast("int"))
    sums = nodes.groupBy(*keys, "bucket").agg(F.sum("cap").alias("bucket_cap"), F.sum("w").alias("bucket_w"))
    of_parent = Window.partitionBy(*keys).orderBy("bucket")
    sums = sums.withColumn("cap_before", F.coalesce(F.sum("bucket_cap").over(of_parent.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("w_behind", F.coalesce(F.sum("bucket_w").over(of_parent.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    nodes = nodes.join(sums.drop("bucket_cap", "bucket_w"), [*keys, "bucket"])

    order = Window.partitionBy(*keys, "bucket").orderBy(ratio, F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    nodes = nodes.withColumn("taken", F.col("cap_before") + F.coalesce(F.sum("cap").over(before), F.lit(0)))
    nodes = nodes.withColumn("ahead", F.col("w_behind") + F.sum("w").over(onward))
    full = (F.col("w") > 0) & (wide("cap") * wide("ahead") <= wide("w") * (F.col("budget") - F.col("taken")).cast("decimal(18,0)"))
    nodes = nodes.withColumn("full", full)
    level = nodes.groupBy(*keys).agg(
        (F.max("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0))).alias("rest"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).alias("open")
    )
    nodes = nodes.join(level, keys)
    part = F.expr("CASE WHEN w = 0 OR open = 0 THEN 0 ELSE (CAST(w AS DECIMAL(18,0)) * CAST(rest AS DECIMAL(18,0))) DIV CAST(open AS DECIMAL(18,0)) END")
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], target: int, max_epochs: int) -> DataFrame:
    """`levels`, tokens, rows_, share: what each leaf of the tree may take.

    `leaves` has `levels`, tokens and rows_, one row for each leaf.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    above = None
    for depth, name in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*levels[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights.get(name, {})))
        nodes = nodes.join(above, parent) if above is not None else nodes.withColumn("budget", F.lit(int(target)).cast("long"))
        filled = _fill(materialize(nodes, "nodes"), parent, name)
        above = materialize(filled.select(*levels[: depth + 1], F.col("share").alias("budget")), "budgets")
    return leaves.join(above.withColumnRenamed("budget", "share"), levels).drop("cap")


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]] | None = None,
    target_tokens: int | None = None,
    target_share: tuple[int, int] = (8, 10),
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row of `docs` with mix_tokens and mix_copies, its number of copies.

    With `keep` only those columns and the levels are returned; they are then
    written with the token counts, and texts are read once.

    `levels` names the tree's levels, from the root, with their columns; a null
    counts as ''.  `weights` gives nodes of a level other weights than 1; a
    node of weight 0 gets nothing.  The target is `target_tokens`, or
    target_share of all tokens; a target beyond all capacity is cut to it.

    A row's tokens are the words of its whole text (null: none).  A leaf's
    prefix takes the rows in the order of md5(seed:epoch:id) as long as their
    tokens fit the rest of its budget; rows with one id stand together.  A row
    with a null id counts as id ''.  An empty table gives an empty result.
    Columns of `docs` that begin with mix_ are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.startswith("mix_")))
    names = [f"mix_{name}" for name in levels]
    weights = {f"mix_{k}": v for k, v in (weights or {}).items()}
    marked = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values())})
    marked = marked.withColumn("mix_tokens", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    rows = materialize(marked.select(*names, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("mix_id"), "mix_tokens", kept.alias("mix_kept")), "tokens")
    leaves = materialize(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows_")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    target = min(total * max_epochs, target_tokens if target_tokens is not None else total * target_share[0] // target_share[1])
    shares = leaf_budgets(leaves, names, weights, target, max_epochs)
    shares = shares.withColumn("epochs", F.expr("CASE WHEN tokens = 0 THEN 0 ELSE share DIV tokens END").cast("long"))
    shares = shares.withColumn("left_", F.when(F.col("tokens") > 0, F.col("share") % F.col("tokens")).otherwise(0).cast("long"))
    shares = shares.withColumn("buckets", F.ceil(F.col("rows_") / BUCKET_ROWS).cast("long"))
    shares = counted(materialize(shares, "shares"))  # a row for each leaf: documents meet them unshuffled

    place = lambda epoch, i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), i))
    placed = rows.join(shares, names).withColumn("at", place("epochs", F.col("mix_id")))
    bucket = F.expr("CAST(conv(substr(at, 1, 7), 16, 10) AS BIGINT) * buckets DIV 268435456")
    placed = placed.select(*names, "at", bucket.alias("bucket"), "mix_tokens", "left_")
    sums = placed.groupBy(*names, "bucket").agg(F.sum("mix_tokens").alias("held"), F.max("at").alias("top"), F.first("left_").alias("left_"))
    so_far = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("held").over(so_far))
    inside = sums.where("upto <= left_").groupBy(*names).agg(F.max("top").alias("cut"))
    border = sums.where("upto > left_ and upto - held <= left_").select(*names, "bucket", (F.col("upto") - F.col("held")).alias("ahead"))
    within = Window.partitionBy(*names, "bucket").orderBy("at")  # ties stand together
    border = placed.join(border, [*names, "bucket"]).withColumn("upto", F.col("ahead") + F.sum("mix_tokens").over(within))
    border = border.where("upto <= left_").groupBy(*names).agg(F.max("at").alias("cut"))
    cuts = inside.unionByName(border).groupBy(*names).agg(F.max("cut").alias("cut"))
    cuts = shares.join(cuts, names, "left").select(*names, F.col("epochs").alias("mix_epochs"), F.col("left_").alias("mix_left"), F.col("cut").alias("mix_cut"))

    if keep:
        marked, id_col = rows.select(*(F.col("mix_kept")[c].alias(c) for c in keep), *names, "mix_tokens", "mix_id"), "mix_id"
    chosen = marked.join(counted(materialize(cuts, "cuts")), names, "left")
    last = (place("mix_epochs", F.coalesce(F.col(id_col).cast("string"), F.lit(""))) <= F.col("mix_cut")) & (F.col("mix_left") > 0)
    copies = F.col("mix_epochs") + F.when(last, 1).otherwise(0)
    return chosen.withColumn("mix_copies", copies.cast("long")).drop("mix_epochs", "mix_left", "mix_cut", "mix_id")


def documents_tree(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    """The levels of the `documents` table: the domain is the source's number modulo 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    domain = F.when(number == "", F.lit("domain-")).otherwise(F.concat(F.lit("domain"), (number.try_cast("int") % 4).cast("string")))
    return {"domain": domain, "lang": F.col(lang), "source": F.col(source)}


#: Weights of the registered query and of the pipeline.
DOCUMENTS_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2, "domain2": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
