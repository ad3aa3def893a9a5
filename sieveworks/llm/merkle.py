"""A Merkle manifest of a table: trees built bottom-up level by level, proofs pushed top-down from parents to children."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sieveworks.llm.common import saved

#: Children of a node.
FANOUT = 8
#: Columns that a leaf is the digest of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OWN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the values as leaf()'s input."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with ``idx``, their place from 0 in the order of their group, and ``n``, the group's size.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks; positions inside a range
    are saved with the rows, and only a row for each range and group goes through the prefix sums. rows must be
    deterministic, as they are read more than once. Nulls come first and are a group like any other.
    """
    keys = [*group, *order]
    at = F.monotonically_increasing_id()  # consecutive within a partition
    ranged = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), at.alias("at")), name)
    cells = ranged.groupBy("part", *group).agg(F.min("at").alias("low"), F.count("*").alias("size"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).withColumn("n", F.sum("size").over(whole))
    on = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("part", *group)))
    return ranged.alias("r").join(cells.alias("c"), on).select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("r.at") + F.col("c.first")).alias("idx"), F.col("c.n").alias("n"))


def levels(nodes: DataFrame, fanout: int = FANOUT, name: str = "merkle") -> list[DataFrame]:
    """The forest's levels above nodes (tree, idx, n, digest), each saved: (tree, idx, n, digest, kids), kids in order.

    Every run of fanout consecutive nodes of a tree becomes the digest of their concatenation; the last run may be
    shorter. A tree of one node stays as it is and has no row further up. The tree with the most nodes bounds how
    many levels there are: one more for each factor of fanout.
    """
    found = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    level = nodes
    while most > 1:
        runs = level.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = runs.agg(F.max(F.ceil(F.col("n") / fanout)).alias("n"), kids.alias("kids"))
        level = saved(up.select("tree", "idx", "n", F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids"), f"{name}-{len(found) + 1}")
        found.append(level)
        most = -(-most // fanout)
    return found


def _pushed(parents: DataFrame, level: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, steps, ...) of the kids of parents: each prepends its siblings to what its parent inherited."""
    met = parents.join(level.select("tree", "idx", "kids"), ["tree", "idx"])
    rest = [c for c in parents.columns if c not in ("tree", "idx", "steps")]
    each = met.select("tree", (F.col("idx") * fanout).alias("low"), "steps", "kids", *rest, F.posexplode("kids").alias("k", "own"))
    return each.select("tree", (F.col("low") + F.col("k")).alias("idx"), _prepended(F.col("kids"), F.col("k"), F.col("steps")).alias("steps"), *rest)


def _prepended(kids: Column, k: Column, steps: Column) -> Column:
    """steps after the siblings of the kid at k."""
    left = F.array_join(F.slice(kids, F.lit(1), k), "")
    right = F.array_join(F.slice(kids, k + 2, F.size(kids)), "")
    return F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), steps)


def proofs(roots: DataFrame, above: list[DataFrame], least: int, fanout: int = FANOUT, name: str = "merkle") -> DataFrame:
    """(tree, idx, steps, ...) of the nodes of level least, 0 the forest's lowest; steps hold what stands left and right of
    the path's node, level by level.

    roots: (tree, steps, ...), what each tree's root inherits; above: levels(). A root joins at its own level. Each
    level is saved, so a lost executor costs one level at most.
    """
    out = None
    for k in range(len(above), least - 1, -1):
        if k:
            own = above[k - 1].filter("n = 1").select("tree", "idx").join(roots, "tree")
            out = own if out is None else out.unionByName(own)
        if k > least:
            out = saved(_pushed(out, above[k - 1], fanout), f"{name}-proofs-{k - 1}")
    return out


def folded(steps: Column, leaf: Column) -> Column:
    """The root that a proof's steps make of a leaf."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered(text: Column, doc_id: Column) -> Column:
    """Of ids whose decimal's CRC-32 3 divides, the text in lower case (A-Z alone); the others' as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def manifest(docs: DataFrame, tree: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Each row of docs with its leaf, its tree's ``subroot``, the ``root``, its proof, and a check of a later state.

    A leaf is the SHA-256 of its fields, null-marked and length-prefixed. The leaves of each value of column tree, in
    the order of key, make one tree; the subroots, ordered by that value (null first, by UTF-8 bytes), make the upper
    one. ``changed``: the column that the last field holds when the table is checked; its leaf is folded with the
    original siblings to ``folded_root``, and ``verified`` tells whether that is the root. ``proof_sha256`` is the digest of
    all siblings, upwards, left to right.

    Work: one pass over the texts makes the leaves; from there on only digests move. Leaves are ranked by ranges, so a
    tree with most rows spreads over tasks. Nodes meet in groups of fanout keyed by (tree, place). Proofs are pushed
    down the saved levels by joins of children to parents; the last step, from the lowest nodes to their leaves, is
    made where the leaves of a run stand together, so that whole proofs of leaves are never shuffled. The root alone
    passes through the driver.

    Null key: before all others of its tree; never changed. Null tree: a tree of its own. Equal keys: ordered by leaf;
    rows equal in key and leaf take places next to each other, in any order, with equal digests but proofs of their
    own. Null or empty text: ``-`` or ``0:``. A tree of one leaf: the leaf is the subroot; a single tree: its subroot is the
    root. Empty table: no rows. Other columns but the last field are kept, whatever their names; those of
    OWN are replaced.
    """
    last = fields[-1]
    later = [F.col(f"`{c}`") for c in fields[:-1]] + [F.col(f"`{last}`") if changed is None else changed]
    keep = [c for c in docs.columns if c not in OWN and c not in (key, tree, last)]
    # ties of key and leaf are split by where the row was read, so that many repeated rows don't meet in one range
    tie = F.xxhash64(F.monotonically_increasing_id())
    rest = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in keep))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{tree}`").alias("value"), digest([F.col(f"`{c}`") for c in fields]).alias("digest"), digest(later).alias("later"), rest.alias("rest"), tie.alias("tie"))
    rows = saved(rows, "merkle-leaves")

    places = placed(rows.select("value", F.lit(0).alias("all")).distinct(), ["all"], ["value"], "merkle-tree-ranges")
    places = saved(places.select("value", F.col("idx").alias("tree"), F.col("n").alias("trees")), "merkle-trees")
    rows = rows.alias("r").join(places.alias("p"), F.col("r.value").eqNullSafe(F.col("p.value"))).select("r.*", "p.tree")
    leaves = saved(placed(rows, ["tree"], ["key", "digest", "tie"], "merkle-ranges").drop("tie"), "merkle-level-0")

    below = levels(leaves.select("tree", "idx", "n", "digest"), fanout, "merkle-level")
    tops = reduce(DataFrame.unionByName, (x.filter("n = 1").select("tree", "digest") for x in [leaves, *below]))
    tops = saved(tops.join(places.select("tree", "trees"), "tree").select(F.lit(0).alias("all"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest"), "merkle-subroots")
    forest = tops.select(F.col("all").alias("tree"), "idx", "n", "digest")
    upper = levels(forest, fanout, "merkle-upper")
    top = (upper[-1] if upper else forest).filter("n = 1").select("digest").first()
    root = F.lit(top[0] if top else None).cast("string")
    none = F.filter(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), lambda _: F.lit(False))
    start = forest.select("tree").distinct().select("tree", none.alias("steps"))
    # what each tree's root inherits from the upper tree
    paths = proofs(start, upper, 0, fanout, "merkle-upper") if upper else forest.select("tree", "idx", none.alias("steps"))
    roots = saved(paths.select(F.col("idx").alias("tree"), "steps").join(tops.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot")), "tree"), "merkle-roots")

    alone = leaves.filter("n = 1").join(roots, "tree")
    out = alone.select("key", "value", "rest", "later", F.col("digest").alias("leaf"), "subroot", "steps")
    if below:
        kid = F.struct("idx", "digest", "later", "key", "value", "rest")
        runs = leaves.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.array_sort(F.collect_list(kid), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("run"))
        met = proofs(roots, below, 1, fanout, "merkle").join(runs, ["tree", "idx"])
        each = met.select("steps", "subroot", F.transform("run", lambda x: x["digest"]).alias("kids"), F.posexplode("run").alias("k", "x"))
        each = each.select("x.key", "x.value", "x.rest", "x.later", F.col("x.digest").alias("leaf"), "subroot", _prepended(F.col("kids"), F.col("k"), F.col("steps")).alias("steps"))
        out = each.unionByName(out)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("*", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("steps"), F.col("later")).alias("folded_root"))
    kept = [F.col("rest").getField(c).alias(c) for c in keep]
    return out.select(F.col("key").alias(key), F.col("value").alias(tree), *kept, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
