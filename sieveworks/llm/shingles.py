"""Near-duplicates by the Jaccard similarity of word shingles: SimHash keys and MinHash bands propose pairs, the shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import components, saved, sliced

#: A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS: 7.3e-5 at 0.8, 1.8e-6 at 0.85.
BANDS, ROWS = 24, 5
CHUNK = 4096
#: Rounds of one leader a bucket, at most; they end if so few pairs a member are open (0: then all open sets go to the
#: prefix join, as pairs of a bucket grow with the square of its size), or if less than one pair in so many is a link.
STARS, FEW, WORTH = 3, 0, 50
#: Sizes within this factor are one class of the prefix join.
CLASS = 1.05

_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MASKS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included, which are those of simhash.fingerprint; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    last = ends[min(shingle_words, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist(), strict=True)], np.uint64)


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """Sorted distinct shingle_hashes."""
    return np.unique(shingle_hashes(text, shingle_words))


def simhash_of(hashes: np.ndarray) -> int:
    """The signed SimHash of shingle_hashes, as simhash.fingerprint has it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS signed 64-bit keys, each of ROWS MinHash values; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        mixed = (hashes[k : k + CHUNK, None] ^ MASKS) * FACTORS
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    """The signed 64-bit name of a shingle set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64)) if len(hashes) else 0


def _named(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, node, size, fp, bands) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            out = []
            for t in pdf["text"]:
                hashes = shingle_hashes(t, shingle_words)
                own = np.unique(hashes)
                out.append((_node(own), len(own), simhash_of(hashes), bands(own)))
            yield pd.DataFrame(out, columns=["node", "size", "fp", "bands"]).assign(doc_id=pdf["doc_id"].to_numpy())

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, node long, size long, fp long, bands array<long>")


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hashes array<long>) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            sets = [shingle_set(t, shingle_words) for t in pdf["text"]]
            yield pd.DataFrame({"node": [_node(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]})

    return docs.select("text").mapInPandas(run, "node long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `similarity`, counted exactly."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return sized.filter(F.col("n") / (F.col("m") - F.col("n")) >= similarity).select("a", "b")


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(CLASS))).cast("int")


def prefix_pairs(opened: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, size, node2, size2) of different comp: all pairs of `similarity` or more are among them, with few others.

    opened is (node, size, comp), sets (node, hashes). Two sets of sizes a and b are similar if they share at least
    s / (1 + s) * (a + b) hashes. With hashes in one order, rare ones first, two such sets share one among their first
    few, as Chaudhuri et al. ("A Primitive Operator for Similarity Joins", 2006) and Xiao et al. ("Efficient Similarity
    Joins for Near Duplicate Detection", 2008) show. How few depends on both sizes, so a set is dealt once for each
    class of sizes that a partner may have. Edits make hashes that no other set holds: those lead the order and meet
    nobody, so that heavily edited copies of one text drop out without being compared to each other. A hash holds at
    most one row of a set.
    """
    tokens = opened.join(sets, "node").select("node", F.explode("hashes").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = tokens.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))
    size, near = F.col("size"), 1e-6
    smallest, largest = F.greatest(F.floor(size * similarity - near), F.lit(1)), F.ceil(size / similarity + near)
    dealt = opened.join(ordered, "node").withColumn("own", _size_class(size)).withColumn("other", F.explode(F.sequence(_size_class(smallest), _size_class(largest))))
    least = F.ceil(F.pow(F.lit(CLASS), F.col("other")) * (1 - 1e-9))
    wanted = F.ceil((size + least) * (similarity / (1 + similarity)) - near)
    first = (F.size("shared") + 1 - wanted).cast("int")
    met = dealt.filter(first > 0).withColumn("h", F.explode(F.slice("shared", F.lit(1), first)["h"]))
    met = met.select(F.xxhash64(F.least("own", "other"), F.greatest("own", "other"), "h").alias("key"), "node", "size", "comp", "own", "other")
    met = saved(met, "shingle-prefixes")
    return _apart(met.filter("own <= other"), met.filter("own >= other"))


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node, size, node2, size2) of rows (key, comp, node, size) that share a key but not a comp: comps meet first, so that one large comp never meets itself."""
    here, there = left.select("key", "comp").distinct(), right.select("key", F.col("comp").alias("comp2")).distinct()
    other = right.select("key", F.col("node").alias("node2"), F.col("size").alias("size2"), F.col("comp").alias("comp2"))
    pairs = here.join(there, "key").filter("comp != comp2").join(left, ["key", "comp"]).join(other, ["key", "comp2"])
    return pairs.select("node", "size", "node2", "size2")


def simhash_pairs(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, size, node2, size2) that SimHash proposes: of an edge of `near` the first sets of both prints, and of a print the first with each other."""
    lead = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("lead"))
    lead = saved(lead.select("fp", F.col("lead.node").alias("node"), F.col("lead.size").alias("size")), "shingle-prints")
    second = lead.withColumnsRenamed({"node": "node2", "size": "size2"})
    edges = near(lead.select("fp")).join(lead.withColumnRenamed("fp", "a"), "a").join(second.withColumnRenamed("fp", "b"), "b")
    same = nodes.select("fp", "node", "size").join(second, "fp").filter("node != node2")
    return edges.select("node", "size", "node2", "size2").union(same.select("node", "size", "node2", "size2"))


def links(docs: DataFrame, nodes: DataFrame, shingle_words: int, similarity: float, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the distinct sets that have a link: the components of all similar pairs that share a band.

    Pairs that `near` proposes of SimHash fingerprints (if given) are compared in the first round; the bands find what
    differs in more bits. A bucket's members are first compared with one leader each, the one whose other buckets are fullest, then a few
    times with others while that pays; pairs that this already put in one component are not compared. If few pairs
    are left open, all of them are compared; else the open sets meet by prefix_pairs, which loses no similar pair.
    Pairs whose sizes alone rule the similarity out are not compared.
    """
    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    members = saved(keys.join(shared, "key"), "shingle-buckets")
    wanted = members.groupBy("node").agg(F.sum("held").alias("weight"))
    proposed = None
    if near is not None:
        proposed = saved(simhash_pairs(nodes, near), "shingle-simhash")
        linked = proposed.select("node").union(proposed.select(F.col("node2").alias("node"))).distinct()
        wanted = wanted.join(linked, "node", "full").withColumn("weight", F.coalesce("weight", F.lit(0)))
    wanted = saved(wanted, "shingle-wanted")
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first").alias("doc_id"))
    texts = docs.join(ids, "doc_id", "left_semi").select("text").union(docs.filter("doc_id is null").select("text"))
    sets = saved(_sets(texts, shingle_words).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")

    def tried_next(found: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Distinct pairs of (node, size, node2, size2) not tried yet."""
        may = found.filter(F.least("size", "size2") / F.greatest("size", "size2") >= similarity)
        may = may.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct()
        return saved(may if tried is None else may.join(tried, ["a", "b"], "left_anti"), "shingle-pairs")

    rows = members.join(wanted, "node").withColumn("comp", F.col("node"))
    tried = good = groups = None
    for k in range(STARS):
        h = F.struct(F.col("weight") if k == 0 else F.xxhash64("node", F.lit(k)), "node")
        lead = rows.groupBy("key").agg(*(F.max_by(c, h).alias(f"{c}2") for c in ("node", "size", "comp")))
        found = rows.join(lead, "key").filter("comp != comp2").select("node", "size", "node2", "size2")
        pairs = tried_next(proposed.union(found) if k == 0 and proposed is not None else found, tried)
        tried = pairs if tried is None else tried.union(pairs)
        new = saved(_similar(pairs, sets, similarity), "shingle-links")
        good = new if good is None else good.union(new)
        groups = components(good)
        named = groups.select("node", F.col("component").alias("comp"))
        rows = saved(members.join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "shingle-open")
        parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
        left = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("parts")).filter("parts > 1")
        total = left.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2), F.sum("n")).first()
        if not total[0]:
            return groups
        few = total[0] <= FEW * total[1]
        if few or new.count() * WORTH < pairs.count():
            break
    opened = rows.join(left.select("key"), "key", "left_semi")
    found = _apart(opened, opened) if few else prefix_pairs(saved(opened.select("node", "size", "comp").distinct(), "shingle-opened"), sets, similarity)
    new = saved(_similar(tried_next(found, tried), sets, similarity), "shingle-links")
    return groups if new.isEmpty() else components(good.union(new))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id that links of `similarity` or more reach.

    Texts without words are one group. Rows with null doc_id link others and get a component_id like the rest.
    """
    named = saved(_named(docs, shingle_words), "shingles")
    nodes = saved(named.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-nodes")
    groups = links(docs, nodes, shingle_words, similarity, near)
    whole = saved(nodes.select("node", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "shingle-groups")
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.select("doc_id", "node").join(whole.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
