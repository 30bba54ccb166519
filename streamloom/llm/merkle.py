"""A manifest of a table as Merkle trees: a tree of leaves for each source, a tree of the sources' roots above them.

Leaves are numbered in each source by doc_id. Builders take aligned runs of FAN^LEVELS leaves and write a segment of the
log: every node right after the last of what it covers, in the order in which nodes are complete. Where a node stands
follows from its level, its number and the number of leaves alone (position), as subtree sizes say how many nodes are
complete before it; so siblings are read from a segment by address. A segment's last node is a leaf of the next round,
until a tree has one segment; the sources' roots then go the same way. Proofs come back from the top: a segment gets the
path above it and gives each of its leaves its own.

Every segment is a group of its own of FAN^LEVELS leaves at most: a source of any size is cut into many. The driver sees
the number of rounds only.

Defined cases: a null column is '-' in its leaf, so unlike any value; a null id comes first; equal ids follow each other
in the order of their leaves' hashes; equal rows have equal leaves, which are leaves of their own; a null source is a
source of its own, the first; an empty table has no leaves, no root and gives an empty result; other columns are not part
of a leaf and not carried along.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FAN = 16
#: Levels of a segment above its leaves, of which it has FAN^LEVELS.
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it stands in a leaf: its length in bytes and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row, where wanted with other values in some of its columns."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    out = 0
    while FAN**out < n:
        out += 1
    return out


def position(level: int, number: int, n: int, top: int) -> int:
    """Nodes that are complete before this one, in a tree of n leaves and top levels above them.

    The node covers the leaves before end. Complete by then are all nodes of its level and below that begin before end;
    of those above, the ones that end earlier, as one that ends there itself is complete later.
    """
    end = min((number + 1) * FAN**level, n)
    below = sum(-(-end // FAN**k) for k in range(level + 1))
    return below + sum((end - 1) // FAN**k for k in range(level + 1, top + 1)) - 1


def build_segment(leaves: list[str], top: int) -> list[str]:
    """All nodes over the leaves up to level top, in the order in which they are complete."""
    out: list[str] = []
    open_: list[list[str]] = [[] for _ in range(top + 1)]

    def close(level: int, node: str, last: bool) -> None:
        """Write a node and hand it on; last: nothing comes after it."""
        out.append(node)
        if level < top:
            open_[level].append(node)
            if len(open_[level]) == FAN or last:
                run = open_[level]
                open_[level] = []
                close(level + 1, digest(*run), last)

    for i, x in enumerate(leaves):
        close(0, x, i + 1 == len(leaves))
    return out


def levels_of(nodes: list[str], n: int, top: int) -> list[list[str]]:
    """A segment's nodes by level, each read from its address."""
    return [[nodes[position(level, k, n, top)] for k in range(-(-n // FAN**level))] for level in range(top + 1)]


def siblings(by_level: list[list[str]], leaf: int) -> list[tuple[str, str]]:
    """What a leaf's nodes are joined to on their way up, a pair a level: the run's nodes before and after."""
    out = []
    for level in by_level[:-1]:
        first = leaf - leaf % FAN
        run = level[first : first + FAN]
        out.append(("".join(run[: leaf - first]), "".join(run[leaf - first + 1 :])))
        leaf //= FAN
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path make."""
    for before, after in path:
        leaf = digest(before, leaf, after)
    return leaf


def numbered(leaves: DataFrame, tag: str) -> DataFrame:
    """leaves (tree, order, hash, ...) with number, from 0 in their tree in the order of (order, hash), and n, the tree's leaves.

    Rows are sorted in ranges, whose sizes by tree are summed to the numbers they begin with: no tree is one task's.
    """
    ordered = leaves.repartitionByRange("tree", F.asc_nulls_first("order"), "hash").sortWithinPartitions("tree", F.asc_nulls_first("order"), "hash")
    # the number of the partition and of the row in it, fixed by being written
    written = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), f"{tag}-sorted")
    parts = written.groupBy("tree", "_range").agg(F.count("*").alias("k"), F.min("_at").alias("_first"))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(parts.select("tree", "_range", "_first", before.alias("_before"), F.sum("k").over(of_tree).alias("n")), f"{tag}-ranges")
    joined = written.join(starts, ["tree", "_range"])
    return joined.withColumn("number", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_first", "_before")


def segment_of(levels: int) -> Column:
    return F.floor(F.col("number") / FAN**levels)


def segments(leaves: DataFrame, tag: str, levels: int = LEVELS) -> DataFrame:
    """The log (tree, segment, n, top, nodes) over numbered leaves: a row a segment, its nodes in order of completion. n is the segment's own number of leaves."""

    def run(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("number")
        top = height(len(of)) if of["n"].iloc[0] <= FAN**levels else levels
        one = {"tree": of["tree"].iloc[0], "segment": of["segment"].iloc[0], "n": len(of), "top": top, "nodes": build_segment(of["hash"].tolist(), top)}
        return pd.DataFrame([one])

    of_segment = leaves.select("tree", segment_of(levels).alias("segment"), "number", "n", "hash").groupBy("tree", "segment")
    return materialise(of_segment.applyInPandas(run, "tree string, segment long, n int, top int, nodes array<string>"), f"{tag}-log")


def build(leaves: DataFrame, tag: str, levels: int = LEVELS) -> list[DataFrame]:
    """The logs of all rounds over numbered leaves, lowest first; each tree ends in one segment of the last round it is in."""
    logs = [segments(leaves, tag, levels)]
    while logs[-1].agg(F.max("segment")).first()[0]:
        sizes = logs[-1].groupBy("tree").agg(F.count("*").alias("n")).where("n > 1")
        heads = logs[-1].select("tree", F.col("segment").alias("number"), F.element_at("nodes", -1).alias("hash")).join(sizes, "tree")
        logs.append(segments(heads, tag, levels))
    return logs


def roots(logs: list[DataFrame]) -> DataFrame:
    """(tree, root): the last node of each tree's last round."""
    done = [log.join(log.where("segment > 0").select("tree").distinct(), "tree", "left_anti") for log in logs]
    out = done[0]
    for log in done[1:]:
        out = out.unionByName(log)
    return out.select("tree", F.element_at("nodes", -1).alias("root"))


PATH = "array<struct<before:string,after:string>>"


def _paths(log: DataFrame, above: DataFrame, tag: str, levels: int) -> DataFrame:
    """(tree, segment, path) for what each leaf of a log's segments stands for, the segments of the round below; above: (tree, segment, path) of the log's own."""

    def run(of: pd.DataFrame) -> pd.DataFrame:
        one = of.iloc[0]
        upper = [(p["before"], p["after"]) for p in one["path"]]
        by_level = levels_of(one["nodes"], int(one["n"]), int(one["top"]))
        paths = [[*siblings(by_level, k), *upper] for k in range(int(one["n"]))]
        return pd.DataFrame({"tree": one["tree"], "segment": int(one["segment"]) * FAN**levels + pd.RangeIndex(int(one["n"])), "path": [[{"before": a, "after": b} for a, b in p] for p in paths]})

    return materialise(log.join(above, ["tree", "segment"]).groupBy("tree", "segment").applyInPandas(run, f"tree string, segment long, path {PATH}"), f"{tag}-paths")


def paths_to_segments(logs: list[DataFrame], above: DataFrame, tag: str, levels: int) -> DataFrame:
    """(tree, segment, path) of the lowest log's segments, up to the end of above (tree, path), which continues each tree's root."""
    top = above.withColumn("segment", F.lit(0).cast("long"))
    out = None
    for k in range(len(logs) - 1, -1, -1):
        # trees that end in this round start here; those of later rounds come down to it
        ends = logs[k].groupBy("tree").agg(F.count("*").alias("_n")).where("_n = 1").select("tree")
        own = top.join(ends, "tree").select("tree", "segment", "path")
        out = own if out is None else out.unionByName(own)
        if k:
            out = _paths(logs[k], out, tag, levels)
    return out


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, order, hash, doc_id, changed): each row's leaf; changed is its leaf with lower-case letters where the row is tampered with."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf_hash(text=F.translate("text", letters, letters.lower())))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("order"), leaf_hash().alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), changed.alias("changed"))


class Manifest:
    """Numbered leaves, the logs of their trees and of the tree of sources, and the root (null over no leaves)."""

    def __init__(self, docs: DataFrame, levels: int = LEVELS):
        self.levels = levels
        self.leaves = materialise(numbered(leaves_of(docs), "merkle-leaves"), "merkle-leaves")
        self.logs = build(self.leaves, "merkle", levels)
        self.subroots = materialise(roots(self.logs), "merkle-roots")
        tops = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("order"), F.col("root").alias("hash"))
        self.tops = materialise(numbered(tops, "merkle-tops"), "merkle-tops")
        self.top_logs = build(self.tops, "merkle-top", levels)
        last = roots(self.top_logs).first()
        self.root: str | None = last["root"] if last else None

    def paths(self) -> DataFrame:
        """(tree, segment, subroot, path) of every segment of leaves, up to the root."""
        spark = self.leaves.sparkSession
        start = spark.createDataFrame([("", [])], f"tree string, path {PATH}")
        of_tops = proofs(self.tops.withColumn("segment", segment_of(self.levels)), self.top_logs[0], paths_to_segments(self.top_logs, start, "merkle-top", self.levels), self.levels)
        above = materialise(of_tops.select(F.col("order").alias("tree"), "path"), "merkle-above")
        return paths_to_segments(self.logs, above, "merkle", self.levels).join(self.subroots.withColumnRenamed("root", "subroot"), "tree")

    def proofs(self) -> DataFrame:
        """(tree, number, doc_id, hash, path): every leaf with the path that proves it."""
        own = self.leaves.withColumn("segment", segment_of(self.levels))
        return proofs(own, self.logs[0], self.paths().drop("subroot"), self.levels).select("tree", "number", "doc_id", "hash", "path")


def _by_segment(leaves: DataFrame, log: DataFrame, above: DataFrame, run, schema: str) -> DataFrame:
    """run(leaves of a segment, its one row of the log with the path above it) for every segment."""
    logged = log.withColumnRenamed("n", "own").join(above, ["tree", "segment"])
    return leaves.groupBy("tree", "segment").cogroup(logged.groupBy("tree", "segment")).applyInPandas(run, schema)


def proofs(leaves: DataFrame, log: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """leaves (tree, segment, number, ...) with path, from the segment's log and the path above it."""

    def run(of: pd.DataFrame, logged: pd.DataFrame) -> pd.DataFrame:
        one = logged.iloc[0]
        upper = [(p["before"], p["after"]) for p in one["path"]]
        by_level = levels_of(one["nodes"], int(one["own"]), int(one["top"]))
        ways = [[*siblings(by_level, k % FAN**levels), *upper] for k in of["number"].tolist()]
        return of.assign(path=[[{"before": a, "after": b} for a, b in w] for w in ways])

    return _by_segment(leaves, log, above, run, ", ".join(f"{n} {t}" for n, t in leaves.dtypes) + f", path {PATH}")


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, and what its leaf after tampering makes of it."""
    made = Manifest(docs, levels)
    root = made.root

    def run(of: pd.DataFrame, logged: pd.DataFrame) -> pd.DataFrame:
        one = logged.iloc[0]
        by_level = levels_of(one["nodes"], int(one["own"]), int(one["top"]))
        upper = [(p["before"], p["after"]) for p in one["path"]]
        shas, folded = [], []
        for k, leaf, changed in zip(of["number"].tolist(), of["hash"].tolist(), of["changed"].tolist()):
            path = [*siblings(by_level, k % FAN**levels), *upper]
            shas.append(digest(*[x for pair in path for x in pair]))
            folded.append(fold(changed or leaf, path))
        return pd.DataFrame({
            "doc_id": of["doc_id"], "leaf": of["hash"], "subroot": one["subroot"], "root": root,
            "proof_sha256": shas, "folded_root": folded, "verified": [f == root for f in folded],
        })

    own = made.leaves.select("tree", segment_of(levels).alias("segment"), "number", "doc_id", "hash", "changed")
    return _by_segment(own, made.logs[0], made.paths(), run, CHECKED)
