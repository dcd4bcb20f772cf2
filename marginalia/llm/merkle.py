"""A Merkle manifest of a table: a root for all rows, a subroot for each source, and a proof for each row.

Built bottom-up and proved top-down.  *Up*: every level of nodes is grouped into runs of ``FAN`` and stored as a table of
runs, each with its children's digests.  *Down*: a run takes the proof suffix that its own node inherited, and each child
puts its siblings before it; only runs and suffixes travel, a row's proof is never shuffled.

Sources are trees over their rows in order of id; their subroots are the leaves of one more tree, in order of source.
Rows get their places by range (``numbered``), so that a source of any size spreads over tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import sized, stored
from marginalia.operators.order import numbered

#: Children of a node.
FAN = 16
#: Columns that a row's digest covers, in order, and the upper-case letters that tampering lowers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A proof: from a leaf upwards, the digests before and after the node in its run.
PATH = "array<struct<left:string,right:string>>"


class Tree(NamedTuple):
    """Runs of each level (from the leaves up), the depth of the deepest tree, and each tree's root node."""

    runs: list[DataFrame]  # tree, at, children: array of (digest, and what the leaves carry)
    roots: DataFrame  # tree, level, digest


def digest_of(*values: Column) -> Column:
    """SHA-256 of values in a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)), 256)


def joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def build(leaves: DataFrame, carried: list[str], label: str) -> Tree:
    """Trees over ``leaves`` (``tree, at, rows, digest`` and the ``carried`` columns): places ``at`` from 0, ``rows`` in a tree.

    A tree of one leaf has no runs.  Each level is stored; the number of levels follows from the largest tree's rows.
    """
    runs: list[DataFrame] = []
    most = leaves.agg(F.max("rows")).first()[0] or 0
    nodes, level, roots = leaves, 0, []
    while True:
        roots.append(nodes.where("rows = 1").select("tree", F.lit(level).alias("level"), "digest"))
        if most <= 1:
            break
        item = F.struct("at", "digest", *(carried if not level else []))
        grouped = nodes.where("rows > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("at"), F.ceil(F.col("rows") / FAN).alias("rows")).agg(F.sort_array(F.collect_list(item)).alias("children"))  # FAN at most
        held = stored(grouped, f"{label}-{level}")
        runs.append(held)
        nodes, level, most = held.select("tree", "at", "rows", F.sha2(joined(F.col("children")), 256).alias("digest")), level + 1, -(-most // FAN)
    out = roots[0]
    for part in roots[1:]:
        out = out.unionByName(part)
    return Tree(runs, stored(out, f"{label}-roots"))


def _step(children: str, i: Column) -> Column:
    """A child's siblings: the digests before and after it, as two strings."""
    side = lambda start, n: F.array_join(F.transform(F.slice(children, start, n), lambda c: c["digest"]), "")
    return F.struct(side(F.lit(1), i).alias("left"), side(i + 2, F.lit(FAN)).alias("right"))


def prove(tree: Tree, tops: DataFrame, label: str) -> DataFrame:
    """Every leaf with its ``path``: steps from its own run up to its tree's root, then the root's own path.

    ``tops`` gives each root's path (``tree, path``).  Returns ``tree``, ``leaf`` (digest and what leaves carry) of trees
    with runs, and ``path``; a tree of one leaf has none here: its path is its root's.
    """
    roots = tree.roots.join(tops, "tree").select("tree", "level", F.lit(0).cast("long").alias("at"), "path")
    held = None
    for level in range(len(tree.runs), 0, -1):
        own = roots.where(F.col("level") == level).select("tree", "at", "path")
        held = own if held is None else own.unionByName(held)
        if level < len(tree.runs):
            held = stored(held, f"{label}-path-{level}")
        each = tree.runs[level - 1].join(held, ["tree", "at"]).select("tree", "path", "children", F.posexplode("children").alias("i", "leaf"))
        down = F.concat(F.array(_step("children", F.col("i"))), F.col("path"))
        held = each.select("tree", F.col("leaf.at").alias("at"), down.alias("path"), *(["leaf"] if level == 1 else []))
    return held


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows are ordered by id within a source, null first; rows that share an id by digest, and equal rows are leaves of their
    own.  A null source is a tree of its own, before the others.  Where 5 divides the id's CRC-32 the fold starts from the
    row with its text's A to Z lowered, so that it verifies only if there are none; a null id has no CRC and is never
    tampered with.  Columns that the digest does not cover play no part; an empty table gives no rows.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    tampered = [F.translate(F.col("text"), UPPER, LOWER) if c == "text" else F.col(f"`{c}`") for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "source", digest_of(*fields).alias("digest"), F.when(chosen, digest_of(*tampered)).alias("tampered"))
    placed = numbered(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], label="merkle")
    leaves = placed.select(F.col("group_start").alias("tree"), F.col("position").alias("at"), F.col("group_rows").alias("rows"), "digest", "doc_id", "tampered")
    leaves = stored(leaves, "merkle-leaves")
    carried = ["doc_id", "tampered"]
    sources = build(leaves, carried, "merkle-rows")

    tops = numbered(sources.roots.select("tree", "digest"), [], [F.col("tree").asc()], label="merkle-sources")
    whole = build(tops.select(F.lit(0).cast("long").alias("tree"), F.col("position").alias("at"), F.col("group_rows").alias("rows"), "digest", F.col("tree").alias("source")), ["source"], "merkle-top")
    root = whole.roots.select(F.col("digest").alias("root"))  # one row
    if whole.runs:
        nothing = F.array().cast(PATH)
        paths = prove(whole, whole.roots.select("tree", nothing.alias("path")), "merkle-top").select(F.col("leaf.source").alias("tree"), "path")
    else:  # one source at most: its subroot is the root
        paths = sources.roots.select("tree", F.array().cast(PATH).alias("path"))
    paths = stored(paths, "merkle-paths")
    subroots = sources.roots.select("tree", F.col("digest").alias("subroot"))

    lone = leaves.where("rows = 1").join(paths, "tree").select("tree", F.struct("at", "digest", *carried).alias("leaf"), "path")
    proved = lone if not sources.runs else prove(sources, paths, "merkle-rows").select("tree", "leaf", "path").unionByName(lone)
    few = sized(subroots, subroots.count())
    start = F.coalesce("leaf.tampered", "leaf.digest")
    out = proved.join(few, "tree").join(F.broadcast(root)).select(
        F.col("leaf.doc_id").alias("doc_id"), F.col("leaf.digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
