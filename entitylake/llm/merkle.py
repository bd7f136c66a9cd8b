"""Merkle manifest of a data set: one tree per group of rows, one tree over the groups.

A node of a tree is the hash of up to ``FANOUT`` consecutive nodes below it.  Only every
few levels are stored: the stored nodes of a level lie in aligned chunks of
``FANOUT ** stride``, each the lower end of a subtree.  A proof regenerates the levels in
between from the chunk that holds the node, emits the siblings on its way and forgets them.

All work is Spark expressions on short rows (a hash, a place, what the caller carries);
a chunk is the largest group that is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions.binding import let, record
from entitylake.sources.stage import staged

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Levels from one stored level to the next.
STRIDE = 2


def leaf_hash(*values: Column) -> Column:
    """Hash of a row: each value as its byte count, a colon and itself, or a dash for null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the group does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """Trees by their stored levels, the leaves' first.

    A level has a row per chunk: ``tree, block, n`` (nodes of the tree on this level) and
    ``items``, an array of the chunk's nodes (``pos``, ``hash`` and, on the lowest level,
    what the leaves carry).
    """

    levels: list[DataFrame]
    carried: tuple[str, ...]
    stride: int

    @property
    def width(self) -> int:
        return 1 << (FANOUT_BITS * self.stride)

    def roots(self) -> DataFrame:
        """``tree, hash``: a row per tree.  A lone leaf is its tree's root."""
        whole = [level.where(F.col("n") <= self.width).select("tree", top_of(self.stride).alias("hash")) for level in self.levels]
        found = whole[0]
        for more in whole[1:]:
            found = found.unionByName(more)
        return found


def placed(leaves: DataFrame, order: Sequence[str], owner: str) -> DataFrame:
    """``leaves`` with ``pos``, their place in their tree's order from 0, and ``n``, the tree's leaves.

    Rows are sorted by ranges of tree and order, so a tree of any size is spread; a place is
    the row's place in its range plus the rows of the tree in earlier ranges.
    """
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # written once: the numbers have to be the same for both readers
    rows = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), owner)
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    parts = rows.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "tree", "_range", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_shift"), F.sum("_rows").over(tree).alias("n")
    )
    return rows.join(parts, ["tree", "_range"]).withColumn("pos", F.col("_at") - F.col("_shift")).drop("_at", "_range", "_shift")


def parents(nodes: Column) -> Column:
    """The hashes of runs of ``FANOUT`` nodes; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, FANOUT_BITS))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def with_levels(stride: int, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of a chunk's levels: the stored one and those regenerated from it, null above the tree's root."""

    def grow(levels: list[Column]) -> Column:
        k = len(levels) - 1
        if k == stride:
            return body(levels)
        above = F.when(F.col("n") > (1 << (FANOUT_BITS * k)), parents(levels[k]))
        return let(above, lambda level: grow([*levels, level]))

    return let(F.transform("items", lambda x: x["hash"]), lambda level: grow([level]))


def top_of(stride: int) -> Column:
    """The node that a chunk's subtree ends in."""
    return with_levels(stride, lambda levels: F.element_at(F.coalesce(*reversed(levels)), 1))


def siblings(level: Column, own: Column) -> Column:
    """What stands before and behind a node in its run."""
    at = F.pmod(own, F.lit(FANOUT)).cast("int")
    own = own.cast("int")
    return record(
        before=F.array_join(F.slice(level, own - at + 1, at), ""),
        after=F.array_join(F.slice(level, own + 2, F.lit(FANOUT - 1) - at), ""),
    )


def build(leaves: DataFrame, order: Sequence[str], carried: Sequence[str] = (), *, stride: int = STRIDE, owner: str | None = None) -> Manifest:
    """The trees of ``leaves`` (``tree``, ``hash``, the columns of ``order`` and those carried).

    Leaves of a tree ascend by ``order``, nulls first, and then by their hash, so equal rows
    may stand in any order.  Stored levels are written to the shared folder.  An empty table
    gives a manifest without trees.
    """
    owner = owner or f"merkle-{uuid4().hex}"
    kept = list(dict.fromkeys([*order, *carried]))
    # a number of its own lets ranges cut through repeated rows
    rows = staged(leaves.select("tree", "hash", *kept).withColumn("_row", F.monotonically_increasing_id()), owner)
    nodes = placed(rows, [*order, "hash", "_row"], owner).drop("_row")
    bits = FANOUT_BITS * stride
    levels: list[DataFrame] = []
    while True:
        extra = kept if not levels else []
        chunks = nodes.groupBy("tree", F.shiftright("pos", bits).alias("block"), "n").agg(
            F.array_sort(F.collect_list(F.struct("pos", "hash", *extra))).alias("items")
        )
        levels.append(staged(chunks, owner))
        larger = levels[-1].where(F.col("n") > (1 << bits))
        if larger.isEmpty():
            return Manifest(levels, tuple(kept), stride)
        above = F.shiftright(F.col("n") - 1, bits) + 1
        nodes = larger.select("tree", F.col("block").alias("pos"), top_of(stride).alias("hash"), above.alias("n"))


def proofs(manifest: Manifest, above: DataFrame) -> DataFrame:
    """A row per leaf: ``tree, pos, hash``, what it carries, ``path`` and further columns of ``above``.

    ``above`` gives each ``tree`` the path from its root on (``above``, empty where the root
    is the end).  ``path`` lists, from the leaf upwards, what stands before and behind the
    node in its run; a node alone in its run has both empty.
    """
    others = [c for c in above.columns if c not in ("tree", "above")]
    inherited = None
    for depth in range(len(manifest.levels) - 1, -1, -1):
        level = manifest.levels[depth]
        rows = level.where(F.col("n") <= manifest.width).join(above, "tree")
        if inherited is not None:
            rows = rows.unionByName(level.where(F.col("n") > manifest.width).join(inherited, ["tree", "block"]))
        fields = ["pos", "hash", *(manifest.carried if depth == 0 else ())]

        def paths(levels: list[Column], fields: list[str] = fields) -> Column:
            def of(item: Column, i: Column) -> Column:
                steps = [
                    F.when(F.col("n") > (1 << (FANOUT_BITS * k)), siblings(levels[k], F.shiftright(i, FANOUT_BITS * k)))
                    for k in range(manifest.stride)
                ]
                path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("above"))
                return record(**{f: item[f] for f in fields}, path=path)

            return F.transform("items", of)

        found = rows.select("tree", *others, F.inline(with_levels(manifest.stride, paths)))
        inherited = found.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), *others)
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def grouped_proofs(
    leaves: DataFrame, order: Sequence[str], carried: Sequence[str] = (), *, stride: int = STRIDE, owner: str | None = None
) -> DataFrame:
    """Proofs of leaves up to one root over the trees of all groups: ``subroot`` and ``root`` beside ``path``.

    ``leaves`` has ``tree`` (see ``group_key``), ``hash`` and the columns of ``order`` and
    ``carried``.  Groups are ordered by their key.  No rows give no proofs.
    """
    owner = owner or f"merkle-{uuid4().hex}"
    groups = build(leaves, order, carried, stride=stride, owner=owner)
    tops = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash")
    whole = build(tops, ["group"], stride=stride, owner=owner)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    end = whole.roots().select("tree", nothing.alias("above"), F.col("hash").alias("root"))
    of_groups = proofs(whole, end)
    above = of_groups.select(F.col("group").alias("tree"), F.col("path").alias("above"), F.col("hash").alias("subroot"), "root")
    return proofs(groups, above)


def document_leaves(docs: DataFrame, *, every: int = 5, id_col: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """``tree, hash, doc_id, changed``: the leaf of each document, and of its tampered form.

    Documents whose id's crc32 is divisible by ``every`` are tampered with: A-Z of the text
    become small.  ``changed`` is null for all others, and for a null id.
    """
    def leaf(value: Column) -> Column:
        return leaf_hash(F.col(id_col), F.col(group), F.col("lang"), F.col("n_chars"), value)

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return docs.select(
        group_key(F.col(group)).alias("tree"),
        leaf(F.col(text)).alias("hash"),
        F.col(id_col).alias("doc_id"),
        F.when(touched, leaf(F.translate(text, upper, upper.lower()))).alias("changed"),
    )


def document_manifest(docs: DataFrame, *, every: int = 5, stride: int = STRIDE, owner: str | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root, verified`` of each document.

    ``folded_root`` is recomputed from the tampered leaf, where there is one, and the
    original siblings.  Rows without an id are leaves like others, the first of their group;
    repeated rows are leaves of their own.  Nulls hash as a dash, which no value does.
    Further columns of ``docs`` play no part.
    """
    found = grouped_proofs(document_leaves(docs, every=every), ["doc_id"], ["changed"], stride=stride, owner=owner)
    return found.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        "path",
        folded(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
