"""Merkle manifest of a dataset, in blocks of higher-order SQL.

A row's leaf is the digest of its fields; a group's leaves stand in the order of a key, and every 16 consecutive nodes
become one until one is left, the group's subroot. The groups' subroots give the root in the same way. A leaf's proof
is what its path needs: in every run on the way up, the nodes left and right of its own.

Nodes of one group are dealt to blocks of 16 to the third power. Inside a block, an ordered array, ``sequence``,
``transform``, ``slice`` and ``aggregate`` collapse three levels in one expression; the blocks' roots are the nodes of the
next round. Paths go the other way: the few upper nodes first, then each block with its root's path. So no task
holds more than a block, whatever a group's size, and only digests are shuffled, never texts.

Digests are lower-case hexadecimal SHA-256; a digest of several things is that of their concatenation, in which digests are
hexadecimal text and a field is ``-`` for null, else its number of UTF-8 bytes, ``:`` and the value.

Defined results: null groups come first, as one group; null keys come first; rows of equal group and key stand in
the order of their leaves, and rows alike in all fields have a leaf each. A group of one leaf is its own subroot and a
single group's subroot the root; a leaf without anything beside it has an empty proof. An empty table has no rows and
no root. Columns beyond those named take no part and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, placed, settled

ARITY, STEPS = 16, 3
BLOCK = ARITY**STEPS
SIDES = "array<struct<left:string,right:string>>"
RUNS = "array<array<string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*[field(f) for f in fields])


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves, exact for every long."""
    return sum(((n > ARITY**k).cast("int") for k in range(1, 16)), (n > 1).cast("int"))


def _let(value: Column, use) -> Column:
    """``use`` of the value, which is computed once."""
    return F.transform(F.array(value), use)[0]


def _upto(n: Column) -> Column:
    """0 .. n - 1 for n from 0 to STEPS."""
    return F.slice(F.array(*[F.lit(k) for k in range(STEPS)]), F.lit(1), n)


def _runs(nodes: Column) -> Column:
    """An array of nodes in runs of 16; reading a run costs no more than its nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda k: F.slice(nodes, k * ARITY + 1, F.lit(ARITY))).cast(RUNS)


def _levels(nodes: Column, steps: Column) -> Column:
    """The block's levels from its nodes up, in runs, ``steps`` of them above the nodes."""
    kind = f"array<{RUNS}>"

    def above(done: Column) -> Column:
        return _runs(F.transform(F.element_at(done, -1), lambda run: F.sha2(F.array_join(run, ""), 256)))

    return F.aggregate(_upto(steps), F.array(_runs(nodes)).cast(kind), lambda done, _: F.concat(done, F.array(above(done))).cast(kind))


def _sides(levels: Column, steps: Column, k: Column) -> Column:
    """What stands left and right of the k-th node's path, level by level."""

    def side(level: Column) -> Column:
        own = F.floor(k / F.pow(F.lit(ARITY), level)).cast("int")
        run, place = F.element_at(F.element_at(levels, level + 1), F.floor(own / ARITY).cast("int") + 1), own % ARITY
        right = F.array_join(F.slice(run, place + 2, F.lit(ARITY)), "")
        return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"), right.alias("right"))

    return F.transform(_upto(steps), side).cast(SIDES)


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(grp, block, left, nodes) of (grp, at, left, node) rows; ``left`` is the number of levels above."""
    row = F.struct("at", "node", *more)
    met = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block"))
    return met.agg(F.first("left").alias("left"), F.array_sort(F.collect_list(row)).alias("rows"))


def _steps() -> Column:
    return F.least("left", F.lit(STEPS))


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' roots, as nodes of the next round."""
    levels = _levels(F.col("rows.node"), _steps())
    root = F.element_at(levels, -1)[0][0]
    return blocks.select("grp", F.col("block").alias("at"), (F.col("left") - _steps()).alias("left"), root.alias("node"))


def _rounds(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (grp, node) with each group's last node."""
    blocks = [_blocks(nodes, *more)]
    while True:
        roots = settled(_roots(blocks[-1]))
        if not roots.where(F.col("left") > 0).head(1):
            return blocks, roots.where("at = 0").select("grp", "node")
        blocks.append(_blocks(roots))


def _paths(blocks: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """(grp, block, path, keep) for the first of ``blocks``, from (grp, path, keep) for the groups."""
    told = above.withColumn("block", F.lit(0).cast("long"))
    for upper in reversed(blocks[1:]):
        told = settled(_walked(upper.join(told, ["grp", "block"]), keep).select("grp", F.col("at").alias("block"), "path", *keep))
    return told


def _walked(blocks: DataFrame, keep: list[str], *more: str) -> DataFrame:
    """(grp, at, node, path, keep, more) for every node of blocks that have their root's path."""

    def row(levels: Column, x: Column, k: Column) -> Column:
        path = F.concat(_sides(levels, _steps(), k), F.col("path")).cast(SIDES)
        return F.struct(x["at"].alias("at"), x["node"].alias("node"), path.alias("path"), *[x[c].alias(c) for c in more])

    made = _let(_levels(F.col("rows.node"), _steps()), lambda levels: F.transform("rows", lambda x, k: row(levels, x, k)))
    return blocks.select("grp", *keep, F.inline(made))


def proof(path: Column) -> Column:
    """The digest of everything beside a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda x, s: digest(s["left"], x, s["right"]))


@dataclass
class Manifest:
    """A dataset's tree: its groups' subroots, the root (null without rows), and the blocks that paths are read from."""

    subroots: DataFrame  # grp (as ordered text), subroot
    root: str | None
    blocks: list[DataFrame]
    tops: list[DataFrame]
    kept: list[str]

    def proofs(self) -> DataFrame:
        """Every leaf with its group, subroot, root and path: (grp, at, leaf, subroot, root, path) and the kept columns."""
        groups = self.subroots.select(F.lit("").alias("grp"), F.col("grp").alias("_mk_grp"), "subroot", "at")
        start = self.subroots.sparkSession.range(1).select(F.lit("").alias("grp"), F.array().cast(SIDES).alias("path"))
        tops = _paths(self.tops, start, [])
        walked = _walked(self.tops[0].join(tops, ["grp", "block"]), []).select("grp", "at", "path")
        above = settled(groups.join(walked, ["grp", "at"]).select(F.col("_mk_grp").alias("grp"), "path", "subroot"))
        told = _paths(self.blocks, above, ["subroot"])
        rows = _walked(self.blocks[0].join(told, ["grp", "block"]), ["subroot"], *self.kept)
        return rows.withColumnRenamed("node", "leaf").withColumn("root", F.lit(self.root))


def manifest(rows: DataFrame, group: str, key: str, node: str, keep: tuple[str, ...] = ()) -> Manifest:
    """The tree over ``rows``, which hold their leaves' digests in ``node``; ``keep`` are columns to find beside the proofs.

    The rows are narrow here: ids, digests and what is kept.
    """
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    named = [F.col(c).alias(f"_mk_{k}") for k, c in enumerate(keep)]
    leaves = rows.select(grp.alias("grp"), F.col(key).alias("_mk_key"), F.col(node).alias("node"), *named)
    held = [f"_mk_{k}" for k in range(len(keep))]
    ordered = placed(leaves, ["grp", "_mk_key", "node"])
    firsts = settled(ordered.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.count("*").alias("size")))
    told = looked_up(ordered.drop("_mk_key"), firsts, "grp")
    blocks, last = _rounds(told.select("grp", (F.col("at") - F.col("first")).alias("at"), depth(F.col("size")).alias("left"), "node", *held), *held)
    subroots = placed(last.select("grp", F.col("node").alias("subroot")), ["grp"])
    n = subroots.count()
    above = subroots.select(F.lit("").alias("grp"), "at", depth(F.lit(n)).alias("left"), F.col("subroot").alias("node"))
    tops, root = _rounds(above)
    found = root.head(1)
    return Manifest(subroots, found[0]["node"] if found else None, blocks, tops, held)


def with_proofs(rows: DataFrame, group: str, key: str, node: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(leaf, subroot, root, path and the kept columns) for every row."""
    made = manifest(rows, group, key, node, keep).proofs()
    return made.select("leaf", "subroot", "root", "path", *[F.col(f"_mk_{k}").alias(c) for k, c in enumerate(keep)])
