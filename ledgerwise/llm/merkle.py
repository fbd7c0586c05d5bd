"""Merkle manifest of a dataset with octopus multiproofs.

Rows are leaves of one tree per group, in a given order; the groups' roots, ordered by group, are the leaves of a top
tree.  While a level has several nodes, every ``ARITY`` consecutive ones (the last run: fewer, even one) become the
hash of their digests.  A node has the coordinate (tree, level, idx).

1. Leaf digests are hashed in the JVM and written; a range partitioning of these narrow rows gives each leaf its exact
   position, from counts per partition.  A group with most of the rows spreads over many partitions.
2. A leaf partition is a run of at most ``ROWS`` consecutive leaves.  It derives all nodes that it can alone
   and hands on only the largest of them, a few per level.  Nodes that straddle partitions are built from those in
   blocks of ``ARITY ** STRIDE`` leaves, then in blocks of block roots, so no task meets a whole tree.
3. Octopus multiproof: the partition also lists the minimal union of coordinates that it lacks to prove all
   of its leaves: the neighbours in the runs at the two ends of its interval, level by level, in its trees and in the top one.
   One join fetches them.
4. With these the partition derives the shared interior nodes once and expands each leaf's own proof.  Folding a proof
   (``fold``) is a native expression that needs neither the partition nor Python.

Results: one row per input row.  Null groups come first, null ids first in their group; their tree is like any other.
Rows that tie in group and id are ordered by digest; equal digests may swap places, which leaves the set of proofs as it is.
Null and empty texts have different leaves.  An empty table gives an empty table.  Texts are hashed whole.
Columns of the input are not carried unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

ARITY = 3
#: Leaves of a partition, and levels that one block of straddling nodes spans.
ROWS, STRIDE = 16_384, 12
_TOP = -1
_NODE = "tree bigint, level int, idx bigint, n bigint, hash string, top boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as leaf input: its UTF-8 byte count, a colon and the value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """Root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """Digests of a proof joined in order."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree with n leaves; the last level is the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def run_of(idx: int, count: int) -> range:
    """The run that holds a node, on a level of ``count`` nodes."""
    first = idx - idx % ARITY
    return range(first, min(first + ARITY, count))


def missing(leaves: list[int], n: int) -> Iterator[tuple[int, int]]:
    """Minimal (level, idx) that proofs of these leaves need and that can't be derived from the leaves and each other."""
    path = sorted(set(leaves))
    for level, count in enumerate(sizes(n)[:-1]):
        here = set(path)
        runs = sorted({i // ARITY for i in path})
        for r in runs:
            yield from ((level, i) for i in run_of(r * ARITY, count) if i not in here)
        path = runs


def climb(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[str, list[dict[int, tuple[str, str]]]]:
    """Root, and for each level (left, right) siblings of the nodes above the leaves."""
    path, out = leaves, []
    for level, count in enumerate(sizes(n)[:-1]):
        sides, above = {}, {}
        for first in sorted({i - i % ARITY for i in path}):
            run = [path[i] if i in path else fetched[level, i] for i in run_of(first, count)]
            above[first // ARITY] = digest(*run)
            for k in range(len(run)):
                if first + k in path:
                    sides[first + k] = "".join(run[:k]), "".join(run[k + 1:])
        out.append(sides)
        path = above
    return path[0], out


def covers(first: int, hashes: list[str], n: int, every: bool = False) -> Iterator[tuple[int, int, str, bool]]:
    """(level, idx, hash, is root) of the largest nodes, or of all, that an interval of leaves derives alone."""
    a, nodes = first, hashes
    for level, count in enumerate(sizes(n)):
        b = a + len(nodes)
        lo = -(-a // ARITY)
        hi = -(-b // ARITY) if b == count else b // ARITY
        if every or count == 1 or lo >= hi:
            yield from ((level, a + k, h, count == 1) for k, h in enumerate(nodes))
        else:
            yield from ((level, i, nodes[i - a], False) for i in (*range(a, lo * ARITY), *range(min(b, hi * ARITY), b)))
        if count == 1 or lo >= hi:
            return
        a, nodes = lo, [digest(*nodes[r * ARITY - a:r * ARITY - a + ARITY]) for r in range(lo, hi)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_SEEN = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()),
                   ("hash", pa.string()), ("top", pa.bool_())])


def _trees(t: pa.Table) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(tree, n, row numbers, positions) of each tree in a leaf partition, in order of position."""
    tree, idx, n = (t.column(c).to_pylist() for c in ("tree", "idx", "n"))
    order = sorted(range(len(tree)), key=lambda k: (tree[k], idx[k]))
    for ordinal, group in groupby(order, tree.__getitem__):
        own = list(group)
        yield ordinal, n[own[0]], own, [idx[k] for k in own]


def _cover(t: pa.Table) -> pa.Table:
    """What a leaf partition derives (hash set) and what it needs (hash null).

    Its neighbours need the largest nodes only; nodes of the top tree are needed by any partition.
    """
    part, leaf, rows = t.column("part")[0].as_py(), t.column("leaf").to_pylist(), []
    met = []
    for tree, n, own, at in _trees(t):
        met.append(tree)
        rows += [(part, tree, level, i, n, h, top) for level, i, h, top in covers(
            at[0], [leaf[k] for k in own], n, every=tree == _TOP)]
        rows += [(part, tree, level, i, n, None, False) for level, i in missing(at, n) if tree != _TOP]
    if met != [_TOP]:
        trees = t.column("trees")[0].as_py()
        rows += [(part, _TOP, level, i, trees, None, False) for level, i in missing(met, trees)]
    return _table(rows, _SEEN)


def _block(level0: int, level1: int):
    """Straddling nodes of one block between two levels, from the largest nodes of its partitions."""

    def build(t: pa.Table) -> pa.Table:
        tree, n = t.column("tree")[0].as_py(), t.column("n")[0].as_py()
        have: dict[int, dict[int, str]] = {level: {} for level in range(level0, level1 + 1)}
        for level, i, h in zip(*(t.column(c).to_pylist() for c in ("level", "idx", "hash"))):
            have[level][i] = h
        counts, rows = sizes(n), []
        for level in range(level0, min(level1, len(counts) - 1)):
            for first in sorted({i - i % ARITY for i in have[level]}):
                run = [have[level].get(i) for i in run_of(first, counts[level])]
                if None not in run and first // ARITY not in have[level + 1]:
                    have[level + 1][first // ARITY] = h = digest(*run)
                    rows.append((tree, level + 1, first // ARITY, n, h, counts[level + 1] == 1))
        return _table(rows, pa.schema(list(_SEEN)[1:]))

    return build


def _nodes(known: DataFrame, height: int, stride: int) -> DataFrame:
    """All nodes worth a lookup: the largest ones of the partitions (``known``) and those that straddle partitions."""
    out = known
    for low in range(0, height, stride):
        high = low + stride
        scale = F.pow(F.lit(float(ARITY)), high - F.col("level")).cast("bigint")
        level = out.filter((F.col("level") >= low) & (F.col("level") < high) & ~F.col("top")).withColumn(
            "block", F.floor(F.col("idx") / scale))
        built = level.groupBy("tree", "block").applyInArrow(_block(low, high), _NODE)
        out = out.unionByName(cut_lineage(built))
    return out


def _placed(rows: DataFrame, per_part: int) -> DataFrame:
    """Exact places of the leaves: tree (ordinal of the group), idx, n leaves of the tree, number of trees, part."""
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("leaf")]
    spread = rows.withColumn("_salt", F.rand(7)).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    spread = cut_lineage(spread.drop("_salt").withColumn("at", F.monotonically_increasing_id())).withColumn(
        "p", F.shiftright("at", 33))
    runs = spread.groupBy("p", "grp").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    of_group = Window.partitionBy("grp")
    runs = runs.withColumn("before", F.sum("c").over(of_group.orderBy("p")) - F.col("c")).withColumn(
        "n", F.sum("c").over(of_group)).withColumn("opens", (F.col("before") == 0).cast("bigint"))
    runs = runs.withColumn("nth", F.sum("opens").over(Window.partitionBy("p").orderBy("first")))
    opened = runs.groupBy("p").agg(F.sum("opens").alias("o"))  # one row per partition
    opened = opened.select("p", (F.sum("o").over(Window.orderBy("p")) - F.col("o")).alias("earlier"),
                           F.sum("o").over(Window.partitionBy()).alias("trees"))
    ordinal = F.max(F.when(F.col("opens") == 1, F.col("earlier") + F.col("nth") - 1)).over(of_group)
    runs = runs.join(opened, "p").withColumn("tree", ordinal).select(
        F.col("p").alias("_p"), F.col("grp").alias("_grp"), "first", "before", "n", "trees", "tree")
    here = (F.col("p") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_grp"))
    part = F.shiftleft("p", 20) + F.floor((F.col("at") - F.shiftleft("p", 33)) / per_part)
    return spread.join(runs, here).withColumn("idx", F.col("before") + F.col("at") - F.col("first")).withColumn(
        "part", part).drop("_p", "_grp", "first", "before", "at", "p")


def _steps(t: pa.Table, got: pa.Table, keep: list[str]) -> pa.Table:
    """Rows of a leaf partition with their proofs; ``got`` holds the fetched nodes."""
    fetched: dict[int, dict[tuple[int, int], str]] = {}
    for tree, level, i, h in zip(*(got.column(c).to_pylist() for c in ("tree", "level", "idx", "hash"))):
        fetched.setdefault(tree, {})[level, i] = h
    leaf = t.column("leaf").to_pylist()
    found = []
    for tree, n, own, at in _trees(t):
        subroot, sides = climb({i: leaf[k] for i, k in zip(at, own)}, n, fetched.get(tree, {}))
        found.append((tree, subroot, sides, own, at))
    root, above = climb({tree: subroot for tree, subroot, *_ in found}, t.column("trees")[0].as_py(), fetched.get(_TOP, {}))
    order, subroots, left, right, ends = [], [], [], [], [0]
    for tree, subroot, sides, own, at in found:
        order += own
        subroots += [subroot] * len(own)
        over = [level[tree // ARITY ** k] for k, level in enumerate(above)]
        for i in at:
            steps = [level[i // ARITY ** k] for k, level in enumerate(sides)] + over
            left += [a for a, _ in steps]
            right += [b for _, b in steps]
            ends.append(len(left))
    steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
    t = t.take(pa.array(order, pa.int64()))
    return pa.Table.from_arrays([*[t.column(c) for c in ("id", "grp", "leaf", *keep)], pa.array(subroots, pa.string()),
                                 pa.array([root] * len(order), pa.string()), steps],
                                ["id", "grp", "leaf", *keep, "subroot", "root", "steps"])


def prove(rows: DataFrame, id_col: Column, group: Column, leaf: Column, keep: dict[str, Column] | None = None,
          per_part: int = ROWS, stride: int = STRIDE) -> DataFrame:
    """id, grp, leaf, the columns of ``keep``, subroot, root and steps: an array of the (left, right) siblings' digests per
    level, from the leaf to the root."""
    keep = keep or {}
    narrow = cut_lineage(rows.select(id_col.cast("bigint").alias("id"), group.alias("grp"), leaf.alias("leaf"),
                                     *[c.alias(name) for name, c in keep.items()]))
    placed = cut_lineage(_placed(narrow, per_part))
    most = placed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("trees"), F.lit(0)).alias("trees")).first()

    seen = cut_lineage(placed.select("part", "tree", "idx", "n", "trees", "leaf").groupBy("part").applyInArrow(
        _cover, "part bigint, " + _NODE))
    nodes = _nodes(seen.filter("hash IS NOT NULL").drop("part"), len(sizes(most.n)) - 1, stride)
    roots = nodes.filter("top").select(
        F.floor(F.col("tree") / per_part).alias("part"), F.lit(_TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"),
        F.lit(most.trees).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("trees"), F.col("hash").alias("leaf"))
    upper = cut_lineage(roots.groupBy("part").applyInArrow(_cover, "part bigint, " + _NODE))
    nodes = nodes.unionByName(_nodes(upper.filter("hash IS NOT NULL").drop("part"), len(sizes(most.trees)) - 1, stride))

    need = seen.filter("hash IS NULL").select("part", "tree", "level", "idx")
    fetched = need.join(nodes.select("tree", "level", "idx", "hash"), ["tree", "level", "idx"])
    names = list(keep)
    kinds = dict(placed.dtypes)
    schema = ", ".join(["id bigint", f"grp {kinds['grp']}", "leaf string", *[f"`{c}` {kinds[c]}" for c in names],
                        "subroot string, root string, steps array<struct<left string, right string>>"])
    return placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(lambda t, got: _steps(t, got, names), schema)
