"""Merkle manifest of a dataset: one root over all rows, and a proof for each row.

A row's leaf is the digest of its fields.  Leaves stand in groups (languages), each in
ascending order of its key; in a group every ``ARITY`` consecutive nodes become their
digest, level by level, until one is left: the group's subroot.  The subroots, in the
order of the groups, make the tree above in the same way, and its top is the root.

Sparse forests.  Rows are range-sorted, so a partition holds consecutive leaves, most
often in the middle of a tree.  It completes the runs of siblings that it has whole and
keeps the rest: a forest of unresolved nodes, each under (tree, level, index), a few a
level.  As the number of leaves of each tree is known, so is the arity of every run,
the last of a level among them.  Joining two forests and completing the runs that their
nodes fill is associative and commutative with the empty forest as identity
(``Forest``), so partitions may be merged in any shape: a tree of merges of ``FAN_IN``
forests each, a round a level of it, ends with the root alone.  A completed subroot
becomes a leaf of the tree above at once (tree -1).

Proofs come down the same way.  What a partition can't compute are the siblings to the
left and right of its ancestors, a few a level; it asks for these by place among the
nodes that forests kept or merges made, and works out its rows' paths from them.

Nothing grows with the input in one place: a partition's rows and O(log n) nodes are a
task's, a count a partition and group is summed in windows, the root is one row.

Defined results
* null fields are written ``-``, so null and empty differ.  Null groups are one group,
  the first; null keys come first in theirs.
* equal keys: ordered by leaf.  Repeated rows are leaves of their own, side by side;
  which is which doesn't matter, as they are equal.
* one row: its leaf is subroot and root, and the proof is the digest of nothing.
* empty table: no rows.  Very long texts are hashed whole, and are read once.
* other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, dealt_in_order, discard, materialize, sql_crc32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, FAN_IN = 2, 16
#: Leaves of a partition.
LEAVES = 50_000
#: The tree of subroots.
TOP = -1

Node = tuple[int, int, int]  # tree, level, index


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


def widths(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the top."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


# --- the monoid -----------------------------------------------------------


class Forest:
    """Unresolved nodes by place.  ``leaves`` has each tree's number of leaves, and may
    be partial as long as it covers the trees that nodes stand in; ``made`` has the
    nodes that this forest completed, resolved or not."""

    def __init__(self, nodes: dict[Node, str] | None = None, leaves: dict[int, int] | None = None):
        self.nodes: dict[Node, str] = {}
        self.made: dict[Node, str] = {}
        self.leaves = dict(leaves or {})
        self._add(nodes or {})

    def __or__(self, other: Forest) -> Forest:
        out = Forest(leaves=self.leaves | other.leaves)
        out.nodes = dict(self.nodes)
        out._add(other.nodes)
        return out

    def _add(self, nodes: dict[Node, str]) -> None:
        self.nodes.update(nodes)
        todo = sorted(nodes)
        while todo:
            tree, level, index = todo.pop()
            if (tree, level, index) not in self.nodes:
                continue  # its run is complete already
            count = width(self.leaves[tree], level)
            if count == 1:
                if tree == TOP:
                    continue
                above = (TOP, 0, tree)
                self.nodes[above] = self.made[above] = self.nodes.pop((tree, level, index))
                todo.append(above)
                continue
            first = index // ARITY * ARITY
            run = [(tree, level, k) for k in range(first, min(first + ARITY, count))]
            if all(n in self.nodes for n in run):
                above = (tree, level + 1, index // ARITY)
                self.nodes[above] = self.made[above] = digest("".join(self.nodes.pop(n) for n in run))
                todo.append(above)


def fold_range(tree: int, start: int, leaves: list[str], total: int) -> dict[Node, str]:
    """Unresolved nodes of consecutive leaves: what ``Forest`` gives, a level at a time."""
    out, level = {}, 0
    for count in widths(total):
        end = start + len(leaves)
        if count == 1:
            out |= {(tree, level, start + k): x for k, x in enumerate(leaves)}
            break
        first = min(end, -(-start // ARITY) * ARITY)
        last = end if end == count else max(first, end // ARITY * ARITY)
        out |= {(tree, level, start + k): leaves[k] for k in (*range(first - start), *range(last - start, end - start))}
        inner = leaves[first - start : last - start]
        leaves, start, level = [digest("".join(inner[k : k + ARITY])) for k in range(0, len(inner), ARITY)], first // ARITY, level + 1
        if not leaves:
            break
    return out


# --- proofs ---------------------------------------------------------------


def beside(start: int, end: int, total: int) -> list[tuple[int, int]]:
    """(level, index) of the siblings that the ancestors of leaves start .. end - 1
    have outside."""
    out = []
    for level, count in enumerate(widths(total)[:-1]):
        first = start // ARITY * ARITY
        last = min(count, -(-end // ARITY) * ARITY)
        out += [(level, k) for k in (*range(first, start), *range(end, last))]
        start, end = first // ARITY, -(-end // ARITY)
    return out


def paths(start: int, leaves: list[str], total: int, known: dict[tuple[int, int], str]) -> tuple[str, list[tuple]]:
    """(top digest, path of each leaf); a path is (siblings to the left, to the right,
    path of the parent), or () at the top.  ``known`` has the nodes of ``beside``."""
    rows, level_nodes, at = [], leaves, start
    for level, count in enumerate(widths(total)[:-1]):
        end, first = at + len(level_nodes), at // ARITY * ARITY
        last = min(count, -(-end // ARITY) * ARITY)
        whole = [known[level, k] for k in range(first, at)] + level_nodes + [known[level, k] for k in range(end, last)]
        rows.append((at, first, len(level_nodes), whole))
        level_nodes = [digest("".join(whole[k : k + ARITY])) for k in range(0, len(whole), ARITY)]
        at = first // ARITY
    above: list[tuple] = [()]
    for at, first, n, whole in reversed(rows):
        here = []
        for k in range(at - first, at - first + n):
            run = k // ARITY * ARITY
            here.append(("".join(whole[run:k]), "".join(whole[k + 1 : run + ARITY]), above[(first + k) // ARITY - first // ARITY]))
        above = here
    return level_nodes[0], above


def siblings(path: tuple) -> Iterable[str]:
    while path:
        yield path[0] + path[1]
        path = path[2]


def folded(leaf: str, path: tuple) -> str:
    """The root that a leaf and its siblings give."""
    while path:
        leaf, path = digest(path[0] + leaf + path[1]), path[2]
    return leaf


# --- leaves ---------------------------------------------------------------


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*(field(v) for v in values)), "UTF-8"), 256)


# --- the plan -------------------------------------------------------------

_NODE = "tree long, level int, index long, digest string, leaves long"
_NODE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())


def _nodes_table(rows: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.Table:
    names = [n for n, _ in more] + [x.split()[0] for x in _NODE.split(", ")]
    types = [t for _, t in more] + list(_NODE_TYPES)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def placed(leaves: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    """(leaves with their partition ``part``, a row a partition and group, groups).

    The second has part, group, tree (the group's place in the order of groups), start
    (the first leaf's index in the group) and total (the group's leaves).
    """
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("leaf").asc()]
    dealt = dealt_in_order(leaves, order, "manifest-order", blocks_for(leaves.count(), LEAVES))
    counts = dealt.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group)
    counts = counts.select("part", F.col(group).alias("group"), F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(own).alias("total"), F.min("part").over(own).alias("first"))
    counts = materialize(counts, "manifest-counts")
    # a group's place: groups that begin in earlier partitions, and earlier ones in its own
    begun = counts.where("part = first")
    per_part = begun.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    per_part = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    trees = begun.join(per_part, "part").select("group", (F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())) - 1 + F.col("before")).alias("tree"))
    meta = counts.alias("c").join(trees.alias("t"), F.col("c.group").eqNullSafe(F.col("t.group"))).select("c.part", "c.group", "t.tree", "c.start", "c.total")
    meta = materialize(meta, "manifest-groups")
    n_trees = begun.count()
    discard(counts)
    return dealt, meta, n_trees


def _segments(rows: pa.Table, meta: pa.Table, group: str):
    """(tree, start, total, rows' positions) of each group of a partition, in order."""
    found = sorted(zip(meta["tree"].to_pylist(), meta["group"].to_pylist(), meta["start"].to_pylist(), meta["total"].to_pylist(), strict=True))
    by_group: dict = {}
    at = rows["at"].to_pylist()
    for position, g in enumerate(rows[group].to_pylist()):
        by_group.setdefault(g, []).append(position)
    for tree, g, start, total in found:
        yield tree, start, total, sorted(by_group[g], key=at.__getitem__)


def tree_reduce(forests: DataFrame, n_parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes of the last forest, tables of all nodes that forests kept or merges made)."""

    def merge(t: pa.Table) -> pa.Table:
        group = t["part"][0].as_py() // FAN_IN
        out = Forest()
        made: dict[Node, str] = {}
        by_part: dict[int, dict[Node, str]] = {}
        leaves: dict[int, int] = {}
        for part, tree, level, index, value, n, top in zip(*(t[c].to_pylist() for c in ("part", "tree", "level", "index", "digest", "leaves", "trees")), strict=True):
            by_part.setdefault(part, {})[tree, level, index] = value
            leaves |= {tree: n, TOP: top}
        for part in sorted(by_part):
            one = Forest(leaves=leaves)
            one.nodes = by_part[part]
            out = out | one
            made |= out.made
        rows = [(group, key in out.nodes, top, *key, value, leaves[key[0]]) for key, value in (made | out.nodes).items()]
        return _nodes_table(rows, _MORE)

    tables = [forests]
    while n_parts > 1:
        merged = tables[-1].where("open").groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merge, _OPEN)
        tables.append(materialize(merged, "manifest-merged"))
        n_parts = -(-n_parts // FAN_IN)
    return tables[-1].where("open"), tables


_MORE = [("part", pa.int64()), ("open", pa.bool_()), ("trees", pa.int64())]
_OPEN = f"part long, open boolean, trees long, {_NODE}"


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, counted: str = "n_chars", tampered: Column | None = None) -> tuple[str | None, DataFrame]:
    """(root, a row a leaf: key, leaf, subroot, root, proof_sha256, folded_root).

    ``folded_root`` is what the row's own leaf and its siblings give.  Where
    ``tampered`` holds, that leaf is made anew with ``counted`` one greater.
    """
    spark = docs.sparkSession
    values = [F.col(f) for f in fields]
    changed = [F.col(f).cast("decimal(38,0)") + 1 if f == counted else F.col(f) for f in fields]
    again = F.when(F.coalesce(tampered, F.lit(False)) & F.col(counted).isNotNull(), leaf_of(changed)) if tampered is not None else F.lit(None).cast("string")
    leaves = materialize(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_of(values).alias("leaf"), again.alias("again")), "manifest-leaves")
    dealt, meta, n_trees = placed(leaves, "group", "key")

    def up(rows: pa.Table, meta: pa.Table) -> pa.Table:
        part = meta["part"][0].as_py()
        leaf = rows["leaf"].to_pylist()
        sizes, subroots, nodes = {TOP: n_trees}, {}, {}
        segments = list(_segments(rows, meta, "group"))
        for tree, start, total, at in segments:
            sizes[tree] = total
            for place, value in fold_range(tree, start, [leaf[k] for k in at], total).items():
                if width(total, place[1]) == 1:
                    subroots[TOP, 0, tree] = value
                else:
                    nodes[place] = value
        forest = Forest(nodes, sizes) | Forest(subroots, sizes)
        out = [(part, True, n_trees, *place, value, sizes[place[0]]) for place, value in forest.nodes.items()]
        # what the way down needs has no digest yet
        asked = [(tree, level, index) for tree, start, total, at in segments for level, index in beside(start, start + len(at), total)]
        asked += [(TOP, level, index) for level, index in beside(segments[0][0], segments[-1][0] + 1, n_trees)]
        out += [(part, False, n_trees, *place, None, sizes[place[0]]) for place in asked]
        return _nodes_table(out, _MORE)

    parts = dealt.select("part", "group", "at", "leaf", "key", "again")
    both = materialize(parts.groupBy("part").cogroup(meta.groupBy("part")).applyInArrow(up, _OPEN), "manifest-forests")
    n_parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    last, tables = tree_reduce(both, n_parts)
    top = last.where(F.col("tree") == TOP).select("level", "digest").limit(2).collect()  # the root is all that is left
    root = top[0].digest if len(top) == 1 else None
    nodes = tables[0].where("open")
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    nodes = nodes.select("tree", "level", "index", "digest").distinct()
    asked = both.where("digest IS NULL").select("part", "tree", "level", "index").join(nodes, ["tree", "level", "index"])
    told = asked.select("part", F.lit(None).cast(meta.schema["group"].dataType).alias("group"), "tree", F.col("index").alias("start"), F.lit(0).cast("long").alias("total"), "level", "digest")
    told = told.unionByName(meta.select("*", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("digest")))

    def down(rows: pa.Table, told: pa.Table) -> pa.Table:
        is_meta = pc.is_null(told["digest"])
        known: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, index, value in zip(*(told.filter(pc.invert(is_meta))[c].to_pylist() for c in ("tree", "level", "start", "digest")), strict=True):
            known.setdefault(tree, {})[level, index] = value
        segments = list(_segments(rows, told.filter(is_meta), "group"))
        leaf, again, keys = (rows[c].to_pylist() for c in ("leaf", "again", "key"))
        inner = [(paths(start, [leaf[k] for k in at], total, known.get(tree, {})), at) for tree, start, total, at in segments]
        _, outer = paths(segments[0][0], [subroot for (subroot, _), _ in inner], n_trees, known.get(TOP, {})) if segments else (None, [])
        out = []
        for ((subroot, own), at), above in zip(inner, outer, strict=True):
            tail = "".join(siblings(above))
            for k, path in zip(at, own, strict=True):
                proof = digest("".join(siblings(path)) + tail)
                out.append((keys[k], leaf[k], subroot, proof, folded(folded(again[k] or leaf[k], path), above)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = (rows.schema.field("key").type, *[pa.string()] * 4)
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["key", "leaf", "subroot", "proof_sha256", "folded_root"])

    schema = f"key {leaves.schema['key'].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
    out = parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(down, schema)
    discard(leaves)
    return root, out.withColumnRenamed("key", key).withColumn("root", F.lit(root).cast("string"))


def proved_documents(docs: DataFrame) -> DataFrame:
    """Digest form: the proof of every document, folded after tampering with the ids
    whose crc32 7 divides."""
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0
    _, out = manifest(docs, tampered=tampered)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(text(n if f == "n_chars" else f) for f in FIELDS) + ")"
    up = lambda t, by: f"SELECT {by}level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY {by}level, i // 2, n"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf("n_chars")} AS leaf,
   CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("CAST(n_chars AS HUGEINT) + 1")} END AS again FROM documents),
 e AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
 a(g, level, i, h, n) AS (SELECT g, 0, i, leaf, n FROM e UNION ALL {up("a", "g, ")}),
 s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
 b(level, i, h, n) AS (SELECT 0, i, h, n FROM s UNION ALL {up("b", "")}),
 t AS (SELECT g, level, i, h, n, level AS place FROM a UNION ALL SELECT NULL, level, i, h, n, 1000 + level FROM b),
 p AS (SELECT e.r, string_agg(t.h, '' ORDER BY place) AS proof FROM e JOIN s USING (g) JOIN t
   ON (t.g = e.g AND t.i = xor(e.i >> t.level, 1::BIGINT)) OR (t.g IS NULL AND t.i = xor(s.i >> t.level, 1::BIGINT)) WHERE t.n > 1 GROUP BY e.r),
 f(r, g, level, i, h, n) AS (SELECT r, g, 0, i, coalesce(again, leaf), n FROM e
   UNION ALL SELECT f.r, f.g, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), (f.n + 1) // 2
   FROM f LEFT JOIN a AS t ON t.g = f.g AND t.level = f.level AND t.i = xor(f.i, 1::BIGINT) WHERE f.n > 1),
 k(r, level, i, h, n) AS (SELECT r, 0, s.i, f.h, s.n FROM f JOIN s USING (g) WHERE f.n = 1
   UNION ALL SELECT k.r, k.level + 1, k.i // 2, sha256(CASE WHEN k.i % 2 = 1 THEN t.h || k.h ELSE k.h || coalesce(t.h, '') END), (k.n + 1) // 2
   FROM k LEFT JOIN b AS t ON t.level = k.level AND t.i = xor(k.i, 1::BIGINT) WHERE k.n > 1),
 z AS (SELECT h FROM b WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, z.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, k.h AS folded_root, k.h = z.h AS verified
FROM e JOIN s USING (g) JOIN k ON k.r = e.r AND k.n = 1 LEFT JOIN p ON p.r = e.r CROSS JOIN z
"""


SQL = _sql()
