"""Merkle manifest of a dataset, and what a tampered row would make of it.

Every row is a leaf, hashed where it is read, so that no text leaves its task.  The leaves of a source ascend by identifier; every three
consecutive nodes become one until one is left, the source's root, and the sources' roots, in the order of their names, become the root
of the dataset in the same way.

A tree is built in aligned blocks of 3^7 nodes: a block is one piece of work however many leaves a source has, its root
is a node of the tree above, and that tree is built in the same way.  Inside a block the tree is persistent: nodes are never
changed, and a tampered leaf makes a *version* that copies the leaf's ancestors (seven at most) and shares every other node with the
tree it came from.  What the version's root would change further up is continued where the block is: each
block gets the siblings of its own way up, once, whatever the number of versions, so no task sees all versions of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, materialise, shuffle_partitions, table

#: Children of a node, and levels of a block: 2,187 nodes.
FAN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node of a tree: tree, place in it, the number of nodes that the tree has on this level, digest.
PATH = "tree string, place long, up binary, top string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """A persistent tree over the digests of one block.

    Nodes are numbers; ``digest``, ``children`` and ``level`` of a node never change.  A version is the number of its root.
    """

    def __init__(self, leaves: list[str], levels: int | None):
        """``levels`` is how often nodes are joined, or None: until one is left."""
        self.digest, self.children = list(leaves), [()] * len(leaves)
        self.rows = [list(range(len(leaves)))]
        while len(self.rows[-1]) > 1 if levels is None else len(self.rows) <= levels:
            below = self.rows[-1]
            self.rows.append([self._join(tuple(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        self.root = self.rows[-1][0]

    def _join(self, children: tuple[int, ...]) -> int:
        self.children.append(children)
        self.digest.append(_hash("".join([self.digest[c] for c in children])))
        return len(self.digest) - 1

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """What stands left and right of the leaf's ancestors in their runs, level by level."""
        found, i = [], leaf
        for row in self.rows[:-1]:
            begin = i - i % FAN
            run = [self.digest[n] for n in row[begin : begin + FAN]]
            found.append(("".join(run[: i - begin]), "".join(run[i - begin + 1 :])))
            i //= FAN
        return found

    def with_leaf(self, leaf: int, digest: str) -> int:
        """The root of a version with another leaf: its ancestors are copied, all other nodes shared."""
        self.digest.append(digest)
        self.children.append(())
        node, i = len(self.digest) - 1, leaf
        for row in self.rows[1:]:
            old = self.children[row[i // FAN]]
            node = self._join(tuple(node if k == i % FAN else c for k, c in enumerate(old)))
            i //= FAN
        return node

    def drop_versions(self) -> None:
        """Forget the nodes that versions copied; those of the tree itself come before them."""
        del self.digest[self.root + 1 :], self.children[self.root + 1 :]


def pack(siblings: list[tuple[str, str]]) -> bytes:
    """Left and right digests of each level as two counts and the digests' bytes."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex(a + b) for a, b in siblings)


def unpack(data: bytes) -> list[tuple[str, str]]:
    found, i = [], 0
    while i < len(data):
        a, b = data[i], data[i + 1]
        left, right = i + 2 + 32 * a, i + 2 + 32 * (a + b)
        found.append((data[i + 2 : left].hex(), data[left:right].hex()))
        i = right
    return found


def fold(digest: str, siblings: list[tuple[str, str]]) -> str:
    for left, right in siblings:
        digest = _hash(left + digest + right)
    return digest


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in their first ``width`` columns (a block and its way up: bounded)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _levels(n: int, levels: int) -> int | None:
    """A block of a tree with more than one block is joined all the way; a lone block until one node is left."""
    return levels if n > FAN**levels else None


def _roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Roots of blocks: rows are tree, block, place, n, digest by block and place."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def found():
        for (tree, block), rows in _groups(batches, 2):
            t = Tree([r[4] for r in rows], _levels(rows[0][3], levels))
            yield tree, block, -(-rows[0][3] // FAN**levels), t.digest[t.root]

    yield from _batched(found(), schema)


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Ways up of nodes: rows are tree, block, place, n, digest, up, top; the first of a block may be its own way up (place -1)."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("up", pa.binary()), ("top", pa.string())])

    def found():
        for (tree, _), rows in _groups(batches, 2):
            above, top = (rows[0][5], rows[0][6]) if rows[0][2] < 0 else (b"", None)
            rows = [r for r in rows if r[2] >= 0]
            t = Tree([r[4] for r in rows], _levels(rows[0][3], levels))
            for i, r in enumerate(rows):
                yield tree, r[2], pack(t.siblings(i)) + above, top or t.digest[t.root]

    yield from _batched(found(), schema)


def _block(place, levels: int):
    return F.floor(place / FAN**levels).cast("long")


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, place, n, digest of the level of block roots above nodes (tree, place, n, digest)."""
    rows = nodes.select("tree", _block(F.col("place"), levels).alias("block"), "place", "n", "digest")
    dealt = rows.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "place")
    return dealt.mapInArrow(lambda batches: _roots(batches, levels), "tree string, place long, n long, digest string")


def ways_up(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, up, top) of all nodes: packed siblings from the node to its tree's root, and that root.

    A tree of more than one block continues above: the roots of its blocks are nodes of a tree that is a 2,187th as large.
    """
    nodes = materialise(nodes)
    rows = nodes.select("tree", _block(F.col("place"), levels).alias("block"), "place", "n", "digest", F.lit(None).cast("binary").alias("up"), F.lit(None).cast("string").alias("top"))
    large = nodes.filter(F.col("n") > FAN**levels)
    if not large.isEmpty():
        above = ways_up(block_roots(large, levels), levels)
        rows = rows.unionByName(above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "up", "top"))
    dealt = rows.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "place")
    return dealt.mapInArrow(lambda batches: _paths(batches, levels), PATH)


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows with their place (from 0) in their tree, and n, the rows that the tree has.

    Rows are sorted by range, not by tree, so a tree that holds most of all rows is many tasks' work; of each task and tree only
    a count is accumulated.
    """
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(shuffle_partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    at = materialise(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    each = at.groupBy(F.col(tree).alias("__t"), part.alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__t").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(each.select("__t", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(W.partitionBy("__t")).alias("n")))
    both = at.join(bounded(starts), F.col(tree).eqNullSafe(F.col("__t")) & (part == F.col("__p")))
    return both.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__t", "__p", "__shift")


def _proofs(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Proofs of leaves: rows are tree, block, place, n, id, leaf, other, up, subroot, above, root; a block's way up comes first."""
    schema = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def found():
        for _, rows in _groups(batches, 2):
            _, _, _, _, _, _, _, up, subroot, above, root = rows[0]
            leaves = [r for r in rows if r[2] >= 0]
            higher = unpack(up) + unpack(above)
            tail = "".join(a + b for a, b in higher)
            t = Tree([r[5] for r in leaves], _levels(leaves[0][3], levels))
            whole = fold(t.digest[t.root], higher)
            for i, r in enumerate(leaves):
                proof = _hash("".join([a + b for a, b in t.siblings(i)]) + tail)
                folded = whole
                if r[6] is not None:
                    folded = fold(t.digest[t.with_leaf(i, r[6])], higher)
                    t.drop_versions()
                yield r[4], r[5], subroot, root, proof, folded

    yield from _batched(found(), schema)


def leaf(columns: list) -> F.Column:
    """SHA-256 of the columns, each "-" if null, else its number of UTF-8 bytes, a colon and itself."""
    each = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def manifest(df: DataFrame, tampered: F.Column, text: F.Column, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """Leaves, roots and proofs of a table, and the root that each row would fold to if, where ``tampered``, ``text`` stood in its text column.

    One row for each row of ``df``: id, leaf, subroot (of its source), root, proof_sha256 (of the leaf's siblings up to the root),
    folded_root, verified.  Sources ascend bytewise, null first; rows of a source by id, null first, rows that repeat an id by leaf, then by
    tampered leaf.  Null and empty texts differ.  An empty table gives an empty result; columns that aren't ``fields`` are ignored.
    """
    strings = {c: F.col(c).cast("string") for c in fields}
    own, other = leaf(list(strings.values())), leaf([text.cast("string") if c == text_col else x for c, x in strings.items()])
    # a null source is a tree of its own, before the one with the empty name
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    thin = materialise(df.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), other).alias("other")))
    nodes = materialise(placed(thin, "tree", ["id", "leaf", "other"]))
    level = nodes.select("tree", "place", "n", F.col("leaf").alias("digest"))
    ups = ways_up(block_roots(level, levels), levels)  # of blocks, up to the source's root
    ups = materialise(ups)
    roots = ups.filter("place = 0").select(F.col("tree").alias("name"), F.col("top").alias("digest"), F.lit("").alias("tree"))
    roots = materialise(placed(roots, "tree", ["name"]))
    higher = ways_up(roots.select("tree", "place", "n", "digest"), levels).select(F.col("place").alias("__place"), F.col("up").alias("above"), F.col("top").alias("root"))
    of_source = materialise(roots.join(bounded(materialise(higher)), F.col("place") == F.col("__place")).select(F.col("name").alias("__name"), "above", "root"))
    none, long = (lambda kind, name: F.lit(None).cast(kind).alias(name)), F.lit(-1).cast("long")
    heads = ups.join(bounded(of_source), F.col("tree") == F.col("__name")).select("tree", F.col("place").alias("block"), long.alias("place"), long.alias("n"), none("long", "id"), none("string", "leaf"), none("string", "other"), "up", F.col("top").alias("subroot"), "above", "root")
    rows = nodes.select("tree", _block(F.col("place"), levels).alias("block"), "place", "n", "id", "leaf", "other", none("binary", "up"), none("string", "subroot"), none("binary", "above"), none("string", "root"))
    dealt = rows.unionByName(heads).repartition(shuffle_partitions(df.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "place")
    found = dealt.mapInArrow(lambda batches: _proofs(batches, levels), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in FIELDS) + ")"


def _climb(name: str, base: str) -> str:
    """Levels above the nodes of ``base``, and the runs of three of each."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, place, n, h FROM {base} UNION ALL
  SELECT tree, lvl + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // 3, n),
{name}_runs AS (SELECT tree, lvl, place // 3 AS run, list(h ORDER BY place) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


_LEFT, _RIGHT = "array_to_string(hs[1:CAST(place % 3 AS INT)], '')", "array_to_string(hs[CAST(place % 3 AS INT) + 2:], '')"


def _walk(name: str, base: str, runs: str) -> str:
    return f"""{name} AS (SELECT k, tree, 0 AS lvl, place, n, proof, folded FROM {base} UNION ALL
  SELECT k, p.tree, p.lvl + 1, place // 3, (n + 2) // 3, proof || {_LEFT} || {_RIGHT}, sha256({_LEFT} || folded || {_RIGHT}) FROM {name} p JOIN {runs} r ON p.tree = r.tree AND p.lvl = r.lvl AND place // 3 = run WHERE n > 1)"""


#: DuckDB has no crc32: it is worked out from its polynomial, byte by byte.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [n::UBIGINT for n in range(8)]), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"

SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({_CRC.format("doc_id")}, 4294967295::UBIGINT) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
leaves AS (SELECT *, leaf AS h, row_number() OVER () AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_climb("low", "leaves")},
sources AS (SELECT tree AS name, h, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
{_climb("high", "sources")},
b AS (SELECT k, tree, place, n, '' AS proof, coalesce(other, leaf) AS folded FROM leaves),
{_walk("p", "b", "low_runs")},
c AS (SELECT k, s.tree, s.place, s.n, proof, folded FROM p JOIN sources s ON p.tree = s.name WHERE p.n = 1),
{_walk("q", "c", "high_runs")}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM leaves l JOIN sources s ON l.tree = s.name JOIN q ON q.k = l.k AND q.n = 1 JOIN high r ON r.n = 1
"""
