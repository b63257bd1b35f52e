"""Near-duplicates by a chosen-path set similarity join.

1. A text becomes its set of word shingles and 64 minwise values of it.  Rows with equal sets are one *class* (a hot group
   of copies is one row from here on).
2. Trees: at the root of each tree a class follows its minwise values at two positions of the tree's own, at each deeper node
   the value at a position that the node's hash chooses.  Two sets of similarity s stay together at a step with
   probability s; see ``TREES`` for what is missed.  Nodes of up to ``NODE`` classes are compared exhaustively on minwise values; larger nodes
   branch on, and what is still together after ``DEPTH`` tokens is passed on as one group.  A few trees go first; what they
   join has one label from then on, and the other trees look for links between different labels alone, so that a
   hot group of near copies doesn't give a link for each member and tree.
3. Components of those candidate links are *clusters*: every link lies within one.  Each cluster is resolved exactly on
   full shingle sets.  A small cluster is compared exhaustively in one task.  A large one (a hot group of near copies) is
   dealt into blocks that are joined up in themselves; one hub of each joined part goes to the next level, until a cluster is
   one block; at last the classes outside a cluster's largest part are compared with its other classes: with all of them,
   block by block, where they are few, else with those that they meet in a node of the trees.  So no task holds a cluster,
   the rows compared grow with the classes, and pairs that are joined already are neither compared nor emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fewer, materialise, shuffle_partitions, slices, table
from .components import connected_components
from .shingles import SIGNATURE, alike, linked, mixed, shingle_sets, signature

#: Trees that go first; tokens after which the nodes of the last comparison are cut into blocks.
FIRST, DEEP = 2, 8
#: With 2 * TREES paths a link of similarity s is missed with about (1 - s ** 2) ** (2 * TREES) where nodes of the second level
#: are small, and (1 - s ** 3) ** (2 * TREES) where they are larger than NODE; the spread of 64 values comes on top.
#: Trees, tokens after which a node is passed on, classes of a node that are compared, classes of a block.
TREES, DEPTH, NODE, BLOCK = 10, 3, 256, 256
#: Thin rows of a partition.
ROWS = 400_000


def _sketches(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, sigs = [], [], []
            for s in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                # the low halves tell different values apart as well as candidates need
                sigs.append(signature(s).astype(np.uint16).tobytes() if len(s) else None)
            columns = [batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, sigs))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "n", "class", "sig"])

    return work


def _tokens(sig: pa.Array) -> np.ndarray:
    joined = b"".join(sig.to_pylist())
    values = np.frombuffer(joined, f"<u{len(joined) // (len(sig) * SIGNATURE)}").reshape(-1, SIGNATURE).astype(np.uint64)
    return mixed(values | (np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)))


def _follow(path: np.ndarray, tokens: np.ndarray, position: int | None = None) -> np.ndarray:
    """The child of each row's node: by its token at the given position, or at the one that the node chooses."""
    pick = mixed(path) % np.uint64(SIGNATURE) if position is None else position % SIGNATURE
    return mixed(path * np.uint64(3) + tokens[np.arange(len(path)), pick])


def _beside(batch: pa.RecordBatch, path: np.ndarray) -> pa.RecordBatch:
    """The batch with a path in place of its minwise values."""
    names = [c for c in batch.schema.names if c not in ("sig", "path")]
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(batch.column(c) for c in names)], ["path", *names])


def _plant(trees: int | range):
    """The nodes of the second level that each row comes to: two in each tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens, n = _tokens(batch.column("sig")), batch.num_rows
                for tree in range(trees) if isinstance(trees, int) else trees:
                    root = mixed(np.full(n, tree + 1, np.uint64))
                    for nth in (0, 1):
                        yield _beside(batch, _follow(_follow(root, tokens, 2 * tree + nth), tokens))

    return work


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            yield _beside(batch, _follow(path, _tokens(batch.column("sig"))))


class Parts:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by their keys, as tables of one or more groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.array([x == v.as_py() for x in batch.column(k).to_pylist()])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        opened = bool(held) and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] == [v.as_py() for v in last]
        if cut or not opened:
            done = [*held, *([batch.slice(0, cut)] if cut else [])]
            if done:
                yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(t: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    rows = list(zip(*(t[k].to_pylist() for k in keys), strict=True))
    first = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
    return zip(first, first[1:], strict=False)


def _compare_nodes(least: int):
    """Links (a, b) between different labels within small nodes: each joined part as a star."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["path"]):
            path, label = t["path"].to_numpy(), t["label"].to_numpy()
            mini = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SIGNATURE)
            parts, step = None, 1
            left = np.arange(len(path))
            while True:
                left = left[left + step < len(path)]
                left = left[path[left] == path[left + step]]
                if not len(left):
                    break
                asked = left[label[left] != label[left + step]]
                for at in range(0, len(asked), 65_536):
                    own = asked[at : at + 65_536]
                    hit = own[(mini[own] == mini[own + step]).sum(1) >= least]
                    if len(hit):
                        parts = parts or Parts(len(path))
                        for i in hit.tolist():
                            parts.join(i, i + step)
                step += 1
            if parts:
                pairs = {(int(label[r]), int(label[i])) for i in range(len(path)) if (r := parts.find(i)) != i}
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def _full_sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "members", "class")), pa.array(sets, pa.binary())], ["cluster", "members", "class", "shingles"])

    return work


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _parts(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Joined parts of a few sets, the member with the most links first."""
    if len(sets) <= 6:
        like = np.array([[i == j or alike(x, y, percent) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    else:
        like = linked(sets, percent)
    out, open_ = [], np.ones(len(sets), bool)
    for hub in np.argsort(-like.sum(1), kind="stable").tolist():
        if open_[hub]:
            part, front = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
            part[hub] = front[hub] = True
            while front.any():
                front = like[front].any(0) & ~part
                part |= front
            open_ &= ~part
            part[hub] = False
            out.append([hub, *np.flatnonzero(part).tolist()])
    return out


def _join_up(percent: int, keys: list[str]):
    """Verified links of each group: a star around the hub of each joined part, hubs linked to themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            sets, classes = _sets(t["shingles"]), t["class"].to_pylist()
            out = [(classes[a + p[0]], classes[a + j]) for a, b in _cuts(t, keys) for p in _parts(sets[a:b], percent) for j in p]
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    return work


def _cross(percent: int, keys: list[str]):
    """Verified links between the askers and the members of a block that belong to other parts: one for each asker and part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            sets, classes, part, asks = _sets(t["shingles"]), t["class"].to_pylist(), t["label"].to_pylist(), np.array(t["asks"].to_pylist(), bool)
            out = []
            for a, b in _cuts(t, keys):
                own, asking = a + np.flatnonzero(~asks[a:b]), a + np.flatnonzero(asks[a:b])
                if not len(own) or not len(asking):
                    continue
                like = linked([sets[i] for i in asking], percent, [sets[j] for j in own])
                met = set()
                for i, j in zip(*np.nonzero(like), strict=True):
                    i, j = asking[i], own[j]
                    if part[i] != part[j] and (i, part[j]) not in met:
                        met.add((i, part[j]))
                        out.append((classes[i], classes[j]))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    return work


PAIR = "a binary, b binary"


def _dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """Deal by keys to as many partitions as the rows ask for."""
    return fewer(df.repartition(max(shuffle_partitions(df.sparkSession), -(-rows // each)), *keys), rows, each)


def _nodes(rows: DataFrame, sigs: DataFrame, key: str, n_rows: int, deep: int, most: int):
    """Nodes that hold different labels, level by level: (rows with their node's size and least label, sizes, whether the level is the last).

    ``rows``: (path, key, label) of the second level; nodes of more than ``most`` rows branch on up to ``deep`` tokens.
    """
    for depth in range(2, deep + 1):
        rows = rows if depth == 2 else materialise(fewer(rows, n_rows, ROWS))
        sizes = rows.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("last"))
        sizes = materialise(fewer(sizes.filter("size > 1 AND least <> last").drop("last"), n_rows, ROWS))
        met = rows.join(sizes, F.col("path") == F.col("p")).drop("p")
        over = sizes.filter(F.col("size") > most).isEmpty()
        yield met, over or depth == deep
        if over:
            return
        rows = met.filter(F.col("size") > most).select("path", key, "label").join(sigs, key).select("path", key, "label", "sig").mapInArrow(_branch, f"path long, {key} {dict(sigs.dtypes)[key]}, label {dict(rows.dtypes)['label']}")


def candidate_links(classes: DataFrame, percent: int, trees: int | range = TREES) -> DataFrame:
    """Candidate links (a, b) between different labels of classes (key, label, sig) by the chosen-path trees."""
    j = percent / 100
    least = int(SIGNATURE * (j - 4.2 * (j * (1 - j) / SIGNATURE) ** 0.5))
    n_rows, links = 2 * (trees if isinstance(trees, int) else len(trees)) * classes.count(), None
    planted = classes.select("key", "label", "sig").mapInArrow(_plant(trees), "path long, key long, label long")
    for met, last in _nodes(planted, classes.select("key", "sig"), "key", n_rows, DEPTH, NODE):
        small = met.filter(F.col("size") <= NODE).select("path", "key", "label").join(classes.select("key", "sig"), "key")
        found = _dealt(small, n_rows, ROWS // 4, "path").sortWithinPartitions("path", "label").select("path", "label", "sig").mapInArrow(_compare_nodes(least), "a long, b long")
        links = found if links is None else links.union(found)
        if last:
            links = links.union(met.filter(F.col("size") > NODE).select(F.col("least").alias("a"), F.col("label").alias("b")))
    return materialise(fewer(links.filter("a <> b").distinct(), n_rows, ROWS))


def candidate_clusters(classes: DataFrame, percent: int, trees: int = TREES) -> DataFrame:
    """(key, cluster, members) of the classes (key, sig) that candidate links join, a cluster being named by its smallest key.

    The first trees' links are components before the others grow: these see labels, and most of a hot group has one.
    """
    first = min(FIRST, trees)
    labelled = classes.withColumn("label", F.col("key"))
    for own in (range(first), range(first, trees)):
        parts = connected_components(candidate_links(labelled, percent, own)).withColumnRenamed("label", "part")
        joined = labelled.join(parts, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("part", "label"))
        labelled = materialise(joined.select("key", "label", "sig") if own.start == 0 else joined.select("key", "label"))
    sizes = labelled.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("members")).filter("members > 1")
    return labelled.join(sizes, F.col("label") == F.col("cluster")).select("key", "cluster", "members")


def _resolve_large(members: DataFrame, sigs: DataFrame, percent: int, trees: int) -> DataFrame:
    """Verified links of large clusters, given (cluster, members, class, shingles), and minwise values (class, sig)."""
    keys = ["cluster", "block"]

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / BLOCK)))

    rows, links, n_rows = members, None, members.count()
    while True:
        dealt = _dealt(blocked(rows), n_rows, 4 * BLOCK, *keys).sortWithinPartitions(*keys, "class").select(*keys, "class", "shingles")
        found = materialise(dealt.mapInArrow(_join_up(percent, keys), PAIR))
        links = found if links is None else links.union(found)
        if rows.filter(F.col("members") > BLOCK).isEmpty():
            break
        hubs = rows.join(found.select("a").distinct(), F.col("class") == F.col("a"), "left_semi")
        sizes = hubs.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("hubs"))
        nxt = materialise(hubs.join(sizes, F.col("cluster") == F.col("c")).select("cluster", F.col("hubs").alias("now"), F.col("members").alias("before"), "class", "shingles"))
        # a cluster whose parts don't get fewer is left to the last comparison
        rows = nxt.filter("now < before").select("cluster", F.col("now").alias("members"), "class", "shingles")
        if rows.isEmpty():
            break
    parts = connected_components(links)
    thin = materialise(members.select("cluster", "class").join(parts, F.col("class") == F.col("node")).select("cluster", "class", "label"))
    units = _units(thin, sigs, trees)
    if units is None:
        return links
    sizes = units.groupBy("unit", "label").agg(F.count("*").alias("size"))
    most = sizes.groupBy(F.col("unit").alias("u")).agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"))
    most = most.select("u", F.col("top.label").alias("top"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("chunks"))
    several = units.join(most, F.col("unit") == F.col("u")).drop("u").join(members.select(F.col("class").alias("k"), "shingles"), F.col("class") == F.col("k")).drop("k")
    own = ["unit", "class", "shingles", "label"]
    asking = several.filter("label <> top").select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("class"), "chunks").alias("chunk"), F.lit(True).alias("asks"))
    asked = several.select(*own, F.pmod(F.xxhash64("class"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"))
    unit = ["unit", "block", "chunk"]
    dealt = _dealt(asking.unionByName(asked), units.count(), 4 * BLOCK, *unit).sortWithinPartitions(*unit, "asks", "class").select(*unit, "class", "shingles", "label", "asks")
    return links.union(dealt.mapInArrow(_cross(percent, unit), PAIR))


def _units(thin: DataFrame, sigs: DataFrame, trees: int) -> DataFrame | None:
    """(unit, class, label): classes that meet in the last comparison, given (cluster, class, label); None if all clusters have one part.

    A cluster with few classes outside its largest part is one unit; in the others the nodes of the trees are units, so that
    there are ``2 * trees`` rows of a class at most.
    """
    sizes = thin.groupBy("cluster", "label").agg(F.count("*").alias("size")).groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("parts"), (F.sum("size") - F.max("size")).alias("outside"))
    open_ = materialise(thin.join(sizes.filter("parts > 1"), F.col("cluster") == F.col("c")).select("cluster", "class", "label", (F.col("outside") <= trees * BLOCK).alias("whole")))
    if open_.isEmpty():
        return None
    units = open_.filter("whole").select(F.xxhash64("cluster").alias("unit"), "class", "label")
    many = open_.filter("NOT whole").select("class", "label")
    n_rows = 2 * trees * many.count()
    if n_rows:
        planted = many.join(sigs, "class").select("class", "label", "sig").mapInArrow(_plant(trees), "path long, class binary, label binary")
        for met, last in _nodes(planted, sigs, "class", n_rows, DEEP, NODE):
            units = units.union((met if last else met.filter(F.col("size") <= NODE)).select("path", "class", "label"))
    return materialise(units)


def _resolved(docs: DataFrame, k: int, percent: int, text_col: str, id_col: str, trees: int) -> DataFrame:
    """One row for each row of ``docs``: id, h, n, class (null without shingles), component_id, and whether (id, h) stays in its component."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(texts.mapInArrow(_sketches(k), "id long, h long, n long, class binary, sig binary"))
    known = rows.filter("class IS NOT NULL").withColumn("one", F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    n_rows = rows.count()
    classes = materialise(fewer(known.groupBy("class").agg(F.min("one").alias("one"), F.first("sig").alias("sig")).withColumn("key", F.xxhash64("class")), n_rows, ROWS // 8))
    clusters = candidate_clusters(classes.select("key", "sig"), percent, trees)
    wanted = materialise(clusters.join(classes.select("key", "class", "one"), "key").select("cluster", "members", "class", F.col("one.id").alias("w_id"), F.col("one.h").alias("w_h")))
    # one row for each class: rows that repeat id and text have the same class
    fetched = texts.join(bounded(wanted), (F.col("h") == F.col("w_h")) & F.col("id").eqNullSafe(F.col("w_id"))).select("cluster", "members", "class", "text")
    members = fetched.mapInArrow(_full_sets(k), "cluster long, members long, class binary, shingles binary")
    members = materialise(fewer(members.dropDuplicates(["class"]), n_rows, ROWS // 40))
    small = _dealt(members.filter(F.col("members") <= BLOCK), n_rows, ROWS // 40, "cluster").sortWithinPartitions("cluster", "class").select("cluster", "class", "shingles")
    links = small.mapInArrow(_join_up(percent, ["cluster"]), PAIR)
    large = members.filter(F.col("members") > BLOCK)
    parts = links.select(F.col("a").alias("label"), F.col("b").alias("node"))
    if not large.isEmpty():
        parts = parts.unionByName(connected_components(_resolve_large(materialise(large), classes.select("class", "sig"), percent, trees)).select("label", "node"))
    joined = materialise(parts.join(classes.select("class", "one"), F.col("node") == F.col("class")).select("label", "node", "one"))
    firsts = joined.groupBy(F.col("label").alias("l")).agg(F.min("one").alias("first"))
    linked_ = joined.join(firsts, F.col("label") == F.col("l")).select("node", "first")
    of_class = classes.join(linked_, F.col("class") == F.col("node"), "left").select(F.col("class").alias("k"), F.coalesce("first", "one").alias("first"))
    out = rows.select("id", "h", "n", "class").join(of_class, F.col("class") == F.col("k"), "left")
    stays = F.col("class").isNull() | (F.struct(F.col("id").isNull().alias("none"), "id", "h").eqNullSafe(F.col("first")))
    return out.select("id", "h", "n", "class", F.coalesce("first.id", "id").alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", trees: int = TREES) -> DataFrame:
    """Components of documents with 100 * intersection >= percent * union of their ``k``-word shingle sets.

    One row for each row of ``docs``: id_col, ``h`` (hash of the text), n_shingles, component_id (smallest id in the
    component, nulls left aside), kept (id = component_id).  Words are lower-cased (A-Z) runs without white space; a text of
    fewer than ``k`` words is one shingle; null and blank texts have none and are components of their own.  Of rows that
    repeat the smallest id all are marked kept, as are all rows of a component without ids.  Other columns are ignored; an empty
    table gives an empty result.
    """
    out = _resolved(docs, k, percent, text_col, id_col, trees)
    return out.select(F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, of several with it the one whose text has
    the smallest hash.  All columns are kept, whatever their names.

    Null ids come after all others.  Rows that repeat the id and the text that stay are one document: one row of them stays (the one whose
    columns have the smallest hash).  Rows without shingles (null and blank texts) all stay.  An empty table gives an empty result.
    """
    found = _resolved(docs, k, percent, text_col, id_col, TREES)
    thin = materialise(found.filter("class IS NOT NULL").groupBy("id", "h", "stays").agg(F.count("*").alias("copies")).filter("NOT stays OR copies > 1").select(F.col("id").alias("t_id"), F.col("h").alias("t_h"), "stays"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*every).alias("d"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))
    marked = keyed.join(bounded(thin), (F.col("h") == F.col("t_h")) & F.col("id").eqNullSafe(F.col("t_id")), "left").filter("stays IS NULL OR stays")
    lone = marked.filter("stays IS NULL").select("d")
    # a row for each task and key is all that is shuffled of a hot group of repeated rows
    one = marked.filter("stays").groupBy("id", "h").agg(F.min_by("d", F.xxhash64(F.col("d").cast("string"))).alias("d")).select("d")
    return lone.union(one).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("h")
