"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers of all items (no match crosses two items).  Each document's words stream
through it once; at every word the length of the longest match that ends there is known.  Where it reaches the window
length, the window's words are hit; items shorter than the window count as a whole.  Words outside the items' vocabulary
break every match, so only runs of known words that are long enough to hold a window are streamed.

The benchmark is measured first.  Up to ``max_words`` words it becomes one automaton, which is sent to the tasks (some 800 bytes a
word in each Python worker).  A larger one is dealt by hash into blocks under that bound.  The documents are then written once and that copy is read twice, whatever
the number of blocks: a bitmap of all windows' hashes tells which of a document's words may lie in a window, and of which blocks.
These stretches of words alone go to the blocks, whose automata they stream through; the bytes, not the number, of a block's stretches make
the parts in which it is met, so that a passage that many documents hold is no hot task.  The bitmap has at most ``FILTER`` bits;
a fuller one lets more stretches through in vain, but none is lost.  Long items are cut into pieces that overlap by a window less one word, and pieces
that repeat are one piece of several items, so that no item and no hot group of items makes a block larger.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_UPPER, materialise, slices, table
from .shingles import mixed, word_numbers

WINDOW = 13
#: Words of a piece of an item.
PIECE = 4096
#: Most bits of the bitmap of windows (64 MB), bits of one of its slices, and bytes of stretches that meet a block in one task.
FILTER, SLICE, PART = 1 << 29, 1 << 20, 8_000_000
#: Words are maximal runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased: all other bytes become spaces.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Automaton:
    """Longest matches against a set of items, and which items' windows they hold."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        """``items``: (item, words); a list or tuple in place of an item is several items with the same words."""
        self.window = window
        self.names = [i if isinstance(i, (list, tuple)) else (i,) for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: dict[tuple[int, ...], set[int]] = {}  # the places of the items of each window
        for place, (_, words) in enumerate(items):
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                self.owners.setdefault(tuple(ids[i : i + size]), set()).add(place)
        self.sizes = sorted({len(w) for w in self.owners})
        self.shortest = self.sizes[0] if self.sizes else 0

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with occurring windows."""
        hit = np.zeros(len(words), bool)
        found: set[int] = set()
        if not self.sizes or len(words) < self.shortest:
            return hit, found
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, ids != 0, False]))
        for a, b in edges.reshape(-1, 2):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), hit[a:b], found)
        return hit, {name for place in found for name in self.names[place]}

    def _stream(self, ids: list[int], hit: np.ndarray, found: set) -> None:
        nxt, link, length = self.next, self.link, self.length
        state = longest = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                longest = length[state]
            state = nxt[state].get(c, 0)
            longest = longest + 1 if state else 0
            for size in self.sizes:
                if size > longest:
                    break
                owners = self.owners.get(tuple(ids[i - size + 1 : i + 1]))
                if owners:
                    hit[i - size + 1 : i + 1] = True
                    found |= owners


_built: dict[bytes, Automaton] = {}


def _automaton(key: bytes, items: list, window: int) -> Automaton:
    """The automaton, built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


MARKS = ("hits", "items", "n_words", "n_hit")


def _with_marks(batch: pa.RecordBatch, names: list[str], marks: list[tuple]) -> pa.RecordBatch:
    """The named columns, and of each row the hit words, its items and its number of words."""
    bits = [np.packbits(hit).tobytes() if hit.any() else None for hit, _, _ in marks]
    columns = [pa.array(bits, pa.binary()), pa.array([sorted(items) for _, items, _ in marks], pa.list_(pa.string())), pa.array([n for _, _, n in marks], pa.int64()), pa.array([int(hit.sum()) for hit, _, _ in marks], pa.int64())]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *MARKS])


def _marks(key: bytes, sent, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, sent.value, window)
        for batch in slices(batches):
            texts = map(words_of, batch.column("text").cast(pa.binary()).to_pylist())
            yield _with_marks(batch, ["doc", "text"], [(*automaton.match(w), len(w)) for w in texts])

    return work


def _hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of so many words."""
    out = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)])
    return out


def _of_block(hashes: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """What stands in the bitmap for windows of a block."""
    return mixed(hashes + (np.asarray(block).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = ((bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 for x in _places(keys, 8 * len(bitmap)))
    return (a & b).astype(bool)


def _runs(texts: list[bytes], sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of normalised texts: place of the first text, size of the windows, their texts (from the first one), first words and hashes."""
    for first, counts, words in word_numbers(texts):
        cut = np.r_[0, np.cumsum(counts)]
        for size in sizes:
            hashes = _hashes(words, size)
            at = np.arange(len(hashes))
            owner = np.searchsorted(cut, at, side="right") - 1
            inside = at + size <= cut[owner + 1]
            yield first, size, owner[inside], (at - cut[owner])[inside], hashes[inside]


def _bits(bits: int, size: int, window: int):
    """The places in the bitmap of a piece's windows, by themselves and as windows of its block, by slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, own, blocks = batch.column("piece").to_pylist(), np.minimum(batch.column("words").to_numpy(), window), batch.column("block").to_numpy()
            found = [np.zeros(0, np.uint64)]
            for first, words, owner, _, hashes in _runs(pieces, sorted({int(x) for x in own})):
                fits = own[first + owner] == words
                hashes, block = hashes[fits], blocks[first + owner[fits]]
                found += [x for keys in (hashes, _of_block(hashes, block)) for x in _places(keys, bits)]
            flat = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array((flat // np.uint64(size)).astype(np.int32)), pa.array((flat % np.uint64(size)).astype(np.int32))], ["slice", "bit"])

    return work


def _slice(size: int):
    def work(t: pa.Table) -> pa.Table:
        out = np.zeros(size, np.uint8)
        out[t["bit"].to_numpy()] = 1
        return pa.table([t["slice"].slice(0, 1), pa.array([np.packbits(out, bitorder="little").tobytes()])], ["slice", "bits"])

    return work


def _bitmap(pieces: DataFrame, total: int, window: int) -> bytes:
    """The bitmap of all windows; tasks make its slices, at most ``FILTER`` bits reach the driver."""
    bits = SLICE
    while bits < min(FILTER, 32 * total):
        bits *= 2
    places = pieces.select("piece", "words", "block").mapInArrow(_bits(bits, SLICE, window), "slice int, bit int").distinct()
    slices = {r["slice"]: bytes(r["bits"]) for r in places.groupBy("slice").applyInArrow(_slice(SLICE), "slice int, bits binary").toLocalIterator()}
    return b"".join(slices.get(i, bytes(SLICE // 8)) for i in range(bits // SLICE))


def _stretches(sent, sizes: list[int], blocks: int):
    """Rows (block, uid, at, words): a document's words from the place ``at`` that may lie in windows of a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            uids = batch.column("uid").to_pylist()
            texts = [(x or b"").translate(_TO_WORDS) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            met: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for first, size, owner, at, hashes in _runs(texts, sizes):
                some = np.flatnonzero(_held(bitmap, hashes))
                if not len(some):
                    continue
                owner, at, hashes = owner[some] + first, at[some].tolist(), hashes[some]
                for block in range(blocks):
                    for i in np.flatnonzero(_held(bitmap, _of_block(hashes, block))).tolist():
                        met.setdefault((int(owner[i]), block), []).append((at[i], at[i] + size))
            out: list[tuple] = []
            for (place, block), windows in sorted(met.items()):
                words, begin, end = texts[place].split(), -1, -1
                for a, b in [*sorted(windows), (1 << 62, 1 << 62)]:
                    if a > end:
                        if end > 0:
                            out.append((block, uids[place], begin, b" ".join(words[begin:end])))
                        begin, end = a, b
                    else:
                        end = max(end, b)
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "uid", "at", "words"])

    return work


def _met(window: int):
    """Stream stretches through the automaton of their block: uid, at, the hit words and the items."""

    def work(found: pa.Table, pieces: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if found.num_rows and pieces.num_rows:
            automaton = Automaton(sorted((tuple(items), piece.split()) for items, piece in zip(pieces["items"].to_pylist(), pieces["piece"].to_pylist(), strict=True)), window)
            for uid, at, words in zip(found["uid"].to_pylist(), found["at"].to_pylist(), found["words"].to_pylist(), strict=True):
                hit, items = automaton.match(words.split())
                if hit.any():
                    out.append((uid, at, np.packbits(hit).tobytes(), sorted(items)))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())), strict=True)], ["uid", "at", "bits", "items"])

    return work


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put what the blocks have found in a document's stretches together."""
    for batch in batches:
        marks = []
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True):
            n, items = len(words_of(text)), set()
            hit = np.zeros(n, bool)
            for one in found or ():
                own = np.unpackbits(np.frombuffer(one["bits"], np.uint8)).astype(bool)[: n - one["at"]]
                hit[one["at"] : one["at"] + len(own)] |= own
                items.update(one["items"])
            marks.append((hit, items, n))
        yield _with_marks(batch, ["doc", "text"], marks)


def _in_blocks(df: DataFrame, pieces: DataFrame, total: int, blocks: int, window: int) -> DataFrame:
    """As :func:`_marks` with automata of many blocks: the documents are written once, and only stretches meet the blocks."""
    pieces = materialise(pieces.select("piece", "words", "items", F.pmod("at", F.lit(blocks)).cast("int").alias("block")))
    sizes = sorted(r[0] for r in pieces.select(F.least("words", F.lit(window)).cast("int")).distinct().collect())  # at most ``window`` rows
    sent = df.sparkSession.sparkContext.broadcast(_bitmap(pieces, total, window))
    rows = materialise(df.withColumn("uid", F.monotonically_increasing_id()))
    found = materialise(rows.select("uid", "text").mapInArrow(_stretches(sent, sizes, blocks), "block int, uid long, at long, words binary"))
    parts = found.groupBy("block").agg(F.ceil(F.sum(F.length("words")) / PART).cast("int").alias("parts"))  # a row a block
    dealt = found.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("uid", "at"), "parts").cast("int")).drop("parts")
    own = pieces.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "items", "piece")
    met = dealt.groupBy("block", "part").cogroup(own.groupBy("block", "part")).applyInArrow(_met(window), "uid long, at long, bits binary, items array<string>")
    marked = rows.join(met.groupBy("uid").agg(F.collect_list(F.struct("at", "bits", "items")).alias("found")), "uid", "left").select("doc", "text", "found")
    return marked.mapInArrow(_folded, _marked_schema(df))


def _marked_schema(df: DataFrame) -> T.StructType:
    kinds = (T.BinaryType(), T.ArrayType(T.StringType()), T.LongType(), T.LongType())
    return T.StructType([df.schema["doc"], df.schema["text"], *(T.StructField(name, kind) for name, kind in zip(MARKS, kinds, strict=True))])


def _pieces(window: int, most: int):
    """Items as pieces of at most ``most`` words that hold all their windows, words being one blank apart; items without words give none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                step = most - window + 1
                out += [(item, b" ".join(words[at : at + most]), min(most, len(words) - at)) for at in range(0, max(1, len(words) - window + 1), step)] if words else []
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["item", "piece", "words"])

    return work


def _packed(docs: DataFrame, text_col: str):
    """The columns besides the text, in one struct whose field names can't clash with ours."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]).alias("doc")


def _unpacked(docs: DataFrame, text_col: str) -> list:
    return [F.col("text").alias(c) if c == text_col else F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, window: int, max_words: int) -> DataFrame:
    """doc (the other columns), text, hits, items, n_words and n_hit."""
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    piece = max(2 * window, min(PIECE, max_words // 8))
    # the items of a piece are one row, however many there are
    pieces = texts.mapInArrow(_pieces(window, piece), "item string, piece binary, words long").groupBy("piece").agg(F.first("words").alias("words"), F.sort_array(F.collect_set("item")).alias("items"))
    pieces = materialise(pieces.withColumn("at", F.xxhash64("piece")))
    total = pieces.agg(F.sum("words")).first()[0] or 0
    blocks = 1 if total <= max_words else int(-(-2 * total // max_words))
    if len(set(docs.columns)) != len(docs.columns):
        raise ValueError("columns of docs must have different names")
    df = docs.select(_packed(docs, text_col), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:
        return _in_blocks(df, pieces, total, blocks, window)
    items = sorted((tuple(r["items"]), bytes(r.piece).split()) for r in pieces.collect())  # at most ``max_words`` words
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    return df.mapInArrow(_marks(key, docs.sparkSession.sparkContext.broadcast(items), window), _marked_schema(df))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_words: int = 250_000) -> DataFrame:
    """``docs`` with one more column, ``contamination``: struct of n_words, n_hit (words that are hit),
    hits (bitmap of words, null if none) and items.

    Null texts have no words; items without words match nothing; a null item_id counts as the text "null"; items that
    repeat an id are one item with several texts.  With an empty benchmark nothing is hit.  Columns of ``docs`` are
    kept, whatever their names (a column called contamination is replaced).
    """
    named = [c for c, name in zip(_unpacked(docs, text_col), docs.columns, strict=True) if name != "contamination"]
    return _marked(docs, benchmark, text_col, item_col, window, max_words).select(*named, F.struct("n_words", "n_hit", "hits", "items").alias("contamination"))


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans of hit words out of the text."""
    for batch in batches:
        out = []
        for text, bits in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if bits and text:
                flat = np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 32
                edges = np.flatnonzero(np.diff(np.r_[False, flat, False])).reshape(-1, 2)
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(edges)).astype(bool)
                runs = np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2)
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at : edges[a, 0]])
                    at = edges[b - 1, 1]
                text = b"".join([*parts, text[at:]])
            out.append(None if text is None else text.decode())
        columns = [pa.array(out, pa.string()) if name == "text" else column for name, column in zip(batch.schema.names, batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.05, action: str = "drop", window: int = WINDOW, max_words: int = 250_000) -> DataFrame:
    """Remove benchmark passages from ``docs`` (needs a column text; keeps all columns).

    A document is contaminated when words are hit and they are ``max_coverage`` of its words or more.  "drop" removes
    contaminated documents and leaves the others untouched; "strip" cuts the hit spans out of contaminated documents.
    Edge cases as in :func:`contamination`; documents without text stay.
    """
    if action not in ("drop", "strip"):
        raise ValueError("action must be 'drop' or 'strip'")
    flat = _marked(docs, benchmark, "text", "item_id", window, max_words)
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * max_coverage)
    if action == "drop":
        return flat.filter(~bad).select(*_unpacked(docs, "text"))
    cut = flat.withColumn("hits", F.when(bad, F.col("hits"))).select("doc", "text", "hits")
    return cut.mapInArrow(_stripped, cut.schema).select(*_unpacked(docs, "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    flat = marked.select("doc_id", *[F.col(f"contamination.{c}").alias(c) for c in ("n_words", "n_hit", "items")])
    return flat.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT dw.doc_id, dw.size, dw.i, win.item FROM dw JOIN win ON dw.size = win.size AND dw.gram = win.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
sha256(coalesce(items.list, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
