"""Cross-entropy difference: which documents read more like a target corpus than like the background.

Two interpolated bigram models share one vocabulary, all words of the corpus: the target model counts the target
documents, the background model all others, its counts scaled to the target's number of tokens so that both models are
matched in size and smoothing.  Each document's score is the mean over its tokens of target loss minus background loss
(bits); lower reads more like the target.  A document's own counts are taken out of the model that has counted it, so that no
document is scored by what it has taught.

Words and bigrams are counted by 64-bit hashes, each on its own.  Documents are dealt into blocks of about ``BLOCK`` bytes.
Each block sends its distinct words and bigrams with its own counts to the buckets that hold those hashes; a bucket adds
the counts up and answers each block with the totals, in the order asked, so that answers need no keys.  A hot word is
asked for once by each block, however many documents have it.  Blocks and buckets grow in number with the corpus, not in
size; only totals reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .shingles import mixed, word_numbers

#: Bytes of text of a block.
BLOCK = 16_000_000
#: Weight of the bigram estimate, and of the uniform share in the unigram estimate.
LAMBDA, UNIFORM = 0.6, 0.05
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one size, in the least width that holds them."""
    both = np.concatenate(columns)
    width = next(w for w in (1, 2, 4, 8) if not len(both) or int(both.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(both.astype(f"<u{width}").tobytes(), 1)


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64).reshape(columns, -1)


def _parcels(labels: bool, most: int = 32_000_000):
    """Rows (block, id, text) of one block, bound together and compressed."""

    def bound(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.set_column(2, "text", t["text"].cast(pa.large_binary()))
        t = t.take(pa.compute.sort_indices(t["block"]))
        blocks = t["block"].to_numpy()
        first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(blocks)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t.slice(x, y - x))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[x : x + 1]), pa.array([labels]), pa.array([sink.getvalue().to_pybytes()])], ["block", "labels", "parcel"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size > most:
                    yield from bound(held)
                    held, size = [], 0
        if held:
            yield from bound(held)

    return work


class Block:
    """The tokens of a block's documents, and its distinct words (0 before the first of a text) and bigrams in order."""

    def __init__(self, labels: list[bool], parcels: list[bytes]):
        opened = sorted(zip(labels, parcels, strict=True))
        tables = [pa.ipc.open_stream(x).read_all() for is_label, x in opened if not is_label]
        self.ids = pa.chunked_array([c for t in tables for c in t["id"].chunks], pa.int64())
        wanted = pa.chunked_array([c for is_label, x in opened if is_label for c in pa.ipc.open_stream(x).read_all()["id"].chunks], pa.int64())
        #: Which documents are targets.
        self.target = np.array(pa.compute.is_in(self.ids, value_set=wanted).to_pylist(), bool)
        sizes, words = [], []
        for t in tables:
            for _, n, w in word_numbers(t["text"].to_pylist()):
                sizes.append(n)
                words.append(w)
        self.sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        before = np.r_[np.zeros(1, np.uint64), word[:-1]] if len(word) else word
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        self.pairs, self.pair = np.unique(mixed(before * _NEXT + word), return_inverse=True)
        self.words, place = np.unique(np.concatenate([word, before]), return_inverse=True)
        self.word, self.before = place[: len(word)], place[len(word) :]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def own(self, place: np.ndarray) -> np.ndarray:
        """How often each token's word, word before or bigram (its place) occurs in the token's own document."""
        _, at, count = np.unique(self.owner * np.int64(len(self.words) + len(self.pairs) + 1) + place, return_inverse=True, return_counts=True)
        return count[at]


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket begin and end, in sorted keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


ASKED = "bucket int, block int, pairs binary, pair_counts binary, words binary, word_counts binary"


def _ask(buckets: int):
    """A block's own counts: of bigrams (target, background), of words (as word, as word before; target, background)."""

    def work(t: pa.Table) -> pa.Table:
        b = Block(t["labels"].to_pylist(), t["parcel"].to_pylist())
        side = np.repeat(b.target, b.sizes)
        count = lambda place, keys: [np.bincount(place[side], minlength=len(keys)), np.bincount(place[~side], minlength=len(keys))]
        pair, word = count(b.pair, b.pairs), [*count(b.word, b.words), *count(b.before, b.words)]
        p, w = _cuts(b.pairs, buckets), _cuts(b.words, buckets)
        block, out = t["block"][0].as_py(), []
        for k in range(buckets):
            x, y = slice(p[k], p[k + 1]), slice(w[k], w[k + 1])
            if p[k] < p[k + 1] or w[k] < w[k + 1]:
                out.append((k, block, b.pairs[x].tobytes(), _packed(*(c[x] for c in pair)), b.words[y].tobytes(), _packed(*(c[y] for c in word))))
        names, kinds = ["bucket", "block", "pairs", "pair_counts", "words", "word_counts"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    return work


ANSWERED = "bucket int, block int, pair_counts binary, word_counts binary, vocabulary long, own long, others long"


def _answer(t: pa.Table) -> pa.Table:
    """The totals of all that blocks asked a bucket for; the bucket's numbers of words and tokens are in its first row."""

    def totals(keys: str, counts: str, columns: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        asked = [np.frombuffer(x, np.uint64) for x in t[keys].to_pylist()]
        known, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros((columns, len(known)), np.int64)
        cut = np.r_[0, np.cumsum([len(x) for x in asked])]
        for i, data in enumerate(t[counts].to_pylist()):
            total[:, place[cut[i] : cut[i + 1]]] += _unpacked(data, columns)  # a block asks for a key once
        return [_packed(*total[:, place[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)], known, total

    pairs, _, _ = totals("pairs", "pair_counts", 2)
    words, known, total = totals("words", "word_counts", 4)
    once = [[int((known != 0).sum()), int(total[0].sum()), int(total[1].sum())]] + [[0, 0, 0]] * (t.num_rows - 1)
    return pa.table([t["bucket"], t["block"], pa.array(pairs, pa.binary()), pa.array(words, pa.binary()), *(pa.array([x[i] for x in once], pa.int64()) for i in range(3))], ["bucket", "block", "pair_counts", "word_counts", "vocabulary", "own", "others"])


def _losses(word: np.ndarray, context: np.ndarray, bigram: np.ndarray, tokens: np.ndarray, scale: float, vocabulary: int) -> np.ndarray:
    """Bits of loss of words after others, from the counts of word, word before and both, and the tokens of the model."""
    unigram = np.where(tokens > 0, (1 - UNIFORM) * word / np.maximum(tokens, 1), (1 - UNIFORM) / vocabulary) + UNIFORM / vocabulary
    # absent contexts leave all the weight to the unigram estimate; one pseudo-count damps rare ones
    share = LAMBDA * context * scale / (context * scale + 1)
    return -np.log2(share * (bigram / np.maximum(context, 1)) + (1 - share) * unigram)


def _scores(own: int, others: int, vocabulary: int):
    scale = own / others if own and others else 1.0

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs["labels"].to_pylist(), docs["parcel"].to_pylist())
        answers = answers.take(pa.compute.sort_indices(answers["bucket"])) if answers.num_rows else answers
        pair, word = (np.concatenate([np.zeros((n, 0), np.int64), *(_unpacked(x, n) for x in answers[c].to_pylist())], axis=1) for c, n in (("pair_counts", 2), ("word_counts", 4)))
        mine = [b.own(x) for x in (b.word, b.before, b.pair)]
        losses = []
        for s, tokens, by in ((0, own, 1.0), (1, others, scale)):
            # the document's own counts leave the model of its side
            left = (b.target if s == 0 else ~b.target)[b.owner]
            counts = [x - left * m for x, m in zip((word[s][b.word], word[2 + s][b.before], pair[s][b.pair]), mine, strict=True)]
            losses.append(np.bincount(b.owner, _losses(*counts, tokens - left * b.sizes[b.owner], by, vocabulary), len(b.sizes)) / np.maximum(b.sizes, 1))
        target, background = losses
        return pa.table([b.ids, pa.array(b.sizes), pa.array(target), pa.array(background), pa.array(target - background)], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    return work


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id_col, n_tokens, target_loss, background_loss, score (bits a token).

    ``target_ids``: the ids of the target documents in its first column (repeats and nulls do no harm; null ids are never
    targets).  Words are lower-cased (A-Z) runs without white space.  Texts that are null or blank score 0 with no tokens.  A model that has
    no other documents than the one it scores is uniform over the vocabulary.  Rows that repeat are documents of their own, which know each other.  Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK))
    block = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(n)).cast("int").alias("block")
    kind = "block int, labels boolean, parcel binary"
    rows = texts.select(block, "id", F.col("text").cast("binary").alias("text")).mapInArrow(_parcels(False), kind)
    target = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).filter("id IS NOT NULL")
    target = target.select(block, "id", F.col("text").cast("binary").alias("text")).mapInArrow(_parcels(True), kind)
    both = rows.unionByName(target)
    asked = both.repartition(n, "block").groupBy("block").applyInArrow(_ask(n), ASKED)
    answers = materialise(asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERED))
    vocabulary, own, others = (x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("own"), F.sum("others")).first())
    dealt, told = (x.repartition(n, "block").groupBy("block") for x in (both, answers.select("block", "bucket", "pair_counts", "word_counts")))
    scored = dealt.cogroup(told).applyInArrow(_scores(own, others, max(1, vocabulary)), "id long, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
