r"""Token counts: texts are encoded in batches inside Arrow functions, and lengths alone come back.

Texts are read once.  Those of up to ``long_bytes`` bytes are counted where they are read; longer ones are cut at safe boundaries
into pieces, which are written to the shared folder, dealt to as many tasks as their bytes ask for, and summed up by text.  A call of
the tokenizer gets texts of like length, some ``batch_bytes`` bytes together, however many or long they are.

A boundary is safe if the tokens on its two sides can't depend on each other.  Byte-level vocabularies split a text by a pattern
before any merge; of its pieces none holds white space but at its begin (or is white space alone), and letters and digits are never in one
piece.  So a text may be cut before white space that follows something else, and between an ASCII letter and an ASCII digit: the
part before holds all its white space with what follows it (the one look-ahead of the pattern), and the part behind begins where a
piece begins.  What the libraries' Unicode tables might see differently next to a cut is left alone.  Strings of special tokens
are looked for first; kinds of cuts that lie inside such a string are not used.  Word vocabularies that
drop white space are cut in the same places; vocabularies of pieces, whose pieces don't cross words, are cut at single blanks, which are the
begin of a word.  A text without a safe place stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

VOCABULARY = "byte_bpe_50k.json"
COUNTED = "part int, pos long, id long, n_bytes long, n_tokens long, piece string"
#: Bytes above which a text is cut, of a piece, of a call of the tokenizer, and of a task of pieces.
LONG, PIECE, BATCH, TASK = 262_144, 65_536, 1_048_576, 8_388_608

#: A cut's left neighbour: what no Unicode table calls white space (control characters and format marks are left out as well).
_SURE = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x21, 0x7E), (0xA1, 0x167F), (0x1681, 0x180D), (0x180F, 0x1FFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x2060, 0x2FFF), (0x3001, 0xFEFE), (0xFF00, 0x10FFFF)))
SPACE_CUT = rf"(?=[ \t\n\r])(?<=[{_SURE}])"
CLASS_CUT = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
#: A single blank between words: both neighbours are ASCII letters or digits, which no normalisation joins with it.
BLANK_CUT = r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])"


def cuts(text: str, places: re.Pattern, size: int) -> list[str]:
    """The text in pieces of at least ``size`` characters, each up to the first safe place behind that; a blank that is a place itself is dropped."""
    found, begin = [], 0
    while len(text) - begin > size:
        m = places.search(text, begin + size)
        if m is None:
            break
        found.append(text[begin : m.start()])
        begin = m.end()
    return [*found, text[begin:]]


class Counter:
    """Numbers of tokens by a vocabulary file: ``.json`` of the library tokenizers, ``.model`` of sentencepiece.

    No begin, end or other added special tokens, no truncation, no padding; strings of special tokens inside texts as the library has it.
    """

    def __init__(self, vocabulary: str):
        if vocabulary.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            with open(vocabulary, encoding="utf-8") as f:
                spec = json.load(f)
            self.tokenizer = Tokenizer.from_file(vocabulary)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.places = self._places(spec)
        elif vocabulary.endswith(".model"):
            import sentencepiece

            self.tokenizer = None
            self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            self.places = re.compile(BLANK_CUT)
        else:
            raise ValueError(f"a vocabulary is a .json or a .model file: {vocabulary}")

    @staticmethod
    def _places(spec: dict) -> re.Pattern | None:
        """Safe places of a vocabulary, or None where nothing is known of how it splits texts."""
        pre = spec.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        level = next((p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "ByteLevel"), None)
        added = spec.get("added_tokens") or []
        if level is None or level.get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return None
        if kinds == ["ByteLevel"] and level.get("use_regex", True) and spec.get("normalizer") is None:
            possible = [SPACE_CUT, CLASS_CUT]
        elif kinds == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["invert"]:
            possible = [SPACE_CUT]  # white space belongs to no word
        else:
            return None
        possible = [p for p in possible if not any(re.search(p, t["content"]) for t in added)]
        return re.compile("|".join(possible)) if possible else None

    def count(self, texts: list[str]) -> list[int]:
        if self.tokenizer is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def balanced(self, texts: list[str], sizes: np.ndarray, batch_bytes: int) -> np.ndarray:
        """Tokens of each text; a call gets texts of like length, of ``batch_bytes`` bytes together or one that is longer."""
        out, order = np.zeros(len(texts), np.int64), np.argsort(sizes, kind="stable")
        begin, total = 0, 0
        for i, at in enumerate(order):
            if total and total + sizes[at] > batch_bytes:
                out[order[begin:i]] = self.count([texts[k] for k in order[begin:i]])
                begin, total = i, 0
            total += sizes[at]
        if begin < len(order):
            out[order[begin:]] = self.count([texts[k] for k in order[begin:]])
        return out


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """One for each Python worker."""
    if vocabulary not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        _counters[vocabulary] = Counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _counters[vocabulary]


def _read(vocabulary: str, long_bytes: int, piece: int, batch_bytes: int):
    """Rows of short texts with their counts, and of each long text's pieces, of which the first has the bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, pos = counter(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            sizes = np.array([len(x) if x else 0 for x in raw.to_pylist()], np.int64)
            long = (sizes > long_bytes) if own.places is not None else np.zeros(len(sizes), bool)
            at = np.flatnonzero(~long)
            texts = [x or "" for x in batch.column(1).take(pa.array(at)).to_pylist()]
            tokens = own.balanced(texts, sizes[at], batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part, np.int32)), pa.array(pos + at), batch.column(0).take(pa.array(at)), pa.array(sizes[at]), pa.array(tokens), pa.nulls(len(at), pa.string())],
                ["part", "pos", "id", "n_bytes", "n_tokens", "piece"],
            )
            for i in np.flatnonzero(long):
                parts = cuts(batch.column(1)[i].as_py(), own.places, piece)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, pos + i)), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([sizes[i]] + [0] * (n - 1), pa.int64()), pa.nulls(n, pa.int64()), pa.array(parts, pa.string())],
                    ["part", "pos", "id", "n_bytes", "n_tokens", "piece"],
                )
            pos += len(sizes)

    return work


def _pieces(vocabulary: str, batch_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            tokens = own.balanced(texts, np.array([len(x.encode()) for x in texts], np.int64), batch_bytes)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("id"), batch.column("n_bytes"), pa.array(tokens)], ["part", "pos", "id", "n_bytes", "n_tokens"])

    return work


def count_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, limit: int = 512, long_bytes: int = LONG, piece: int = PIECE, batch_bytes: int = BATCH) -> DataFrame:
    """Tokens of every whole text.  One row for each row of ``df``: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is a file of :mod:`public_tokenizers` by name, or a path that every executor has.  Null text is the empty text (0 tokens);
    rows that repeat an id, or have none, are counted each; an empty table gives an empty result; other columns are ignored.
    """
    if piece < 1:
        raise ValueError("a piece has at least one character")
    spark = df.sparkSession
    rows = materialise(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_read(vocabulary, long_bytes, piece, batch_bytes), COUNTED))
    cut = rows.filter("piece IS NOT NULL")
    total = cut.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    result = rows.filter("piece IS NULL").select("id", "n_bytes", "n_tokens")
    if total:
        dealt = cut.repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK)))
        counted = dealt.mapInArrow(_pieces(vocabulary, batch_bytes), "part int, pos long, id long, n_bytes long, n_tokens long")
        result = result.unionByName(counted.groupBy("part", "pos").agg(F.first("id").alias("id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("part", "pos"))
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
