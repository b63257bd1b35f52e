"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text recognises exactly the substrings of that text.  A document is
parsed against each automaton into the fewest pieces: from each position the longest match is taken, then the next
phrase begins; a symbol that the language doesn't know is a phrase of its own.  A language whose text knows the document's
letter sequences needs few phrases; the phrase count times the bits of a pointer into the training text, over the
document's length, estimates the cross entropy, and the smallest estimate wins.

Training uses a bounded sample of labelled rows: at most ``sample_chars`` normalised characters for each language,
rows in the order of a hash.  An automaton has less than two states a character, so its dense table
(states x symbols, 16 bits) has a known bound; with many languages each has a smaller sample, so that all tables together keep
theirs (``model_bytes``) and can be sent to every task.  The sample's rows that the training text
doesn't use tell how many phrases a text of the language needs (see :meth:`Model.fits`).

Whole texts are parsed, many at a time.  Texts are cut into pieces of ``PIECE`` symbols, which advance together, one symbol
each step, by table look-ups in numpy, each from a phrase of its own.  Then each piece is entered once more with the state
in which the piece before it ends: as soon as the state is the one of the first run, the rest is the same.  So
the counts are those of a text that is parsed from its begin to its end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Symbols of a piece; no result depends on it.
PIECE = 256
#: Symbols of a table: white space, the commonest letters of the sample, one for letters that the sample doesn't have, and
#: ``DIGITS`` symbols that write the sample's rarer letters as numbers, so that scripts with thousands of letters have room.
SYMBOLS, DIGITS = 64, 16
OTHER, BLANK, WIDE = SYMBOLS - DIGITS - 1, 255, 254


def _letters(text: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    out = "".join([c if c.isalpha() else " " for c in text.lower()])
    return " ".join(out.split())


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of one sequence: row 0 is the start, row 1 stands for "no such substring"."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
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
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table_ = np.ones((len(nxt) + 1, width), np.uint16 if len(nxt) < 65_000 else np.int32)
    for s, edges in enumerate(nxt):
        row = s + 1 if s else 0
        for c, t in edges.items():
            table_[row, c] = t + 1
    return table_


def _resumed(table_: np.ndarray, symbols: np.ndarray, states: np.ndarray, state: int) -> tuple[int, int, int]:
    """Parse one piece from a state until the states meet those of its first run: phrases begun, symbols read, and the state."""
    flat, n = table_.ravel(), 0
    for i, (c, before) in enumerate(zip(symbols.tolist(), states.tolist(), strict=True)):
        got = int(flat[state * SYMBOLS + c])
        if got == 1:
            n, got = n + 1, int(flat[c])
        state = got
        if state == before:
            return n, i + 1, state
    return n, len(symbols), state


class Model:
    """Automata of all languages over one alphabet, and the phrases a symbol that texts of each language need."""

    def __init__(self, texts: dict[str, str], unseen: dict[str, list[str]] | None = None):
        count = Counter(c for t in texts.values() for c in t if c != " ")
        letters = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
        self.code = {" ": 0} | {c: i + 1 for i, c in enumerate(letters[: OTHER - 1])}
        self.wide = {c: i for i, c in enumerate(letters[OTHER - 1 :])}
        self.digits = next(n for n in range(1, 9) if DIGITS**n >= len(self.wide))
        self.langs = sorted(texts)
        self.tables = [suffix_automaton(self._symbols(texts[k]), SYMBOLS) for k in self.langs]
        self.bits = np.array([math.log2(max(2, len(texts[k]))) for k in self.langs])
        self._dense: np.ndarray | None = None
        self.rates: dict[str, float] = {}
        for j, k in enumerate(self.langs):
            own = [t for t in (unseen or {}).get(k, []) if t]
            if own:
                phrases, sizes = self.phrases(own)
                self.rates[k] = float(phrases[:, j].sum() / max(1, sizes.sum()))
        self._dense = None  # not sent along: built once in each worker

    def _symbols(self, text: str) -> list[int]:
        out: list[int] = []
        for c in text:
            if c in self.wide:
                out += [SYMBOLS - DIGITS + (self.wide[c] // DIGITS**k) % DIGITS for k in range(self.digits)]
            else:
                out.append(self.code.get(c, OTHER))
        return out

    def fits(self, lang: np.ndarray, phrases: np.ndarray, sizes: np.ndarray, excess: float, slack: float) -> np.ndarray:
        """Whether texts read like the language (its place) that won: they need at most ``excess`` times the phrases that unseen texts of
        that language need, and ``slack`` phrases more.  Languages without unseen rows accept all."""
        rate = np.array([self.rates.get(k, np.inf) for k in self.langs])
        return phrases <= excess * rate[lang] * sizes + slack

    def dense(self) -> np.ndarray:
        """Symbol of every code point: BLANK for what isn't a letter, WIDE for a letter that is written as a number."""
        if self._dense is None:
            d = np.full(0x110000, BLANK, np.uint8)
            letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
            d[letters] = OTHER
            for c, i in self.code.items():
                d[ord(c)] = i if c != " " else BLANK
            for c in self.wide:
                d[ord(c)] = WIDE
            self._dense = d
        return self._dense

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed (texts x languages) and symbols of each text; texts without letters have no symbols."""
        flat = np.frombuffer("\0".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol, n = self.dense()[flat], len(texts)
        owner = np.zeros(len(flat), np.int64)
        cuts = np.flatnonzero(flat == 0)
        if len(cuts) == n - 1:
            owner[cuts] = 1
            owner = np.cumsum(owner)
        else:  # texts hold the separator itself
            owner = np.repeat(np.arange(n), [len(t.lower()) + 3 for t in texts])[:-1]
        blank = symbol == BLANK
        last = np.r_[owner[1:] != owner[:-1], True]
        # of a run of other characters one blank stays, as do a leading and a trailing one
        keep = ~blank | np.r_[~blank[1:], False] | last
        keep[cuts] &= False
        some = np.bincount(owner, ~blank, n) > 0
        keep &= some[owner]
        flat, symbol, owner = flat[keep], np.where(blank, 0, symbol)[keep], owner[keep]
        if self.wide and (symbol == WIDE).any():
            size = np.where(symbol == WIDE, self.digits, 1)
            place = np.repeat(np.arange(len(symbol)), size)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            known = np.array(sorted(map(ord, self.wide)))
            number = np.array([self.wide[chr(c)] for c in known])[np.minimum(np.searchsorted(known, flat[place]), len(known) - 1)]
            symbol, owner = np.where(symbol[place] == WIDE, SYMBOLS - DIGITS + (number // DIGITS**nth) % DIGITS, symbol[place]), owner[place]
        sizes = np.bincount(owner, minlength=n)
        if not len(symbol):
            return np.zeros((n, len(self.langs)), np.int64), sizes
        # lanes: the pieces of every text
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        per = -(-sizes // PIECE)
        lane_owner = np.repeat(np.arange(n), per)
        within = np.arange(len(lane_owner)) - np.repeat(np.cumsum(per) - per, per)
        lane_start = starts[lane_owner] + within * PIECE
        lane_size = np.minimum(PIECE, sizes[lane_owner] - within * PIECE)
        order = np.argsort(-lane_size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        grid = np.zeros((min(PIECE, int(lane_size[order[0]])), len(order)), np.intp)
        alive = np.searchsorted(-lane_size[order], -np.arange(len(grid)), side="left")
        for i, k in enumerate(alive):
            grid[i, :k] = symbol[lane_start[order[:k]] + i]
        follows = rank[np.flatnonzero(within > 0)]  # columns of the pieces that aren't a text's first
        leads = rank[np.flatnonzero(within > 0) - 1]
        ends = lane_size[order] - 1
        out = np.zeros((n, len(self.langs)), np.int64)
        for j, trans in enumerate(self.tables):
            flat_table, first = trans.ravel(), trans[0].astype(np.intp)
            state = np.ones(len(order), np.intp)  # row 1 goes nowhere: the next symbol begins a phrase
            begun, seen = np.zeros(grid.shape, bool), np.zeros(grid.shape, np.int32)
            for i, k in enumerate(alive):
                c = grid[i, :k]
                got = flat_table.take(state[:k] * SYMBOLS + c).astype(np.intp)
                miss = np.flatnonzero(got == 1)
                begun[i, miss] = True
                got[miss] = first[c[miss]]  # a symbol that the language doesn't know stays in row 1
                state[:k] = got
                seen[i, :k] = got
            count = begun.sum(0)
            self._enter(trans, grid, begun, seen, count, follows, leads, ends)
            out[:, j] = np.bincount(lane_owner[order], count, n).astype(np.int64)
        return out, sizes

    @staticmethod
    def _enter(trans: np.ndarray, grid: np.ndarray, begun: np.ndarray, seen: np.ndarray, count: np.ndarray, follows: np.ndarray, leads: np.ndarray, ends: np.ndarray) -> None:
        """Make the counts of the columns ``follows`` those of pieces that are entered with the state in which the columns ``leads`` end."""
        flat_table, first = trans.ravel(), trans[0].astype(np.intp)
        column, state = follows, seen[ends[leads], leads].astype(np.intp)
        was, now = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        at, open_ = np.arange(len(column)), None
        for i in range(len(grid)):
            ended = ends[column[at]] < i
            if ended.any():  # pieces that end before they meet their first run
                open_ = at[ended] if open_ is None else np.r_[open_, at[ended]]
                at = at[~ended]
            if not len(at):
                break
            own = column[at]
            c = grid[i, own]
            got = flat_table.take(state[at] * SYMBOLS + c).astype(np.intp)
            miss = got == 1
            got[miss] = first[c[miss]]
            now[at] += miss
            was[at] += begun[i, own]
            state[at] = got
            at = at[got != seen[i, own]]
        open_ = np.sort(np.concatenate([x for x in (open_, at) if x is not None]))
        count[column] += now - was
        # the piece behind one that never met its first run begins in another state: these go on one by one
        done = -1
        for k in open_.tolist():
            if k <= done:
                continue
            own, entered = k, int(state[k])
            while own + 1 < len(column) and leads[own + 1] == column[own]:
                own += 1
                piece = column[own]
                n, size, entered = _resumed(trans, grid[: ends[piece] + 1, piece], seen[: ends[piece] + 1, piece], entered)
                count[piece] = n + int(begun[size : ends[piece] + 1, piece].sum())
                done = own
                if entered == seen[size - 1, piece]:
                    break


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_chars: int = 24_000, rows: int = 400, row_chars: int = 3_000, languages: int = 1_000, model_bytes: int = 256_000_000, gathered: int = 64_000_000) -> Model:
    """Train on a bounded sample of labelled rows.

    Bounds: the ``languages`` with the most rows; of each ``rows`` different texts in the order of a hash; of each text
    its first ``row_chars`` characters, and of those together the first ``sample_chars`` make the training text.  Where all rows together don't
    fill it, whole texts (still up to ``sample_chars``) do.  The rows behind it calibrate :meth:`Model.fits`.  Null texts or labels are left out; texts that repeat count once.

    The tables of all languages together have at most ``model_bytes``, and at most ``gathered`` characters of rows reach the driver (twice
    ``sample_chars`` of each language at least): where there are more than some 40 languages, each has fewer ``sample_chars``.
    """
    known = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    # a first cut by hash keeps what follows small however many rows a language has
    share = {r["lang"]: min(1.0, 4 * rows / r["count"]) for r in counts}
    if not share:
        return Model({})
    # less than two states a character, a row of symbols each
    sample_chars = max(1, min(sample_chars, model_bytes // (len(share) * 2 * SYMBOLS * np.dtype(np.uint16).itemsize)))
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    few = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    cut = known.withColumn("at", at).filter(F.col("at") < few[F.col("lang")]).withColumn("text", F.substring("text", 1, sample_chars))
    # a row for each text: a hot group of copies is one before any of it is sorted
    texts_ = cut.groupBy("lang", "at").agg(F.min("text").alias("text"))
    in_turn = W.partitionBy("lang").orderBy("at")
    before = F.sum(F.length("text")).over(in_turn.rowsBetween(W.unboundedPreceding, 0)) - F.length("text")
    ranked = texts_.withColumn("rank", F.row_number().over(in_turn)).withColumn("before", before)
    ranked = ranked.filter((F.col("rank") <= rows) & (F.col("before") < max(2 * sample_chars, gathered // len(share))))
    chosen: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        chosen.setdefault(r["lang"], []).append(_letters(r["text"]))
    texts: dict[str, str] = {}
    unseen: dict[str, list[str]] = {}
    for lang, parts in chosen.items():
        parts = [p for p in parts if p]
        used, size = 0, 0
        while used < len(parts) and size < sample_chars:
            size += len(parts[used][:row_chars]) + 1
            used += 1
        filled = size >= sample_chars
        texts[lang] = " ".join(p[:row_chars] if filled else p for p in parts[:used])[:sample_chars]
        unseen[lang] = parts[used:]
    return Model(texts, unseen)


def _predict(sent, excess: float, slack: float, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            langs, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            at, size = 0, 0
            begins = [0]
            for i, t in enumerate(texts):  # slices of bounded size
                size += len(t)
                if size > 1_000_000:
                    begins.append(i + 1)
                    size = 0
            for at, end in zip(begins, [*begins[1:], len(texts)], strict=True):
                if at == end or not model.langs:
                    continue
                phrases, sizes = model.phrases(texts[at:end])
                bits = phrases * model.bits / np.maximum(sizes, 1)[:, None]
                order = np.argsort(bits, 1, kind="stable")
                best = order[:, 0]
                low = bits[np.arange(len(bits)), best]
                # the winner's weight among all, a bit of cross entropy halving a weight twice
                weight = np.exp2(-4 * (bits - low[:, None]))
                sure = 1 / weight.sum(1)
                like = model.fits(best, phrases[np.arange(len(bits)), best], sizes, excess, slack)
                for i in np.flatnonzero(sizes):
                    langs[at + i], scores[at + i], fits[at + i] = model.langs[best[i]], float(sure[i]), bool(like[i])
            names = [name for name in batch.schema.names if with_text or name != "text"]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], [*names, "lang_pred", "score", "fits"])

    return work


def _predicted(df: DataFrame, kept: list[Column], model: Model, text_col: str, excess: float = math.inf, slack: float = math.inf, with_text: bool = False) -> DataFrame:
    """The kept columns as ``doc.c0``, ``doc.c1`` and so on, the text if wanted, lang_pred, score and fits."""
    packed = df.select(F.struct(F.lit(0).alias("none"), *[c.alias(f"c{i}") for i, c in enumerate(kept)]).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = packed.schema if with_text else packed.drop("text").schema
    added = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])
    return packed.mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(model), excess, slack, with_text), added)


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The ``keep`` columns of ``df`` (all by default) with lang_pred and score (0 to 1).

    A text that is null or without letters is "und" with score 0, as is every text if the model knows no language.  Ties
    go to the first language in code point order.  Columns of ``df`` called lang_pred or score are replaced.
    """
    kept = keep if keep is not None else [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    labels = df.select(*kept).columns
    return _predicted(df, kept, model, text_col).select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(labels)], "lang_pred", "score")


def known_language(df: DataFrame, model: Model, text_col: str = "text", excess: float = 2.2, slack: float = 6.0) -> DataFrame:
    """The rows of ``df`` whose text reads like one of the model's languages; all columns are kept, whatever their names.

    Rejected are null texts, texts without letters, and texts that need more than ``excess`` times the phrases which unseen texts of
    the nearest language need, plus ``slack`` (letters without words, languages that nobody labelled).  The slack keeps short texts.  If the model
    knows no language, no row is rejected.
    """
    if not model.langs:
        return df
    others = [c for c in df.columns if c != text_col]
    out = _predicted(df, [F.col(f"`{c}`") for c in others], model, text_col, excess, slack, True).filter("fits")
    text = F.col("text").cast(df.schema[text_col].dataType)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"doc.c{others.index(c)}").alias(c) for c in df.columns])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model, keep=[F.col("doc_id"), held_out().alias("held_out")])
