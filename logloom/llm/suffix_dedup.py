"""Removal of repeated byte strings with suffix arrays.

Each byte that lies in a string of ``LENGTH`` bytes which also starts earlier in the corpus (smaller doc_id, or the same
document and an earlier start) is removed.

A suffix array of a whole corpus would be one object, so the strings are dealt into many small ones first, without losing a
match.  Of each string of 100 bytes the *anchor* is the 32-byte gram with the smallest hash in it; equal strings have
equal anchors.  Consecutive strings with one anchor form a *stretch*.  Stretches are sent, as fixed-width records packed
in numpy, to the task of their anchor.  Of stretches with the same bytes the earliest one stays and the others are
removed as a whole: this happens where they are read already, so a hot passage costs one record for each task.  Only
anchors with two or more different stretches are left; for these the bytes are fetched and a suffix array is built for
each block of anchors.  The stretches of an anchor that has more of them than a block holds (a hot phrase between bytes of
each document's own) are cut into their single strings, the earliest of equal ones is kept where they are fetched, and
the rest is dealt by a hash of the whole string into blocks of their own.

The suffix array is made by two-stage sorting: the suffixes smaller than their successors are sorted directly; all others
are induced from them by scanning the buckets of first bytes in order.  Adjacent common prefixes of 100 bytes or more
join equal strings, and of each such class all but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table
from .shingles import mixed

#: Length of a removed string, of an anchor gram, and of the sorted part of a suffix; bytes of text that are hashed at a
#: time, records that are combined at a time, bytes of a suffix array.
LENGTH, GRAM, DEPTH, CHUNK, RECORDS, BLOCK = 100, 32, 104, 2_000_000, 2_000_000, 1_000_000

#: Bytes of text whose records meet in a task.
BUCKET = 32_000_000

#: An occurrence of a stretch: anchor hash, hash of its bytes, document (null flag, id, hash of the text), first and number of starts.
STRETCH = np.dtype([("anchor", "<u8"), ("bytes", "<u8"), ("null", "u1"), ("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("n", "u1")])
#: A string of an anchor that is dealt by strings, with its row in the bytes beside.
SINGLE = np.dtype([*((c, STRETCH[c]) for c in STRETCH.names), ("row", "<i4")])
SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at every position (positions too near to the end are left out)."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sixteen = eight[: n + 16] * _C[0] + (eight[8 : n + 24] ^ _C[1])
    sixteen = (sixteen ^ (sixteen >> np.uint64(29))) * _C[2]
    return mixed(sixteen[:n] * _C[3] + sixteen[16 : n + 16])


def _whole(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes at each place."""
    return mixed(grams[at] * _C[0] + mixed(grams[at + GRAM] * _C[1] + mixed(grams[at + 2 * GRAM] * _C[2] + grams[at + LENGTH - GRAM])))


def _stretches(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document's place, first start, number of starts, anchor hash, hash of the bytes) of all stretches of a buffer."""
    width = LENGTH - GRAM + 1
    grams = _gram_hashes(data)
    low = np.uint64(24)
    key = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    n, span = len(grams), 1
    while 2 * span <= width:
        key = np.minimum(key[: n - 2 * span + 1], key[span : n - span + 1])
        span *= 2
    key = np.minimum(key[: n - width + 1], key[width - span : n - span + 1])
    anchor = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    # starts whose string stays in one document
    owner = np.repeat(np.arange(len(begins)), np.maximum(0, ends - begins - LENGTH + 1))
    sizes = np.maximum(0, ends - begins - LENGTH + 1)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[owner]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    anchor = anchor[starts]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(starts)])
    a, b = starts[first], starts[first] + count - 1

    return owner[first], a, count, grams[anchor[first]], mixed(_whole(grams, a) * _C[3] + _whole(grams, b) + count.astype(np.uint64))


def _earliest(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the records with equal anchors and bytes the earliest ones, and the later ones."""
    r = r[np.lexsort((r["start"], r["th"], r["id"], r["null"], r["bytes"], r["anchor"]))]
    new = np.r_[True, (r["anchor"][1:] != r["anchor"][:-1]) | (r["bytes"][1:] != r["bytes"][:-1])][: len(r)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    same = np.ones(len(r), bool)  # a repeated row: the same place once more
    for c in ("null", "id", "th", "start"):
        same &= r[c] == r[c][first]
    return r[new], r[~same]


def _spans(r: np.ndarray) -> Iterator[tuple]:
    """(id, th, packed spans) of each document that records remove."""
    if len(r):
        r = r[np.lexsort((r["start"], r["th"], r["id"], r["null"]))]
        spans = np.zeros(len(r), SPAN)
        spans["start"], spans["end"] = r["start"], r["start"] + r["n"].astype(np.int32) - 1 + LENGTH
        first = np.flatnonzero(np.r_[True, (r["id"][1:] != r["id"][:-1]) | (r["th"][1:] != r["th"][:-1]) | (r["null"][1:] != r["null"][:-1])])
        for a, b in zip(first, np.r_[first[1:], len(r)], strict=True):
            yield None if r["null"][a] else int(r["id"][a]), int(r["th"][a]), merged(spans[a:b]).tobytes()


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal runs of the spans' union."""
    spans = spans[np.argsort(spans["start"], kind="stable")]
    top = np.maximum.accumulate(spans["end"])
    new = np.r_[True, spans["start"][1:] > top[:-1]]
    out = np.zeros(int(new.sum()), SPAN)
    out["start"], out["end"] = spans["start"][new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]
    return out


SENT = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SENT_DDL = "bucket int, id long, th long, kind int, payload binary"
REMOVED, WANTED, RECORD, STRINGS = 0, 1, 2, 3


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if len(held) >= 10_000 or size > 8_000_000:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _read(buckets: int):
    """Records of each task's texts, combined where they are read, dealt by anchor."""

    def chunks(batches):
        held, size = [], 0
        for batch in batches:
            for doc, th, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for at in range(0, max(0, len(text or b"") - LENGTH + 1), CHUNK):
                    piece = text[at : at + CHUNK + LENGTH - 1]
                    held.append((doc, th, at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def records(held) -> np.ndarray:
        sizes = np.array([len(x[3]) for x in held])
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join([*(x[3] for x in held), bytes(64)]), np.uint8)
        place, start, n, anchor, content = _stretches(data, begins, begins + sizes)
        out = np.zeros(len(place), STRETCH)
        out["anchor"], out["bytes"], out["n"] = anchor, content, n
        out["null"] = np.array([x[0] is None for x in held])[place]
        out["id"] = np.array([x[0] or 0 for x in held], np.int64)[place]
        out["th"] = np.array([x[1] for x in held], np.int64)[place]
        out["start"] = start - begins[place] + np.array([x[2] for x in held], np.int64)[place]
        return out

    def combined(held: list[np.ndarray]) -> Iterator[tuple]:
        kept, later = _earliest(np.concatenate(held))
        yield from ((-1, i, th, REMOVED, spans) for i, th, spans in _spans(later))
        bucket = (kept["anchor"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                own = kept[order[cut[b] : cut[b + 1]]]
                yield b, None, None, RECORD, b"".join(own[c].tobytes() for c in STRETCH.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for chunk in chunks(batches):
            held.append(records(chunk))
            n += len(held[-1])
            if n >= RECORDS:
                yield from _batched(combined(held))
                held, n = [], 0
        if held:
            yield from _batched(combined(held))

    return work


def _unpack(payload: bytes) -> np.ndarray:
    n = len(payload) // STRETCH.itemsize
    out, at = np.zeros(n, STRETCH), 0
    for c in STRETCH.names:
        size = STRETCH[c].itemsize * n
        out[c] = np.frombuffer(payload, STRETCH[c], n, at)
        at += size
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of an anchor meet: later copies are removed; what differs under one anchor is wanted."""
    got = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[3] == RECORD:
                got.append(_unpack(row[4]))
            else:
                yield _rows([row])
    if not got:
        return
    r = np.concatenate(got)
    del got
    anchors = np.sort(r["anchor"])
    several = np.unique(anchors[1:][anchors[1:] == anchors[:-1]])
    at = np.minimum(np.searchsorted(several, r["anchor"]), max(0, len(several) - 1))
    r = r[several[at] == r["anchor"]] if len(several) else r[:0]
    if not len(r):
        return
    kept, later = _earliest(r)
    yield from _batched((-1, i, th, REMOVED, spans) for i, th, spans in _spans(later))
    pair = kept["anchor"][1:] == kept["anchor"][:-1]
    wanted = kept[np.r_[False, pair] | np.r_[pair, False]]
    parts = _blocks_of(wanted)
    order = np.lexsort((wanted["th"], wanted["id"], wanted["null"]))
    wanted, parts = wanted[order], parts[order]
    want = np.zeros(len(wanted), _WANT)
    want["anchor"], want["start"], want["n"], want["parts"] = wanted["anchor"], wanted["start"], wanted["n"], parts
    new = np.flatnonzero(np.r_[True, (wanted["id"][1:] != wanted["id"][:-1]) | (wanted["th"][1:] != wanted["th"][:-1]) | (wanted["null"][1:] != wanted["null"][:-1])][: len(wanted)])
    yield from _batched((-1, None if wanted["null"][a] else int(wanted["id"][a]), int(wanted["th"][a]), WANTED, want[a:b].tobytes()) for a, b in zip(new, np.r_[new[1:], len(wanted)], strict=True))


_WANT = np.dtype([("anchor", "<u8"), ("start", "<i4"), ("n", "u1"), ("parts", "<u4")])


def _blocks_of(wanted: np.ndarray) -> np.ndarray:
    """Blocks that each record's anchor is dealt into by its single strings; 0 where its stretches fit one block (records sorted by anchor)."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, wanted["anchor"][1:] != wanted["anchor"][:-1]])
    strings = np.add.reduceat(wanted["n"].astype(np.int64), first)
    count = np.diff(np.r_[first, len(wanted)])
    return np.repeat(np.where(strings + LENGTH * count > BLOCK, -(-strings * LENGTH // BLOCK), 0), count)


def _fetch(buckets: int):
    """The bytes of wanted stretches, dealt by anchor: a record (with the stretch's size in place of its hash), then the bytes."""

    def rows(batches) -> Iterator[tuple]:
        held: dict[int, list] = defaultdict(list)
        size = 0

        singles: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def strings():
            """Single strings: the earliest of equal ones, dealt into blocks; the others are removed."""
            r, data = np.concatenate([x[0] for x in singles]), np.concatenate([x[1] for x in singles])
            grams = _gram_hashes(np.r_[data.ravel(), np.zeros(64, np.uint8)])
            r["bytes"], r["row"] = _whole(grams, np.arange(len(r)) * LENGTH), np.arange(len(r))
            parts = np.concatenate([x[2] for x in singles])
            singles.clear()
            kept, later = _earliest(r)
            for i, th, spans in _spans(later):
                yield (th % buckets), i, th, REMOVED, spans
            kept["anchor"] = mixed(kept["anchor"] ^ mixed(kept["bytes"] % parts[kept["row"]] + np.uint64(1)))
            bucket = (kept["anchor"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                own = kept[order[cut[b] : cut[b + 1]]]
                yield b, None, None, STRINGS, len(own).to_bytes(4, "little") + own.tobytes() + data[own["row"]].tobytes()

        def out():
            if singles:
                yield from strings()
            for b, own in sorted(held.items()):
                yield b, None, None, RECORD, b"".join([len(own).to_bytes(4, "little"), *(x[0] for x in own), *(x[1] for x in own)])
            held.clear()

        for batch in batches:
            for doc, th, text, wants in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "wants")), strict=True):
                raw = text.encode()
                want = np.frombuffer(b"".join(wants), _WANT)
                for w in want[want["parts"] > 0]:
                    n, s = int(w["n"]), int(w["start"])
                    r = np.zeros(n, SINGLE)
                    r["anchor"], r["start"], r["n"], r["id"], r["null"], r["th"] = w["anchor"], s + np.arange(n), 1, doc or 0, doc is None, th
                    rows_ = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8, n - 1 + LENGTH, s), LENGTH)
                    singles.append((r, rows_, np.full(n, w["parts"], np.uint64)))
                    size += n * (LENGTH + SINGLE.itemsize)
                    if size > 16_000_000:
                        yield from out()
                        size = 0
                want = want[want["parts"] == 0]
                r = np.zeros(len(want), STRETCH)
                r["anchor"], r["start"], r["n"], r["id"], r["null"], r["th"] = want["anchor"], want["start"], want["n"], doc or 0, doc is None, th
                r["bytes"] = want["n"].astype(np.uint64) - np.uint64(1) + np.uint64(LENGTH)
                bucket = (want["anchor"] % np.uint64(buckets)).tolist()
                for i, (s, n) in enumerate(zip(want["start"].tolist(), r["bytes"].tolist(), strict=True)):
                    held[bucket[i]].append((r[i].tobytes(), raw[s : s + n]))
                    size += n + STRETCH.itemsize
                if size > 16_000_000:
                    yield from out()
                    size = 0
        yield from out()

    return lambda batches: _batched(rows(batches))


def two_stage_suffix_array(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffix array of bytes in which 0 ends a string (0 sorts first, earlier ends before later ones).

    Suffixes are in order up to ``depth`` bytes at least, or to their ends.
    """
    n = len(text)
    follows = np.r_[text[1:], 0]
    # smaller than the successor: by the next byte that differs
    differs = np.flatnonzero(text != follows)
    nxt = differs[np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)] if len(differs) else np.full(n, n - 1)
    ascending = (text[nxt] < follows[nxt]) & (text != 0)
    b = np.flatnonzero(ascending)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[b].copy()
    for at in range(0, len(b), 65_536):  # what lies behind a suffix's end doesn't count
        own = keys[at : at + 65_536]
        own[np.maximum.accumulate(own == 0, axis=1)] = 0
    b = b[np.argsort(keys.view(f"S{depth}").ravel(), kind="stable")] if len(b) else b
    size = np.bincount(text, minlength=256)
    start = np.cumsum(size) - size
    out = np.full(n, -1, np.int64)
    first_b = start + size - np.bincount(text[b], minlength=256)
    bounds = np.searchsorted(text[b], np.arange(257))
    head = start.copy()
    out[: size[0]] = np.flatnonzero(text == 0)
    for c in range(256):
        if not size[c]:
            continue
        if c:
            out[first_b[c] : start[c] + size[c]] = b[bounds[c] : bounds[c + 1]]
            at = start[c]  # suffixes of the bucket that begin with a run of its byte follow from each other
            while at < head[c]:
                own = out[at : head[c]]
                at = head[c]
                before = own[own > 0] - 1
                more = before[(text[before] == c) & ~ascending[before]]
                out[head[c] : head[c] + len(more)] = more
                head[c] += len(more)
        own = out[start[c] : start[c] + size[c]]
        before = own[own > 0] - 1
        before = before[(text[before] > c) & ~ascending[before]]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            first = text[before]
            cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for x, y in zip(cut, np.r_[cut[1:], len(before)], strict=True):
                d = first[x]
                out[head[d] : head[d] + y - x] = before[x:y]
                head[d] += y - x
    return out


def _equal_strings(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, class) of all strings of LENGTH bytes that occur twice or more, sorted by class."""
    # UTF-8 has no byte above 0xF7, so all bytes move up by one and 0 is free to end a stretch
    data = np.frombuffer(b"\xff".join([*contents, b""]), np.uint8) + np.uint8(1)
    sizes = np.array([len(c) for c in contents])
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = two_stage_suffix_array(data)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(data)) - begins[owner]
    starts = order[offset[order] <= sizes[owner[order]] - LENGTH]
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    shared = np.zeros(len(starts), bool)  # adjacent common prefixes of LENGTH bytes
    for at in range(1, len(starts), 200_000):
        top = min(len(starts), at + 200_000)
        shared[at:top] = (rows[starts[at:top]] == rows[starts[at - 1 : top - 1]]).all(1)
    group = np.cumsum(~shared)
    member = shared | np.r_[shared[1:], False]
    starts, group = starts[member], group[member]
    return owner[starts], offset[starts], group


def _sort_strings(r: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Later ones of equal single strings, block by block."""
    order = np.argsort(r["anchor"], kind="stable")
    anchor = r["anchor"][order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
        own = order[a:b]
        s = r[own]
        # UTF-8 has no byte above 0xF7: moved up by one, none is 0, which numpy takes for an end
        s["anchor"], s["bytes"] = np.unique((data[own] + np.uint8(1)).view(f"S{LENGTH}").ravel(), return_inverse=True)[1], 0
        _, later = _earliest(s)
        yield from _batched((-1, i, th, REMOVED, spans) for i, th, spans in _spans(later))


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over blocks of whole anchors; later strings of each class are removed.

    Strings that come one by one are blocks of LENGTH bytes each: only the suffix that is all of one can match, so these alone
    are sorted.
    """
    records, contents, singles, data = [], [], [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = row[4]
            if row[3] == REMOVED:
                yield _rows([row])
                continue
            n = int.from_bytes(payload[:4], "little")
            if row[3] == STRINGS:
                singles.append(np.frombuffer(payload, SINGLE, n, 4))
                data.append(np.frombuffer(payload, np.uint8, n * LENGTH, 4 + n * SINGLE.itemsize).reshape(n, LENGTH))
                continue
            r = np.frombuffer(payload, STRETCH, n, 4)
            at = 4 + n * STRETCH.itemsize
            for size in r["bytes"].tolist():
                contents.append(payload[at : at + size])
                at += size
            records.append(r)
    if singles:
        yield from _sort_strings(np.concatenate(singles), np.concatenate(data))
    if not records:
        return
    r = np.concatenate(records)
    order = np.argsort(r["anchor"], kind="stable")
    anchor = r["anchor"][order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.add.reduceat(r["bytes"][order].astype(np.int64) + 1, first)
    block = np.cumsum(size) // BLOCK
    cut = np.r_[first[np.flatnonzero(np.r_[True, block[1:] != block[:-1]])], len(order)]
    for a, b in zip(cut, cut[1:], strict=False):
        own = order[a:b]
        place, offset, group = _equal_strings([contents[i] for i in own])
        if not len(place):
            continue
        s = r[own[place]].copy()
        s["start"] += offset.astype(np.int32)
        s["n"], s["anchor"], s["bytes"] = 1, group, 0
        _, later = _earliest(s)
        yield from _batched((-1, i, th, REMOVED, spans) for i, th, spans in _spans(later))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            spans = merged(np.frombuffer(b"".join(packed), SPAN)) if packed else np.zeros(0, SPAN)
            at, kept = 0, []
            for s, e in spans.tolist():
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        a, b, c, d, e = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bytes_out: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept_sha256 and the bytes ``kept``.

    Null texts are empty.  Null ids come after all others; rows with one id are ordered by a hash of their texts; rows that
    repeat id and text are one document, and are given one result each.  What is kept may cut a character in two, so it is
    binary.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # the records of a text are about its size: as many buckets as keep a task's share in memory
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET))
    sent = rows.mapInArrow(_read(n), SENT_DDL)
    # what is removed already only passes through, spread over all tasks
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("id", "th"), F.lit(n)).cast("int"))
    met = materialise(sent.withColumn("bucket", spread).repartition(n, "bucket").mapInArrow(_meet, SENT_DDL))
    key = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    wants = met.filter(F.col("kind") == WANTED).groupBy("id", "th").agg(F.collect_list("payload").alias("wants"))
    fetched = rows.join(wants, key(rows, wants)).select(rows["id"], rows["th"], "text", "wants").mapInArrow(_fetch(n), SENT_DDL)
    found = fetched.repartition(n, "bucket").mapInArrow(_sort_blocks, SENT_DDL)
    gone = met.filter(F.col("kind") == REMOVED).unionByName(found).groupBy("id", "th").agg(F.collect_list("payload").alias("spans"))
    out = rows.join(gone, key(rows, gone), "left").select(rows["id"], "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if bytes_out else []))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), bytes_out=False)
