"""Substring deduplication: seeds that documents share, extended to whole repeated windows.

A window is ``length`` consecutive words. Winnowing gives every window an anchor, the
least hash of the runs of half its length inside it, which depends on the window's words
alone: equal windows have equal anchors. Anchors that two documents share are the
seeds. Around each, the windows that own it are the match extended both ways as far as
it counts, and neighbouring windows that repeat are merged into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import batches, pin, same

LENGTH = 50
CHUNK = 1 << 21  # windows that a task compares among themselves before it sends any
MARKS_PER_SEED, LEAST_MARKS, MOST_MARKS = 16, 20, 30  # bits of the map of seeds, as powers of two at the ends
PIECE_BITS = 16
LAST = 2 ** 63 - 1  # where rows without a doc_id stand

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values, the same wherever they stand."""
    n = len(hashes)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers(_BASE, n))))
    mixed = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n + 1)[:n - k + 1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def windows(text: str | None, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash and anchor of every window of a text, by place; None if it is shorter."""
    words = (text or "").encode().split()
    if len(words) < length:
        return None
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    half = length // 2
    grams = _runs(hashes, half)
    inside = np.lib.stride_tricks.sliding_window_view(grams, length - half + 1)
    return _runs(hashes, length), inside.min(axis=1)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the task's documents with the least and greatest document."""
    anchors, docs, size = [], [], 0
    for batch in rows:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = windows(text, length)
            if found is not None:
                seen = np.unique(found[1])
                anchors.append(seen)
                docs.append(np.full(len(seen), doc))
                size += len(seen)
        if size >= CHUNK:
            yield _extremes(np.concatenate(anchors), np.concatenate(docs))
            anchors, docs, size = [], [], 0
    if anchors:
        yield _extremes(np.concatenate(anchors), np.concatenate(docs))


def _extremes(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    first = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]) != 0)
    last = np.append(first[1:], len(anchor)) - 1
    return pa.RecordBatch.from_arrays([_long(anchor[first]), pa.array(doc[first]), pa.array(doc[last])],
                                      names=["anchor", "low", "high"])


def _piece(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PIECE_BITS, np.uint8)
    slots = table["slot"].to_numpy()
    bits[slots & ((1 << PIECE_BITS) - 1)] = 1
    return pa.table({"piece": [int(slots[0] >> PIECE_BITS)], "bits": [np.packbits(bits).tobytes()]})


def _map_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit map of 2^``bits`` slots; an anchor's slot is its leading bits."""
    slots = seeds.select(F.shiftrightunsigned("anchor", 64 - bits).alias("slot")).distinct().withColumn(
        "piece", F.shiftright("slot", PIECE_BITS))
    marks = np.zeros((1 << (bits - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    for piece, packed in slots.groupBy("piece").applyInArrow(_piece, "piece long, bits binary").collect():
        marks[piece] = np.frombuffer(packed, np.uint8)
    return marks.reshape(-1)


def _ranges(key: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of words under windows at ``at`` of rows ``key``: row, first word, end."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(at, prepend=-1 - length) > length))
    last = np.append(new[1:], len(at)) - 1
    return key[new], at[new], at[last] + length


FOUND = "anchor bigint, doc bigint, body bigint, at bigint, until bigint, windows binary"


def _found(rows: Iterator[pa.RecordBatch], marks, bits: int, length: int) -> Iterator[pa.RecordBatch]:
    """What a task knows of the windows at seeds, and what it has to ask.

    Rows with ``windows`` null are words (at to until) of windows that a smaller document
    of the task has too. The others are windows of a seed, side by side in one
    document, whose smallest document in the task this is.
    """
    held: list[tuple] = []
    names: list[tuple[int, int]] = []
    size = 0
    for batch in rows:
        for doc, body, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = windows(text, length)
            if found is None:
                continue
            slot = found[1] >> np.uint64(64 - bits)
            seed = np.flatnonzero(marks.value[slot >> np.uint64(3)] & (np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8)))
            if len(seed):
                held.append((found[0][seed], found[1][seed], np.full(len(seed), len(names)), seed))
                names.append((doc, body))
                size += len(seed)
        if size >= CHUNK:
            yield from _settle(held, names, length)
            held, names, size = [], [], 0
    if held:
        yield from _settle(held, names, length)


def _settle(held: list[tuple], names: list[tuple[int, int]], length: int) -> Iterator[pa.RecordBatch]:
    window, anchor, row, at = (np.concatenate(c) for c in zip(*held))
    doc, body = np.array(names, np.int64).T
    order = np.lexsort((at, doc[row], window, anchor))
    window, anchor, row, at = window[order], anchor[order], row[order], at[order]
    new = (np.diff(window, prepend=~window[:1]) != 0) | (np.diff(anchor, prepend=~anchor[:1]) != 0)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    mine = doc[row] == doc[row][lead]
    if not mine.all():
        r, a, b = _ranges(row[~mine], at[~mine], length)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(r), pa.int64()), pa.array(doc[r]), pa.array(body[r]), pa.array(a), pa.array(b),
             pa.nulls(len(r), pa.binary())], schema=_SCHEMA)
    window, anchor, row, at = window[mine], anchor[mine], row[mine], at[mine]
    order = np.lexsort((at, row))
    window, anchor, row, at = window[order], anchor[order], row[order], at[order]
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1)
                         | (np.diff(anchor, prepend=~anchor[:1]) != 0))
    end = np.append(cut[1:], len(at))
    for s in range(0, len(cut), 20_000):
        c, e = cut[s:s + 20_000], end[s:s + 20_000]
        packed = pa.array([window[a:b].tobytes() for a, b in zip(c.tolist(), e.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [_long(anchor[c]), pa.array(doc[row[c]]), pa.array(body[row[c]]), pa.array(at[c]), pa.array(at[c] + e - c),
             packed], schema=_SCHEMA)


_SCHEMA = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("at", pa.int64()),
                     ("until", pa.int64()), ("windows", pa.binary())])


def _later(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Words under windows that an earlier document has. Rows come by anchor, then doc."""
    current, first = None, {}
    for batch in rows:
        docs, bodies, starts, ends = [], [], [], []
        for anchor, doc, body, at, packed in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "body", "at", "windows"))):
            if anchor != current:
                current, first = anchor, {}
            run = None
            for n, window in enumerate(np.frombuffer(packed, np.uint64).tolist()):
                if first.setdefault(window, doc) != doc:
                    if run is not None and ends[-1] >= at + n:
                        ends[-1] = at + n + length
                    else:
                        run = n
                        docs.append(doc), bodies.append(body), starts.append(at + n), ends.append(at + n + length)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, bodies, starts, ends)],
                                         names=["doc", "body", "at", "until"])


def _cleaned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        total, gone, kept = [], [], []
        for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words, left, done = (text or "").encode().split(), [], 0
            for cut in sorted(cuts or (), key=lambda c: c["at"]):
                left += words[done:cut["at"]] if cut["at"] > done else []
                done = max(done, cut["until"])
            left += words[done:]
            total.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=[batch.schema.names[0], "n_words", "n_removed", "text"])


def deduplicate(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and the ``text`` kept.

    Every word under a window that also starts in a document with a smaller doc_id goes;
    what stays is joined by single spaces. Windows are judged on the input. Null and
    short texts keep all they have. Rows without a doc_id stand last, and rows that share
    one, or have none, are one document: their windows do not remove each other's.
    """
    spark = documents.sparkSession
    docs = batches(documents.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("body"), "text"))
    seeds = pin(docs.select("doc", "text").mapInArrow(partial(_anchors, length=length), "anchor bigint, low bigint, high bigint")
                .groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                .where("low < high").select("anchor"))
    n = seeds.count()
    bits = min(MOST_MARKS, max(LEAST_MARKS, (n * MARKS_PER_SEED).bit_length()))  # 128 MB at most
    marks = spark.sparkContext.broadcast(_map_of(seeds, bits))
    found = pin(docs.mapInArrow(partial(_found, marks=marks, bits=bits, length=length), FOUND))
    asked = found.where("windows IS NOT NULL").repartition("anchor").sortWithinPartitions("anchor", "doc")
    later = asked.mapInArrow(partial(_later, length=length), "doc bigint, body bigint, at bigint, until bigint")
    cuts = pin(found.where("windows IS NULL").select("doc", "body", "at", "until").union(later)
               .groupBy("doc", "body").agg(F.collect_set(F.struct("at", "until")).alias("cuts")))
    whole = documents.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("body"), "text")
    joined = whole.join(cuts, same(whole, cuts, "doc", "body"), "left").select("doc_id", "text", "cuts")
    return batches(joined).mapInArrow(_cleaned, "doc_id bigint, n_words bigint, n_removed bigint, text string")

