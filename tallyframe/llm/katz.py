"""Katz backoff: Good-Turing discounted bigrams that back off to unigrams.

The texts are cut into chunks. A chunk asks for the counts of its distinct words and
pairs, and the questions of all chunks meet in buckets by hash, where they are summed
and answered. So a hot word is one question for each chunk, and no table of counts is
ever held by one task. Columns of numbers go packed, many to a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import batches, pin

CHUNK_TOKENS = 2_000_000  # tokens that a task handles at a time
BUCKET_TOKENS = 1_500_000  # tokens of the corpus for each bucket
LARGEST = 5  # counts above this are taken as they are, but for HELD_BACK
HELD_BACK = 0.5  # taken off larger counts, so that every context keeps mass for the unseen
END, START = np.uint64(1), np.uint64(2)  # hashes that stand for the end and start of a text
ALPHA = 0.1  # of the additive base model


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return zstandard.compress(planes, 1)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    flat, size = np.frombuffer(zstandard.decompress(packed), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, "u8"), dtype=np.uint64)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


class Chunk:
    """Tokens of some documents: ``doc`` and ``context`` of each, its distinct words and pairs."""

    def __init__(self, part: int, docs: list, held: list[bool], sizes: list[int], tokens: np.ndarray):
        self.part, self.docs, self.held, self.sizes = part, docs, np.array(held), np.array(sizes)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.tokens = tokens
        before = np.concatenate(([START], tokens[:-1]))
        before[np.cumsum(self.sizes)[:-1]] = START
        self.learned = ~self.held[self.doc]
        self.words, self.word = np.unique(np.append(tokens, START), return_inverse=True)
        self.context = np.append(self.word[-1], self.word[:-2])
        self.context[before == START] = self.word[-1]
        self.word = self.word[:-1]
        self.pairs, self.first, self.pair = np.unique(_pairs(before, tokens), return_index=True, return_inverse=True)


def chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of (doc_id, held_out, text) rows, numbered by the task's partition."""
    part = TaskContext.get().partitionId() << 32
    docs, held, sizes, tokens, total = [], [], [], [], 0
    digest = xxhash.xxh64_intdigest
    for batch in rows:
        for doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = np.array([digest(w) for w in (text or "").encode().lower().split()] + [int(END)], np.uint64)
            docs.append(doc), held.append(out), sizes.append(len(found)), tokens.append(found)
            total += len(found)
            if total >= CHUNK_TOKENS:
                yield Chunk(part, docs, held, sizes, np.concatenate(tokens))
                docs, held, sizes, tokens, total, part = [], [], [], [], 0, part + 1
    if docs:
        yield Chunk(part, docs, held, sizes, np.concatenate(tokens))


def _buckets(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys; a bucket is their leading bits."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))


ASKED = "kind int, bucket long, part long, keys binary, counts binary"
ANSWERED = "kind int, bucket long, part long, totals binary, owned binary, stats array<long>"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)],
                                      names=[n for n, _ in fields])


def _ask(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(rows):
        for kind, keys, of in ((0, chunk.words, chunk.word), (1, chunk.pairs, chunk.pair)):
            counts = np.bincount(of[chunk.learned], minlength=len(keys)).astype(np.uint32)
            yield _batch(ASKED, [(kind, b, chunk.part, _pack_keys(keys[i:j]), _pack(counts[i:j]))
                                 for b, i, j in _buckets(keys, bits)])


def _answer(table: pa.Table) -> pa.Table:
    """Totals for each chunk's keys of a bucket. A pair belongs to the first chunk that asks."""
    asked = table.to_pylist()
    keys = [_unpack_keys(r["keys"]) for r in asked]
    unique, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.zeros(len(unique), np.int64)
    np.add.at(totals, where, np.concatenate([_unpack(r["counts"], "u4") for r in asked]).astype(np.int64))
    owned = np.zeros(len(where), bool)
    owned[first] = True
    ends = np.cumsum([len(k) for k in keys])
    stats = [int((totals > 0).sum()), int(totals.sum()), *np.bincount(totals[totals <= LARGEST + 1], minlength=LARGEST + 2)[1:].tolist()]
    out = [(r["kind"], r["bucket"], r["part"], _pack(totals[where[e - len(k):e]]), np.packbits(owned[e - len(k):e]).tobytes(),
            stats if n == 0 else None) for n, (r, k, e) in enumerate(zip(asked, keys, ends))]
    return pa.Table.from_batches([_batch(ANSWERED, out)])


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts d_1.. of counts up to LARGEST, from n_1.. counts of counts (Katz's form).

    Where the counts of counts are too irregular for it, the discount is that of taking off HELD_BACK.
    """
    out = np.ones(LARGEST + 1)
    common = (LARGEST + 1) * n[LARGEST] / n[0] if n[0] else 1.0
    for r in range(1, LARGEST + 1):
        turing = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - HELD_BACK / r
    return out


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discount."""
    return np.where(counts > LARGEST, counts - HELD_BACK, counts * d[np.minimum(counts, LARGEST)])


class Model:
    """Totals of the training texts, and discounts of words and pairs."""

    def __init__(self, docs: int, words: list[int], pairs: list[int]):
        self.docs, self.types, self.tokens = docs, words[0], words[1]
        self.of_words, self.of_pairs = discounts(words[2:]), discounts(pairs[2:])

    def unigram(self, counts: np.ndarray, unknown: float) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.of_words) / max(1, self.tokens), unknown)


def _chunk_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(rows):
        yield _batch(CHUNKS, [(c.part, _pack(np.array([-1 if d is None else d for d in c.docs], np.int64)),
                               np.packbits([d is None for d in c.docs]).tobytes(), np.packbits(c.held).tobytes(),
                               _pack(c.sizes.astype(np.int64)), _pack_keys(c.words), _pack(c.word.astype(np.uint32)))])


CHUNKS = "part long, docs binary, nulls binary, held binary, sizes binary, words binary, word binary"
SCORED = ("kind int, bucket long, part long, at long, doc_id long, held_out boolean, n_tokens long, n_known long, "
          "base_score double, score double, keys binary, one binary, two binary")


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _score(chunk_rows: pa.Table, answers: pa.Table, model: Model, unknown: float, bits: int) -> pa.Table:
    """What a chunk knows from its answers.

    Kind 0: documents, scored but for the backoff weights. Kind 1, by bucket: for the
    contexts whose pairs the chunk owns, their discounted counts and the unigram mass of
    what follows. Kind 2: contexts whose weight a document needs, and how often.
    """
    if not chunk_rows.num_rows:
        return pa.Table.from_batches([_batch(SCORED, [(None,) * 13])]).slice(1)
    row = chunk_rows.to_pylist()[0]
    sizes, words = _unpack(row["sizes"], "i8"), _unpack_keys(row["words"])
    n = len(sizes)
    docs = [None if null else d for d, null in zip(_unpack(row["docs"], "i8").tolist(), _bits(row["nulls"], n))]
    chunk = Chunk(row["part"], docs, _bits(row["held"], n).tolist(), sizes.tolist(), words[_unpack(row["word"], "u4")])
    by_kind: dict[int, list] = {0: [], 1: []}
    for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
        by_kind[r["kind"]].append(r)
    count, total = (np.concatenate([_unpack(r["totals"], "i8") for r in by_kind[k]]) for k in (0, 1))
    if len(count) != len(chunk.words) or len(total) != len(chunk.pairs):
        raise RuntimeError("the documents were read in another order than before; read them from files")
    owned = np.concatenate([_bits(r["owned"], len(_unpack(r["totals"], "i8"))) for r in by_kind[1]]) & (total > 0)
    count = count.copy()
    seen_as_word = count.copy()
    count[np.searchsorted(chunk.words, START)] = model.docs  # every learned text starts once
    one = model.unigram(seen_as_word, unknown)
    less = _discounted(total, model.of_pairs)
    at, before = chunk.word, chunk.context
    pair_total, context_total = total[chunk.pair], count[before]
    logs = np.log10(np.where(pair_total > 0, less[chunk.pair] / np.maximum(context_total, 1), one[at]))
    starts = np.cumsum(sizes) - sizes
    base = np.log10((seen_as_word[at] + ALPHA) / (model.tokens + ALPHA * (model.types + 1)))
    sums = lambda x: np.add.reduceat(x, starts)
    out = [(0, None, chunk.part, k, docs[k], held, size, known, b, s, None, None, None) for k, (held, size, known, b, s) in enumerate(zip(
        chunk.held.tolist(), sizes.tolist(), sums((seen_as_word[at] > 0).astype(np.int64)).tolist(), sums(base).tolist(), sums(logs).tolist()))]
    own = np.flatnonzero(owned)
    h, w = before[chunk.first[own]], at[chunk.first[own]]
    mass = np.bincount(h, weights=less[own], minlength=len(words))
    follow = np.bincount(h, weights=one[w], minlength=len(words))
    has = np.flatnonzero(mass > 0)
    out += [(1, b, chunk.part, None, None, None, None, None, None, None, _pack_keys(chunk.words[has[i:j]]),
             _pack(np.stack([mass[has[i:j]], follow[has[i:j]]], axis=1).reshape(-1)), _pack(count[has[i:j]]))
            for b, i, j in _buckets(chunk.words[has], bits)]
    needs = np.flatnonzero((pair_total == 0) & (context_total > 0))
    order = np.lexsort((chunk.doc[needs], before[needs]))
    needs = needs[order]
    keys = chunk.words[before[needs]]
    out += [(2, b, chunk.part, None, None, None, None, None, None, None, _pack_keys(keys[i:j]),
             _pack(chunk.doc[needs[i:j]].astype(np.int64)), None) for b, i, j in _buckets(keys, bits)]
    return pa.Table.from_batches([_batch(SCORED, out)])


def _weights(table: pa.Table) -> pa.Table:
    """Backoff weights of a bucket's contexts, summed for the documents that need them."""
    rows = table.to_pylist()
    given, asked = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 2]
    if not asked:
        return pa.table({"part": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "more": pa.array([], pa.float64())})
    sums = [_unpack(r["one"], "f8").reshape(-1, 2) for r in given]
    keys, first, where = np.unique(np.concatenate([_unpack_keys(r["keys"]) for r in given]), return_index=True, return_inverse=True)
    total = np.concatenate([_unpack(r["two"], "i8") for r in given])[first]
    mass, follow = (np.bincount(where, weights=np.concatenate(sums)[:, k], minlength=len(keys)) for k in (0, 1))
    log_weight = np.log10((1 - mass / total) / (1 - follow))
    parts, places, more = [], [], []
    for r in asked:
        doc = _unpack(r["one"], "i8")
        need = log_weight[np.searchsorted(keys, _unpack_keys(r["keys"]))]
        found, spot = np.unique(doc, return_inverse=True)
        parts += [r["part"]] * len(found)
        places += found.tolist()
        more += np.bincount(spot, weights=need).tolist()
    return pa.table({"part": pa.array(parts, pa.int64()), "at": pa.array(places, pa.int64()), "more": pa.array(more, pa.float64())})


def score(documents: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10 probabilities of the whole text.

    The model learns from documents where ``held_out`` is false. Words are lower-cased (A-Z)
    and split at ASCII white space; each text ends in a token of its own, so a null or
    empty text is that one token. A pair seen in training has its discounted relative
    frequency; another has its context's backoff weight times the word's unigram
    probability, the weight being what makes the context's probabilities sum to 1. A
    context not seen has weight 1. Unseen words share the mass that discounting takes
    from the unigrams, as one unknown word. Words and pairs are told apart by 64-bit
    hashes. The documents are read twice and must come from files, in one order.
    """
    docs = batches(documents.select("doc_id", held_out.alias("held_out"), "text"))
    chars, learned = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    bits = max(1, math.ceil(math.log2(max(2, chars / 6 / BUCKET_TOKENS))))
    answers = pin(docs.mapInArrow(partial(_ask, bits=bits), ASKED).groupBy("kind", "bucket").applyInArrow(_answer, ANSWERED))
    told = {r[0]: [int(x) for x in r[1:]] for r in answers.where("stats IS NOT NULL").groupBy("kind").agg(
        *(F.sum(F.col("stats")[k]) for k in range(LARGEST + 3))).collect()}
    model = Model(learned, *(told.get(k, [0] * (LARGEST + 3)) for k in (0, 1)))
    # mass that discounting leaves to the unknown word
    counts = told.get(0, [0] * (LARGEST + 3))
    small = counts[2:2 + LARGEST]
    kept = sum(r * n * model.of_words[r] for r, n in enumerate(small, 1))
    kept += model.tokens - sum(r * n for r, n in enumerate(small, 1)) - HELD_BACK * (model.types - sum(small))
    unknown = 1 - kept / model.tokens if model.tokens else 1.0
    scored = pin(docs.mapInArrow(_chunk_rows, CHUNKS).groupBy("part").cogroup(
        answers.select("kind", "bucket", "part", "totals", "owned").groupBy("part")).applyInArrow(
        partial(_score, model=model, unknown=unknown, bits=bits), SCORED))
    more = (scored.where("kind > 0").select("kind", "bucket", "part", "keys", "one", "two").groupBy("bucket")
            .applyInArrow(_weights, "part bigint, at bigint, more double")
            .groupBy("part", "at").agg(F.sum("more").alias("more")))
    return scored.where("kind = 0").join(more, ["part", "at"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
