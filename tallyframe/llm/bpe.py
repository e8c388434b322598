"""Byte-level BPE over whole texts; long ones are encoded in pieces and joined as a tree."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import batches

PIECE_CHARS = 16_384  # longer texts are encoded in pieces of this many characters
FIRST_WINDOW = 32  # tokens on either side of a join that are encoded anew at first
AGREE = 8  # tokens at both ends of a window that must come out as they were


def load(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file of the tokenizers library.

    Ids must follow the order of merges, as ranks do, so that both libraries merge alike.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("not a byte-level BPE whose ids follow its merges")
    # printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {
        chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={bytes(byte_of[c] for c in token): rank for token, rank in vocab.items()
                         if rank not in {t["id"] for t in spec["added_tokens"]}},
        special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


def encode_text(coder: tiktoken.Encoding, text: str) -> list[int]:
    return coder.encode(text, allowed_special="all")


def join(coder: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """Ids of two neighbouring pieces of one text, as if it had been encoded whole.

    A window around the join is encoded anew, and doubled until its first and last
    tokens come out as the two sides have them, or it spans both. Then every two
    neighbouring tokens of the result stand side by side in one of the three
    encodings, which is what makes a sequence of BPE tokens the right one.
    """
    piece, width = coder.decode_single_token_bytes, FIRST_WINDOW
    while True:
        p, q = max(0, len(left) - width), min(len(right), width)
        while p > 0 and 0x80 <= piece(left[p])[0] < 0xC0:  # windows hold whole characters
            p -= 1
        while q < len(right) and 0x80 <= piece(right[q])[0] < 0xC0:
            q += 1
        window = coder.encode_ordinary(coder.decode_bytes(left[p:] + right[:q]).decode())
        if ((p == 0 or window[:AGREE] == left[p:p + AGREE])
                and (q == len(right) or window[-AGREE:] == right[q - AGREE:q])
                and (p == 0 or q == len(right) or len(window) >= 2 * AGREE)):
            return left[:p] + window + right[q:]
        width *= 2


def join_all(coder: tiktoken.Encoding, pieces: list[list[int]]) -> list[int]:
    while len(pieces) > 1:
        pairs = [join(coder, *pieces[n:n + 2]) for n in range(0, len(pieces) - 1, 2)]
        pieces = pairs + pieces[len(pairs) * 2:]
    return pieces[0] if pieces else []


def _packed(coder: tiktoken.Encoding, ids: list[int]) -> tuple[bytes, str]:
    return np.array(ids, "<u4").tobytes(), coder.decode_bytes(ids).decode("utf-8", "replace")


def _round_trip(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = load(path)
    for batch in rows:
        packed = [_packed(coder, encode_text(coder, t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[0] for p in packed], pa.binary()),
             pa.array([p[1] for p in packed], pa.string())], names=[batch.schema.names[0], "ids", "text"])


def _cut(rows: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of long texts. A special token ends a segment, which is joined on its own."""
    marks = load(path).special_tokens_set
    for batch in rows:
        for doc, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            for segment, part in enumerate(_segments(text, marks)):
                cuts = [part[at:at + size] for at in range(0, len(part), size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(cuts), pa.int64()), pa.array([digest] * len(cuts), pa.string()),
                     pa.array([segment] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int64()),
                     pa.array(cuts, pa.string())], names=["doc_id", "digest", "segment", "piece", "text"])


def _segments(text: str, marks: set[str]) -> list[str]:
    parts = [text]
    for mark in sorted(marks):
        parts = [x for part in parts for x in (_between(part, mark) if part not in marks else [part])]
    return parts


def _between(text: str, mark: str) -> list[str]:
    found = text.split(mark)
    return [x for part in found[:-1] for x in (part, mark)] + [found[-1]]


def _encode(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = load(path)
    kind = _kind(coder)
    for batch in rows:
        ids = [np.array(encode_text(coder, t.as_py()), kind).tobytes() for t in batch.column(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())],
                                         names=[*batch.schema.names[:5], "ids"])


def _kind(coder: tiktoken.Encoding) -> str:
    """Integers in which ids are sent between tasks."""
    return "<u2" if coder.n_vocab <= 1 << 16 else "<u4"


def _join_pieces(path: str) -> Callable[[pa.Table], pa.Table]:
    coders: list[tiktoken.Encoding] = []  # filled once in a task, not once for each text

    def joined(table: pa.Table) -> pa.Table:
        if not coders:
            coders.append(load(path))
        coder, segments = coders[0], {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["segment"], r["piece"])):
            segments.setdefault(row["segment"], []).append(np.frombuffer(row["ids"], _kind(coder)).tolist())
        packed = _packed(coder, [i for pieces in segments.values() for i in join_all(coder, pieces)])
        return pa.table({"doc_id": table["doc_id"][:1], "copies": table["copies"][:1],
                         "ids": pa.array([packed[0]], pa.binary()), "text": [packed[1]]})
    return joined


def round_trip(documents: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` and the ``text`` decoded from them.

    ``ids`` is binary, little-endian unsigned 32-bit integers. A null text is encoded
    as an empty one; strings of special tokens become those tokens. Texts longer
    than ``piece_chars`` are cut, their pieces spread over the tasks, encoded there, and
    joined by text. Rows that share doc_id and text are encoded once and returned each.
    """
    docs = batches(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    long = F.char_length("text") > piece_chars
    short = docs.where(~long).mapInArrow(partial(_round_trip, path=path), "doc_id bigint, ids binary, text string")
    names = ["doc_id", "digest", "segment", "piece"]
    pieces = docs.where(long).select("doc_id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(
        partial(_cut, path=path, size=piece_chars), "doc_id bigint, digest string, segment long, piece long, text string")
    # this grouping also deals the pieces out to all tasks
    coded = (pieces.groupBy(*names).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
             .mapInArrow(partial(_encode, path=path),
                         "doc_id bigint, digest string, segment long, piece long, copies long, ids binary"))
    whole = coded.groupBy("doc_id", "digest").applyInArrow(
        _join_pieces(path), "doc_id bigint, copies bigint, ids binary, text string")
    return short.union(whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "ids", "text"))
