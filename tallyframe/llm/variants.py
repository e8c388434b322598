"""Spelling variants: words one edit apart, found over a reduced alphabet.

The letters are hashed to a few symbols. A word one edit from another is, reduced, the
same string or one edit from it, so the one-edit neighbourhood over the few symbols is
small: every reduced word asks for its neighbours among the reduced words of the
vocabulary, and what answers is verified on the words as they are.

A pair shows up from both of its ends, and is asked for from one: a word asks for its
shorter neighbours (an insertion into the one is a deletion from the other), for those
with a larger symbol at one place, and for its own reduced form. So a neighbourhood is
covered whole, and no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import pin
from tallyframe.llm.kernels import appended, checksums, gathered, split

GAPS = "[^A-Za-zÀ-ÿ]+"
SYMBOLS = 8
RARE = 199  # a run whose checksum this divides loses a letter
MIX = 0x9E3779B97F4A7C15


def vocabulary(documents: DataFrame, letters: int = 6, times: int = 5) -> DataFrame:
    """``word``, ``n``: the words of at least so many letters that occur so often in all documents.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. A run
    loses the letter at h % length if h, the CRC-32 of ``<doc_id>:<run>``, is a multiple
    of 199. A null text has no words; a null doc_id reads as an empty one.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches, ["id", "text"]):
            words = split(texts, GAPS)
            size = pc.binary_length(words.distinct).to_numpy().astype(np.int64)
            start = checksums(pc.binary_join_element_wise(pc.fill_null(ids, ""), "", ":"))
            h = appended(start[words.row], checksums(words.distinct)[words.index], size[words.index])
            cut = h % np.uint32(RARE) == 0
            n = np.bincount(words.index[~cut], minlength=len(words.distinct))
            n[pc.utf8_length(words.distinct).to_numpy() < letters] = 0
            shorter = []
            for word, at in zip(words.distinct.take(pa.array(words.index[cut])).to_pylist(), h[cut].tolist()):
                at %= len(word)
                if len(word) > letters:
                    shorter.append(word[:at] + word[at + 1:])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.distinct.filter(pa.array(n > 0)), pa.array(shorter, words.distinct.type)]),
                 pa.array(np.concatenate([n[n > 0], np.ones(len(shorter), np.int64)]).astype(np.int64))], ["word", "n"])

    part = documents.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(count, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _powers(length: int) -> np.ndarray:
    """Weights of the places of a string of this length, the last one's 1, modulo 2**64."""
    return np.array([pow(MIX, length - 1 - at, 1 << 64) for at in range(length)], np.uint64)


def _reduced(words: list[str]) -> np.ndarray:
    """The symbols, 1 to SYMBOLS, of words of one length, a row a word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)
    return (codes * np.uint64(MIX) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def asked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(key, word, n, own): all that each word asks for; ``own`` marks the key of its own reduced form."""
    for rows, symbols, weights in _by_length(batch):
        form = (symbols * weights).sum(axis=1, dtype=np.uint64)
        found = [(form, np.arange(len(rows)))]
        for more in range(1, SYMBOLS):  # larger symbols only: the other word asks for this one's
            who, place = np.nonzero(symbols + np.uint64(more) <= SYMBOLS)
            found.append((form[who] + np.uint64(more) * weights[place], who))
        # without the letter at a place: those before it move down one, those after it stay
        none = np.zeros((len(rows), 1), np.uint64)
        front = np.concatenate([none, np.cumsum(symbols[:, :-1] * weights[1:], axis=1, dtype=np.uint64)], axis=1)
        back = np.concatenate([np.cumsum((symbols * weights)[:, :0:-1], axis=1, dtype=np.uint64)[:, ::-1], none], axis=1)
        first = np.ones(symbols.shape, bool)
        first[:, 1:] = symbols[:, 1:] != symbols[:, :-1]  # either of two equal neighbours leaves one string
        who, place = np.nonzero(first)
        found.append(((front + back)[who, place], who))
        who = np.concatenate([w for _, w in found])
        own = np.zeros(len(who), bool)
        own[:len(rows)] = True
        yield _rows(batch, np.concatenate([k for k, _ in found]), rows[who], own)


def held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(key, word, n): the key of each word's reduced form."""
    for rows, symbols, weights in _by_length(batch):
        yield _rows(batch, (symbols * weights).sum(axis=1, dtype=np.uint64), rows)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of word: which rows, their symbols, and the weights of the places."""
    words = batch["word"].to_pylist()
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == n)
        yield rows, _reduced([words[at] for at in rows]), _powers(int(n))


def _rows(batch: pa.RecordBatch, keys: np.ndarray, rows: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    taken = [batch[name].take(pa.array(rows)) for name in ("word", "n")]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *taken, *map(pa.array, more)],
                                      ["key", "word", "n", "own"][:3 + len(more)])


def near(words: DataFrame) -> DataFrame:
    """Every pair of words one inserted, deleted or replaced code point apart, once: (a, a_n, b, b_n)."""
    def each(keys):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from keys(batch)
        return task

    words = words.select("word", "n")
    asking = words.mapInArrow(each(asked), "key bigint, a string, a_n bigint, own boolean")
    there = words.mapInArrow(each(held), "key bigint, b string, b_n bigint")
    # words of one reduced form ask for each other, and for themselves
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    return asking.join(there, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def group(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every distinct word.

    ``form`` is the near word of largest n (ties: the first in code-point order) if that is
    at least ``ratio`` times the word's own, else null; ``root`` is the last word reached
    by following forms. A word without near words has n_near 0 and is its own root. An
    empty table gives an empty one.
    """
    words = pin(words.select("word", "n"))
    pairs = near(words)
    both = pairs.selectExpr("explode(array(named_struct('word', a, 'n', a_n, 'near', b, 'near_n', b_n), "
                            "named_struct('word', b, 'n', b_n, 'near', a, 'near_n', a_n))) AS p").select("p.*")
    none = words.selectExpr("word", "n", "CAST(NULL AS string) AS near", "CAST(NULL AS bigint) AS near_n")
    most = both.unionByName(none).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"),
        # a null near word gives a null order, which min_by leaves out
        F.min_by(F.struct("near", "near_n"), F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near"))).alias("best"))
    strong = F.col("best.near_n") >= ratio * F.col("n")
    formed = pin(most.select("word", "n", "n_near", F.when(strong, F.col("best.near")).alias("form"),
                             F.when(strong, F.col("best.near_n")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` ends. Counts grow along a trail, so it has no loops.

    Each round every word takes over where its target had got to, so trails halve.
    """
    reached = pin(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = pin(reached.join(ahead, "root", "left"))
        if not moved.where("further IS NOT NULL").limit(1).count():
            return reached
        reached = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(documents: DataFrame, letters: int = 6, times: int = 5, ratio: int = 5) -> DataFrame:
    """Spelling variants among the words of all documents; see ``vocabulary`` and ``group``."""
    return group(vocabulary(documents, letters, times), ratio)
