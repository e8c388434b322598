"""Importance resampling towards a target distribution, over hashed n-grams.

Features are the runs of one to three consecutive words, put into buckets by CRC-32.
The buckets' counts in all documents and in all target texts give a gain per bucket; a
document weighs the sum of the gains of its features. Documents are then drawn without
replacement by Gumbel keys: weight plus a noise fixed by seed and doc_id, the highest
first.

Within a task everything runs on columns: the words of some megabytes of text are
lower-cased, split, flattened and dictionary-encoded by Arrow; shifted indices make
pairs, pairs and shifted indices make triples, both encoded again, so that a checksum
is taken once per distinct run; buckets and gains are taken by index and summed by
document. The documents are read twice, and only rows of numbers are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.llm.common import pin
from tallyframe.llm.kernels import appended, checksums, gathered, split

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000  # a table of as many counts, and of as many gains, is all that reaches the driver
LONGEST = 3


def runs(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for each length of run the (bucket, text) of every run, in order."""
    words = split(texts, GAPS)
    first, spaced = checksums(words.distinct), checksums(words.distinct, b" ")
    longer = pa.compute.binary_length(words.distinct).to_numpy().astype(np.int64) + 1
    key, sums, out = words.index, first, []
    for n in range(LONGEST):
        if n:  # the runs one word shorter, followed by the word at their end
            last = words.index[n:]
            coded = pa.array(key[:len(last)] * max(1, len(spaced)) + last).dictionary_encode()
            before, end = np.divmod(coded.dictionary.to_numpy(), max(1, len(spaced)))
            sums = appended(sums[before], spaced[end], longer[end])
            key = coded.indices.to_numpy().astype(np.int64)
        bucket = pa.array((sums % np.uint32(buckets)).astype(np.int64)).take(pa.array(key)).to_numpy()
        row = words.row[n:]
        inside = words.row[:len(row)] == row  # runs do not go from one text into the next
        out.append((bucket[inside], row[inside]))
    return np.bincount(words.row, minlength=len(texts)), out


def counts(table: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts by bucket; each task sends one row a bucket at the most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for (texts,) in gathered(batches, ["text"]):
            for bucket, _ in runs(texts, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    part = table.select("text").mapInArrow(count, "bucket bigint, n bigint")
    return {r.bucket: r.n for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, 1000 times the log of how much likelier it is in the target, counts smoothed by one, as a floor."""
    source, wanted = counts(documents, buckets), counts(target, buckets)
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(wanted.values()) + buckets)
    return np.array([math.floor(1000 * math.log((wanted.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
                     for b in range(buckets)], np.int64)


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (the gains summed) of every document."""
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches, ["doc_id", "text"]):
            n_words, kinds = runs(texts, len(gain))
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for bucket, row in kinds:
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                summed = np.concatenate([[0], np.cumsum(gain.take(bucket))])[ends]
                n, weight = n + np.diff(ends), weight + np.diff(summed)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words.astype(np.int64), n, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    numbers = [StructField(name, LongType()) for name in ("n_words", "n_features", "weight")]
    return documents.select("doc_id", "text").mapInArrow(
        weights, StructType([documents.schema["doc_id"], *numbers]))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """A Gumbel value times 1000, as a floor, fixed by seed and doc_id; null for a null id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``, a row per document.

    Of the N documents of ``least_words`` words or more, floor(percent * N / 100) are
    drawn: the highest scores, ties to the smaller doc_id. ``rank`` is null for the rest.
    A null text has no words, weighs 0 and is never drawn. A null doc_id has neither
    score nor rank and does not count in N. Rows that share a doc_id are drawn each;
    between those that tie in everything the order is open.

    Ranks are places in a range-partitioned sort plus the sizes of the ranges before, so
    no task sees more than its range; equal rows are spread by where they were read.
    """
    kept = ["doc_id", "n_features", "weight", "score"]
    scored = pin(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
                 .withColumn("at", F.monotonically_increasing_id()))
    open_to_draw = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("at")]
    # a place is the number of the range, above 33 bits, and the row's number in it
    placed = pin(scored.where(open_to_draw).repartitionByRange(*order).sortWithinPartitions(*order)
                 .select(*kept, F.monotonically_increasing_id().alias("place")))
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").cast("bigint").alias("size"))
    # a row per range, hence a bounded table
    before = ranges.selectExpr(
        "range", "sum(size) OVER (ORDER BY range) - size AS before", f"({percent} * sum(size) OVER ()) div 100 AS drawn")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(before), F.shiftright("place", 33) == F.col("range")).select(
        *kept, F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return ranked.unionByName(scored.where(~open_to_draw).select(*kept, F.lit(None).cast("bigint").alias("rank")))
