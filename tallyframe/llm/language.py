"""Language identification by mixtures: which languages make up a text, in what shares."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import batches

BUCKETS = 1 << 16  # trigrams are hashed to so many counters, which bounds the model
SAMPLE_DOCS = 2_000  # about so many labelled documents of a language are learned from
MAX_LANGUAGES = 128  # the most frequent labels that are learned
MAX_MIXED = 3  # most languages in one text
PENALTY = 6.0  # log-likelihood that a further language must add, in units of log(trigrams)
ROUNDS = 12  # of expectation-maximisation
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the lower-cased text's trigrams of letters and gaps; none without a letter."""
    plain = _GAPS.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, plain)):
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {plain.strip()} ".encode("utf-32-le"), np.uint32)
    mixed = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(668265263)) >> np.uint32(16)).astype(np.int64)


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in rows:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            seen += np.bincount(trigrams(text), minlength=BUCKETS)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": list(total), "counts": [c.tobytes() for c in total.values()]})


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
    return pa.table({"lang": table["lang"][:1], "counts": [total.tobytes()]})


def learn(documents: DataFrame, sample_docs: int = SAMPLE_DOCS,
          max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of every trigram bucket in each.

    Documents have ``doc_id``, ``text`` and ``lang``. Of each language about ``sample_docs``
    documents are used, chosen by a hash of their id; rows without a language are not.
    """
    labelled = documents.where("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample_docs / n))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    counted = (batches(sample).repartition(8).mapInArrow(_counts, "lang string, counts binary")
               .groupBy("lang").applyInArrow(_summed, "lang string, counts binary").collect())
    counts = {r[0]: np.frombuffer(r[1], np.int64) for r in counted if np.frombuffer(r[1], np.int64).any()}
    langs = sorted(counts)
    table = np.array([counts[lang] for lang in langs], float).reshape(-1, BUCKETS) + 0.5
    return langs, table / table.sum(axis=1, keepdims=True)


def mixture(chance: np.ndarray, n: np.ndarray, doc: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: their language shares and log-likelihoods.

    ``chance`` holds P(trigram | language) and ``n`` the count of each entry, ``doc`` the
    text an entry belongs to (ascending, each text has some). Languages whose share
    starts at zero stay out.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(n, first)[:, None]
    for _ in range(ROUNDS):
        joint = chance * share[doc]
        joint *= (n / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, first, axis=0) / total
    fit = np.add.reduceat(n * np.log((chance * share[doc]).sum(axis=1)), first)
    return share, fit


def shares(texts: list[str | None], table: np.ndarray, penalty: float = PENALTY) -> list[np.ndarray | None]:
    """Language shares of each text, None where it has no letter or nothing is learned.

    EM over all languages ranks them; EM over the best one, two and three then gives
    the likelihood of each set, and the set with the best penalised one is taken.
    """
    grams = [np.unique(trigrams(t), return_counts=True) for t in texts]
    known = [k for k, (buckets, _) in enumerate(grams) if len(buckets) and len(table)]
    found: list[np.ndarray | None] = [None] * len(texts)
    if not known:
        return found
    doc = np.repeat(np.arange(len(known)), [len(grams[k][0]) for k in known])
    n = np.concatenate([grams[k][1] for k in known]).astype(float)
    chance = table.T[np.concatenate([grams[k][0] for k in known])]
    size = np.bincount(doc, weights=n)
    start = np.full((len(known), len(table)), 1 / len(table))
    overall, _ = mixture(chance, n, doc, start)
    order = np.argsort(-overall, axis=1, kind="stable")
    best = np.full(len(known), -np.inf)
    chosen = start
    for mixed in range(1, min(MAX_MIXED, len(table)) + 1):
        allowed = np.zeros_like(start)
        np.put_along_axis(allowed, order[:, :mixed], 1 / mixed, axis=1)
        share, fit = mixture(chance, n, doc, allowed)
        worth = fit - penalty * (mixed - 1) * np.log(size + 1)
        chosen = np.where((worth > best)[:, None], share, chosen)
        best = np.maximum(best, worth)
    for k, row in zip(known, chosen):
        found[k] = row
    return found


def _identify(rows: Iterator[pa.RecordBatch], langs: list[str], table) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = shares(batch.column(1).to_pylist(), table.value)
        lead = [None if s is None else int(s.argmax()) for s in found]
        mixes = [[] if s is None else [{"lang": langs[k], "share": float(s[k])}
                                       for k in np.argsort(-s, kind="stable") if s[k] >= 0.01] for s in found]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([UNKNOWN if k is None else langs[k] for k in lead], pa.string()),
            pa.array([0.0 if k is None else min(1.0, float(s[k])) for k, s in zip(lead, found)]),
            pa.array(mixes, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
            names=[batch.schema.names[0], "lang_pred", "score", "languages"])


def identify(documents: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``, ``languages``.

    ``lang_pred`` is the language with the largest share and ``score`` that share; ``und``
    and 0 for a text that is null or has no letter, or if nothing was learned.
    ``languages`` lists the shares of the chosen set. Only the text is looked at.
    """
    spread = documents.sparkSession.sparkContext.broadcast(table)  # MAX_LANGUAGES * BUCKETS numbers at most
    return batches(documents.select("doc_id", "text")).mapInArrow(
        partial(_identify, langs=langs, table=spread),
        "doc_id bigint, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def _recognised(rows: Iterator[pa.RecordBatch], langs: list[str], table) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = shares(texts, table.value) if langs else [len(trigrams(t)) or None for t in texts]
        yield batch.filter(pa.array([s is not None for s in found], pa.bool_()))


def recognised(documents: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """The documents, all columns, in which a language is found: not those that are ``und``.

    If no language was learned, those with a letter.
    """
    spread = documents.sparkSession.sparkContext.broadcast(table)  # MAX_LANGUAGES * BUCKETS numbers at most
    return batches(documents).mapInArrow(partial(_recognised, langs=langs, table=spread), documents.schema)
