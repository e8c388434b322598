"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

Every window of an item is a record that a document must contain whole. Records and
documents are sets of shingles. For full containment one shingle of a record, its
rarest among the documents, is the prefix that has to be looked up; the place of that
shingle says where the window would lie, its length whether it fits, and the words
there decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import pin, same

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3  # words of a shingle, or all of a shorter window's
BROADCAST_ROWS = 200_000  # prefixes and windows beyond this are joined by a shuffle


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; of a null text none."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes other letters too, so it serves texts that have none
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: ``window`` (its number), ``gram`` (words) and ``n`` (how many)."""
    gram = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))),
                       lambda at: F.slice("w", at, size))
    return (items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
            .select("item_id", F.explode(gram).alias("gram")).distinct()
            .withColumn("window", F.sha2(F.array_join("gram", " "), 256)))


def shingled(source: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each place and shingle length: the source's columns, ``at`` (from 1), ``token``.

    ``w`` holds the words. Place 0 has no token, so that every source row is kept.
    """
    placed = source.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "word"))
    full = F.lit(None).cast("bigint")
    kinds = [F.when((F.col("at") > 0) & (F.col("at") + n - 1 <= F.size("w")),
                    F.xxhash64(F.lit(n), *(F.col("w")[F.col("at") + k - 1] for k in range(n)))).otherwise(full)
             for n in lengths]
    if len(kinds) == 1:
        return placed.drop("word").withColumn("token", kinds[0])
    return placed.drop("word").select("*", F.explode(F.array(*kinds)).alias("token"))


def prefixes(grams: DataFrame, documents: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Each window with its rarest shingle: ``token`` and ``offset`` (words before it)."""
    n = F.least(F.size("gram"), F.lit(SHINGLE))
    tokens = F.transform(F.sequence(F.lit(1), F.size("gram") - n + 1), lambda at: F.struct(
        F.when(n == 1, F.xxhash64(F.lit(1), F.get("gram", at - 1)))
        .when(n == 2, F.xxhash64(F.lit(2), F.get("gram", at - 1), F.get("gram", at)))
        .otherwise(F.xxhash64(F.lit(3), F.get("gram", at - 1), F.get("gram", at), F.get("gram", at + 1)))
        .alias("token"), (at - 1).alias("offset")))
    each = grams.select("window", "gram").distinct().select("window", "gram", F.explode(tokens).alias("t"))
    each = pin(each.select("window", "gram", "t.token", "t.offset"))
    wanted = each.select("token").distinct()
    seen = (shingled(documents, lengths).where("token IS NOT NULL").select("token")
            .join(F.broadcast(wanted) if small else wanted, "token")
            .groupBy("token").agg(F.count("*").alias("df")))
    ranked = each.join(seen, "token", "left").groupBy("window").agg(
        F.min_by(F.struct("token", "offset", "gram"), F.struct(F.coalesce("df", F.lit(0)), "token", "offset")).alias("p"))
    return pin(ranked.select("window", "p.token", "p.offset", "p.gram"))


def occurrences(documents: DataFrame, items: DataFrame, size: int = 10,
                broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Where windows occur, and the items of every window.

    The first frame has one row per document text with hits: ``doc_id``, ``digest`` (of
    the text) and ``hits``, an array of (at, window, n) with places from 1; texts that
    repeat under a doc_id share a row. The second has ``item_id`` and ``window``.
    """
    grams = pin(windows(items, size).select("item_id", "window", "gram"))
    lengths = sorted(r[0] for r in grams.select(F.least(F.size("gram"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    docs = documents.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    small = grams.count() <= broadcast_rows
    prefix = prefixes(grams, docs.select("w"), lengths, small)
    # windows with one prefix are tried together, so that a place costs one row
    probes = prefix.groupBy("token").agg(F.collect_list(F.struct("window", "offset", "gram")).alias("tried"))

    def occurring(tried: Column, at: Column, w: Column) -> Column:
        start = lambda t: at - t["offset"]
        fits = lambda t: (start(t) >= 1) & (start(t) + F.size(t["gram"]) - 1 <= F.size(w))
        equal = lambda t: F.slice(w, F.greatest(start(t), F.lit(1)), F.size(t["gram"])) == t["gram"]
        return F.transform(F.filter(tried, lambda t: fits(t) & equal(t)), lambda t: F.struct(
            start(t).alias("at"), t["window"].alias("window"), F.size(t["gram"]).alias("n")))

    places = shingled(docs, lengths).where("token IS NOT NULL")
    # the join runs in generated code, where a place does not copy its document's words;
    # comparing words, which does not, comes after it and sees matching places only
    # (explode_outer, because the filter that explode implies would move into the join)
    if small:
        found = places.join(F.broadcast(probes), "token").select(
            "doc_id", "digest", F.explode_outer(occurring(F.col("tried"), F.col("at"), F.col("w"))).alias("hit"))
    else:  # places alone are shuffled; candidates meet the words of their document afterwards
        met = places.select("doc_id", "digest", "at", "token").join(prefix, "token").select(
            "doc_id", "digest", "at", F.array(F.struct("window", "offset", "gram")).alias("tried"))
        found = met.join(docs.dropDuplicates(["doc_id", "digest"]).withColumnsRenamed({"doc_id": "d", "digest": "g"}),
                         F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select(
            "doc_id", "digest", F.explode_outer(occurring(F.col("tried"), F.col("at"), F.col("w"))).alias("hit"))
    hits = found.where("hit IS NOT NULL").groupBy("doc_id", "digest").agg(F.collect_set("hit").alias("hits"))
    return hits, grams.select("item_id", "window")


def contamination(documents: DataFrame, items: DataFrame, size: int = 10,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as text).

    A document word is hit when it lies in an occurrence of any window of ``size``
    consecutive words of an item, or of a whole shorter item. Items without words
    have no window; an item without an id marks words but is not listed. Null and
    blank texts have no words. Rows that share a doc_id are judged each by its text.
    """
    hits, owners = occurrences(documents, items, size, broadcast_rows)
    hits = pin(hits)
    by_place = F.array_sort("hits")
    # words covered: each occurrence adds what lies beyond the furthest end so far
    covered = F.aggregate(by_place, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, h: F.struct(
        (s["n"] + F.greatest(F.lit(0), h["at"] + h["n"] - 1 - F.greatest(s["end"], h["at"] - 1))).alias("n"),
        F.greatest(s["end"], h["at"] + h["n"] - 1).alias("end")), lambda s: s["n"])
    named = (hits.select("doc_id", "digest", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window"))
             .join(owners, "window").groupBy("doc_id", "digest")
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    marked = pin(hits.select("doc_id", "digest", covered.cast("bigint").alias("n_hit"))
                 .join(named.withColumnsRenamed({"doc_id": "d", "digest": "g"}),
                       F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
                 .select("doc_id", "digest", "n_hit", "items"))
    docs = documents.select("doc_id", F.xxhash64("text").alias("digest"),
                            F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return docs.join(marked, same(docs, marked, "doc_id", "digest"), "left").select(
        docs["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", none).alias("items"))


def clean(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents, all columns, in which no window of an item occurs."""
    hits, _ = occurrences(documents, items, size)
    bad = pin(hits.select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest")))
    marked = documents.select("*", F.xxhash64("text").alias("__text"))
    leaks = marked["doc_id"].eqNullSafe(bad["__doc"]) & (marked["__text"] == bad["__digest"])
    return marked.join(bad, leaks, "left_anti").select(*documents.columns)
