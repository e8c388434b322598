"""Scoring, classifiers, near-duplicate groups and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import docs, rows  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import katz, language, queries, shingles, simhash, toxicity, vectors
from tallyframe.llm.common import components

DATA = "/root/testdata/sf0.001"


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(n, n + 1) for n in range(30)] + [(100, n) for n in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    want = roots(linked, {n for p in linked for n in p})
    assert got == want


def test_fingerprints_link_as_by_brute_force(docs):
    pick = random.Random(1)
    base = [[f"w{pick.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    table = []
    for doc in range(80):
        words = list(pick.choice(base))
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(len(words))] = f"x{pick.randint(0, 9)}"
        table.append((doc + 5, " ".join(words)))
    table += [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (None, table[0][1]), (90, table[3][1]), (90, table[3][1])]
    prints = [simhash.fingerprint(t) for _, t in table]
    near = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4]
    of = roots(near, set(prints))
    least = {}
    for (doc, _), p in zip(table, prints):
        if doc is not None:
            least[of[p]] = min(least.get(of[p], doc), doc)
    got = simhash.near_duplicates(docs(*table))
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(
        [(doc, f"{p:016x}", least[of[p]]) for (doc, _), p in zip(table, prints)], key=str)
    kept = simhash.one_of_each(docs(*table))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(least.values()))
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == docs().columns
    assert simhash.near_duplicates(docs().limit(0)).count() == 0


def test_every_plan_finds_all_pairs_within_the_limit():
    pick = np.random.default_rng(0)
    sample = pick.integers(0, 2 ** 63, 300, dtype=np.uint64)
    for count in (1_000, 10 ** 6, 10 ** 9):
        plan = simhash.allot(sample, count, 4)
        for _ in range(300):
            bits = pick.choice(64, 4, replace=False)
            change = sum(1 << int(b) for b in bits)
            assert any((change & mask).bit_count() <= radius for mask, radius in plan)


def test_vectors_link_as_by_brute_force(spark):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(12, 16))
    near = [c + 0.08 * pick.normal(size=16) for c in centres for _ in range(pick.integers(1, 30))]
    table = [(n, [float(x) for x in v]) for n, v in enumerate(near + list(pick.normal(size=(60, 16))))]
    table += [(900, table[0][1]), (901, [2 * x for x in table[0][1]]), (902, None), (903, []), (904, [0.0] * 16),
              (905, [float("nan")] + [1.0] * 15), (906, [None] + [1.0] * 15), (907, [1.0] * 3), (None, table[0][1])]
    frame = spark.createDataFrame([(*r, "a", 1) for r in table], "vec_id bigint, embedding array<double>, unit string, n int")
    good = {d: np.array(v) / np.linalg.norm(v) for d, v in table if d is not None and (d < 902)}
    pairs = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= 0.95]
    of, links = roots(pairs, good), Counter(n for p in pairs for n in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    want = {d: (links[d], of[d], of[d] == d) for d in good}
    want |= {d: (0, d, True) for d in range(902, 908)} | {None: (0, None, False)}
    assert got == want
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_visits_are_enough_beside_a_group_of_near_copies():
    pick = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = lambda x, spread: unit(x + spread * pick.normal(size=x.shape))
    tight = near(np.repeat(unit(pick.normal(size=(1, 32))), 1500, 0), 0.002)
    base = unit(pick.normal(size=(1500, 32)))
    # cosines of partners lie around the threshold
    x = np.vstack([tight, base, near(base, 0.055)])
    pick.shuffle(x)
    index = vectors.fit(x, 40_000)
    own, seen = index.cells(x)
    a, b = np.nonzero(np.triu(x @ x.T >= vectors.THRESHOLD, 1))
    in_group = np.isin(np.arange(len(x)), np.flatnonzero((x @ x.T >= 0.999).sum(1) > 1000))
    loose = ~in_group[a]
    seen = [set(s) for s in seen]
    found = np.array([own[q] in seen[p] or own[p] in seen[q] for p, q in zip(a[loose], b[loose])])
    assert len(found) > 500 and found.mean() >= 0.999
    assert index.visits < len(index.first) * len(index.second)


def test_near_documents_go_as_by_brute_force(spark, docs):
    pick = random.Random(8)
    base = [[f"w{pick.randint(0, 4000)}" for _ in range(pick.randint(60, 200))] for _ in range(20)]
    table = []
    for doc in range(150):
        words = list(pick.choice(base))
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(len(words))] = f"x{pick.randint(0, 9)}"
        table.append((doc + 10, " ".join(words)))
    table += [(200 + n, " ".join(base[0][:n] + [f"y{n}"] + base[0][n + 1:])) for n in range(50)]
    table += [(1, None), (2, " "), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (None, table[0][1])]
    pick.shuffle(table)

    def cut(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))) if words else frozenset()
    sets = {d: cut(t) for d, t in table if d is not None}
    like = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    pairs = [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b])]
    of = roots(pairs, sets)
    # many pairs that are near in shingles are not within four bits
    prints = {d: simhash.fingerprint(t, 5) for d, t in table if d is not None}
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in pairs) > len(pairs) / 4
    kept = corpus_pipeline.near_dedup(spark, docs(*table), DATA)
    assert kept.columns == docs().columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(d for d in sets if of[d] == d)
    assert kept.where("doc_id IS NULL").count() == 1
    links = shingles.similar_sets(docs(*table).where("doc_id IS NOT NULL")).count()
    assert links < len(pairs)
    assert corpus_pipeline.near_dedup(spark, docs().limit(0), DATA).count() == 0


def test_near_documents_are_proposed_by_fingerprints_first(spark, docs, monkeypatch):
    pick = random.Random(3)
    base = [[f"w{pick.randint(0, 4000)}" for _ in range(400)] for _ in range(5)]
    table = [(doc, " ".join([*base[doc % 5][:-1], f"x{doc}"])) for doc in range(60)]
    table += [(100 + n, " ".join(f"v{pick.randint(0, 4000)}" for _ in range(50))) for n in range(20)]
    nodes = shingles.coded(docs(*table)).cache()
    prints = {r.node: r.print % 2 ** 64 for r in nodes.collect()}
    assert prints == {r.node: simhash.fingerprint(t, 5) for r, (_, t) in zip(nodes.orderBy("doc_id").collect(), sorted(table))}
    got = [(r.a, r.b) for r in shingles.similar_prints(nodes).collect()]
    assert len(got) < len(prints) and all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in got)
    linked = {n for a in prints for b in prints if a != b and (prints[a] ^ prints[b]).bit_count() <= 4 for n in (a, b)}
    assert len(linked) > 40 and linked == {n for pair in got for n in pair}
    asked, search = [], simhash.hamming_links
    monkeypatch.setattr(simhash, "hamming_links", lambda found, limit: asked.append(limit) or search(found, limit))
    kept = corpus_pipeline.near_dedup(spark, docs(*table), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(5), *range(100, 120)]
    assert asked == [4] and dict(corpus_pipeline.STAGES)["SimHash near-dedup"] is corpus_pipeline.near_dedup


def _probabilities(table, held):
    tokens = {d: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for d, t in table}
    words, pairs, count = Counter(), Counter(), 0
    for d, seen in tokens.items():
        if not held(d):
            words.update(seen)
            pairs.update(zip(["<s>"] + seen[:-1], seen))
            count += 1
    n = sum(words.values())
    of = lambda c: katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)])
    d_words, d_pairs = of(words), of(pairs)
    less = lambda c, d: c - katz.HELD_BACK if c > katz.LARGEST else c * d[c]
    rest = 1 - sum(less(c, d_words) for c in words.values()) / n
    one = lambda w: less(words[w], d_words) / n if words[w] else rest
    contexts = Counter(words)
    contexts["<s>"] = count
    follows = defaultdict(list)
    for (h, w), c in pairs.items():
        follows[h].append((w, c))
    weight = {h: (1 - sum(less(c, d_pairs) for _, c in f) / contexts[h]) / (1 - sum(one(w) for w, _ in f))
              for h, f in follows.items()}
    two = lambda h, w: less(pairs[h, w], d_pairs) / contexts[h] if pairs[h, w] else weight.get(h, 1) * one(w)
    for h in list(follows)[:20]:  # each context's probabilities sum to 1
        assert sum(two(h, w) for w in words) + weight[h] * rest == pytest.approx(1)
    score = {d: sum(math.log10(two(h, w)) for h, w in zip(["<s>"] + s[:-1], s)) for d, s in tokens.items()}
    base = {d: sum(math.log10((words[w] + 0.1) / (n + 0.1 * (len(words) + 1))) for w in s) for d, s in tokens.items()}
    return score, base, n


def test_katz_scores_as_by_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 300)
    pick = random.Random(4)
    table = [(n, " ".join(pick.choice(["a", "the", "Of", f"w{pick.randint(0, 90)}"]) for _ in range(pick.randint(0, 60))))
             for n in range(120)] + [(200, None), (201, "")]
    score, base, n = _probabilities(table, lambda d: d % 4 == 0)
    got = katz.score(docs(*table).repartition(3, "doc_id"), F.col("doc_id") % 4 == 0).collect()
    assert len(got) == len(table)
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id % 4 == 0)
        assert r.score == pytest.approx(score[r.doc_id]) and r.base_score == pytest.approx(base[r.doc_id])
    assert katz.score(docs().limit(0), F.lit(False)).count() == 0
    alone = katz.score(docs((1, "a b")), F.lit(True)).first()
    assert (alone.train_tokens, alone.n_known, alone.score) == (0, 0, 0.0)


def test_languages_and_mixtures(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language.fold_of("doc_id", 5)
    langs, chances = language.learn(table.where(fold != 0))
    assert langs == ["de", "en", "es", "fr"]
    found = language.identify(table.where(fold == 0), langs, chances).join(table.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    one, two = (table.where(f"lang = '{x}' AND length(text) > 900").orderBy("doc_id").first().text[:900] for x in ("de", "es"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, one + " " + two)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.identify(odd, langs, chances).collect()}
    assert [(got[n].lang_pred, got[n].score, got[n].languages) for n in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert {x.lang for x in got[4].languages if x.share > 0.2} == {"de", "es"}
    assert [r.doc_id for r in language.recognised(odd, langs, chances).collect()] == [4]
    none = language.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(odd, *none).collect()} == {"und"}
    assert [r.doc_id for r in language.recognised(odd, *none).collect()] == [4]


def test_toxic_documents_are_found(spark, docs):
    data = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    fold = language.fold_of("doc_id", 5)
    scored = toxicity.fit(table, labels, fold).score(table.where(fold == 0)).join(labels, "doc_id")
    right = (F.col("score") >= 0.5).cast("int") == F.col("toxic")
    assert scored.agg(F.avg(right.cast("int"))).first()[0] > 0.95
    assert scored.where("score < 0 OR score > 1").count() == 0
    few = docs((1, None), (2, ""), (None, "you idiot"))
    blank = labels.limit(0)
    assert [r.score for r in toxicity.fit(few, blank, fold).score(few).collect()] == [0.0] * 3


def test_the_pipeline_keeps_and_removes_what_its_stages_say(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, "123"), (9003, "same words again here"), (9004, "same words again here")],
                                "doc_id bigint, text string")
    docs = table.unionByName(odd, allowMissingColumns=True)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs = corpus_pipeline.pin(docs)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table.columns
    assert counts == sorted(counts, reverse=True)
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {9001, 9002, 9004}
    assert corpus_pipeline.run(spark, DATA).count() <= table.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_native_operators_run_no_python_on_executors(spark):
    for name in ("op1_benchmark_decontamination", "op2_chat_formatting"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
