"""Importance resampling, spelling variants and page extraction against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import docs, rows  # noqa: F401

from tallyframe.llm import importance, kernels, markup, variants, wrapper

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_checksums_of_joined_strings():
    pick = random.Random(2)
    left, right = ([pick.randbytes(pick.choice([0, 1, 7, 300, 70_000])) for _ in range(40)] for _ in range(2))
    got = kernels.appended(np.array([zlib.crc32(a) for a in left], np.uint32), np.array([zlib.crc32(b) for b in right]),
                           np.array(list(map(len, right))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]
    assert kernels.appended(*[np.zeros(0, np.uint32)] * 3).tolist() == []


def test_texts_are_gathered_whole_and_in_order():
    table = pa.table({"id": list(range(50)), "text": [None if n % 7 == 0 else "x" * (n * 37 % 90) for n in range(50)]})
    pieces = list(kernels.gathered(iter(table.to_batches(max_chunksize=9)), ["id", "text"], limit=200))
    assert sum((p[0].to_pylist() for p in pieces), []) == list(range(50))
    assert sum((p[1].to_pylist() for p in pieces), []) == table["text"].to_pylist()
    assert len(pieces) > 3 and all(sum(len(t or "") for t in p[1].to_pylist()) < 300 for p in pieces)


def _resampled(table, target, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[n:n + k]).encode()) % 10_000
                            for k in (1, 2, 3) for n in range(len(words) - k + 1)]
    split = [(d, *features(t)) for d, t in table]
    source, wanted = Counter(b for _, _, f in split for b in f), Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(source.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in range(10_000)]
    out = []
    for doc, n_words, found in split:
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(found), weight, score, n_words >= least and doc is not None))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: n + 1 for n, r in enumerate(fit[:percent * len(fit) // 100])}
    return [(*r[:4], rank.get(r[0]) if r[4] else None) for r in out]


def test_resampling_equals_the_plain_version(spark, docs):
    pick = random.Random(6)
    words = ["The", "of", "naïve", "É", "漢字", "x1", *[f"w{n}" for n in range(40)]]
    text = lambda n: " ,".join(pick.choice(words) for _ in range(n)) + "!"
    table = [(n, text(pick.randint(0, 60))) for n in range(150)]
    table += [(900, None), (901, ""), (902, "..."), (None, text(30)), (903, "w1 " * 30_000), (904, text(19)), (905, text(20))]
    target = [text(50), None, "", "w1 w2 w3 w4"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    gain = importance.gains(docs(*table), bench)
    got = importance.draw(importance.weigh(docs(*table).repartition(5), gain), percent=30)
    assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(
        _resampled(table, target, 30, 20), key=str)


def test_resampling_of_nothing_ties_and_repeated_rows(docs):
    empty = docs().limit(0)
    gain = importance.gains(empty, empty)
    assert not gain.any() and importance.draw(importance.weigh(empty, gain)).count() == 0
    same = " ".join(f"w{n}" for n in range(25))
    got = importance.draw(importance.weigh(docs(*[(7, same)] * 40, *[(8, same)] * 40), gain), percent=50)
    ranks = sorted((r["rank"], r.doc_id) for r in got.collect() if r["rank"])
    assert [n for n, _ in ranks] == list(range(1, 41))
    assert len({doc for _, doc in ranks}) == 1 and {r.weight for r in got.collect()} == {0}


def _variants(table, letters, times, ratio):
    count = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= letters:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= times}
    near, form = defaultdict(set), {}
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or (
                    len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))):
                near[a].add(b)
                near[b].add(a)
    for a in n:
        best = min(near[a], key=lambda w: (-n[w], w), default=None)
        if best and n[best] >= ratio * n[a]:
            form[a] = best
    out = []
    for a in n:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, n[a], len(near[a]), n.get(form.get(a))))
    return out


@pytest.mark.parametrize("letters, times, ratio", [(1, 1, 2), (4, 2, 3)])
def test_variants_equal_the_plain_version(docs, letters, times, ratio):
    pick = random.Random(letters)
    base = ["".join(pick.choice("abnéÿT") for _ in range(pick.randint(1, 7))) for _ in range(30)]
    table = []
    for doc in range(60):
        text = []
        for _ in range(pick.randint(0, 60)):
            word = base[min(pick.randrange(30), pick.randrange(30))]
            if pick.random() < 0.2:
                at = pick.randrange(len(word))
                word = word[:at] + pick.choice(["", "a", word[at] + "é"]) + word[at + 1:]
            text.append(word)
        table.append((doc, pick.choice([" ", "-", "1"]).join(text)))
    table += [(70, None), (71, ""), (None, " ".join(base)), (72, base[0] * 3000), (73, table[3][1]), (73, table[3][1])]
    got = variants.variants(docs(*table).repartition(3), letters, times, ratio)
    assert rows(got, "word", "form", "root", "n", "n_near", "form_n") == sorted(_variants(table, letters, times, ratio), key=str)


def test_variants_of_nothing_and_a_long_trail(spark, docs):
    assert variants.variants(docs().limit(0)).count() == 0
    trail = [("m" * 4 + "a" * n, 2 ** n) for n in range(12)]
    got = variants.group(spark.createDataFrame(trail, "word string, n bigint"), ratio=2)
    assert {r.root for r in got.collect()} == {trail[-1][0]}


def test_every_near_pair_is_met_once(spark):
    pick = random.Random(8)
    words = list({"".join(pick.choice("abc") for _ in range(pick.randint(1, 5))) for _ in range(150)})
    got = [frozenset((r.a, r.b)) for r in variants.near(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect()]
    one = lambda a, b: a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or (
        abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1:] == min(a, b, key=len) for k in range(6))))
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in words for b in words if one(a, b)}


def text_of(page):
    return "\n".join(markup.layout(page)[2])


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain <b>te</b>xt &amp; &eacute;&#33;", "plain text & é!"),
    ("<p>a<p>b <br>c<li>d</p>e", "a\nb c\nd\ne"),
    ("<nav>x</nav><header>y</header><article><header><h1>T\n 1</h1></header><p>b<aside>z</aside></article><footer>q", "T 1\nb"),
    ("<main><p>m</p><article><p>a</article></main><p>out", "a"),
    ("<div role=main>r<form>f<input></form></div>s", "r"),
    ("<div class='articleBody'><p>one<script>if (a</b) '</p>'</script> two</div><div>no", "one two"),
    ("<p>a <button>push</button> b</p><select><option>1<option>2</select>", "a b"),
    ("<div class=\"cookie-notice\">c</div><div id=sideBar-nav>s</div><body class='nav-open'><p>t</p><section id=comments><p>r", "t"),
    ("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v</dl>", "1\n2\n3\nk\nv"),
    ("<!-- <p>no --><p title='a > b'>yes<!-- open", "yes"), ("a < b <3 </>c", "a < b <3 c"),
    ("<article></article><p>body stays", "body stays"), ("<style>p{}", ""), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
])
def test_pages_are_read_as_browsers_do(page, want):
    assert text_of(page) == want


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y") == "x\ny"
    assert len(text_of("<p>w w</p>" * 30_000)) == 4 * 30_000 - 1
    assert text_of("<p>" + "<a href='" * 2000) in ("", "<a href='" * 2000)


def test_simple_tree_matching():
    a = markup.read_signature("a(b(# #) c(#) d(e(#)))", 0)
    assert markup.matching(a, a) == markup.size(a) == 9
    assert markup.matching(a, markup.read_signature("a(c(#) b(# #) d(#))", 1)) == 5  # crossing parts match once: a, b, #, #, d
    assert markup.matching(a, markup.read_signature("x(b(#))", 1)) == 0
    form, found = markup.aligned([(5, "a(b(#) d(#))"), (9, "a(b(#) c(#) d(#))"), (7, "body(#)"), (5, "a(b(#) d(#))")])
    assert found[5] == [found[9][0], found[9][2]] and found[7][0] not in found[9]
    assert len(re.findall("#", form)) == 4


def test_templates_are_induced_where_pages_do_not_say(spark, monkeypatch):
    pick = random.Random(3)
    words = lambda n: " ".join(f"w{pick.randint(0, 9999)}" for _ in range(n))
    pages, want = [], {}
    for n in range(120):
        paragraphs = [words(12) for _ in range(pick.randint(1, 5))]
        title = words(4)
        menu = "".join(f"<li>m{pick.randint(0, 2)}</li>" for _ in range(3))
        extra = "<div><em>best of</em> the week</div>" if n % 3 else ""
        pages.append((n, "https://Plain.example/" + str(n), "x", f"<div><ul>{menu}</ul></div><div><h1>{title}</h1>"
                      + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div>{extra}<div>All rights kept</div>"))
        want[n] = "\n".join([title, *paragraphs])
    # a host of few pages proves nothing: all of it stays
    pages += [(200 + n, "http://few.example", "x", "<div>same</div><p>all the same</p>") for n in range(3)]
    want |= {200 + n: "same\nall the same" for n in range(3)}
    # copies of one article do not make it template, wherever they stand
    pages += [(300 + n, "http://copies.example/a", "x", f"<nav>{n}</nav><article><h1>one</h1><p>text</article>") for n in range(40)]
    want |= {300 + n: "one\ntext" for n in range(40)}
    # a marked article with a fixed line of its own
    pages += [(400 + n, "http://marked.example", "x", f"<article><h6>Share this</h6><p>{n} a<p>{n} b</article>") for n in range(20)]
    want |= {400 + n: f"{n} a\n{n} b" for n in range(20)}
    pages += [(500, None, "x", None), (501, "", "x", ""), (502, "no url", "x", "<p>t"), (502, "no url", "x", "<p>t")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, text string, html string").repartition(4)
    expected = sorted([(p, want.get(p, "t" if p == 502 else "")) for p, *_ in pages])
    for fan_in, limit in ((1024, wrapper.BROADCAST_BYTES), (2, 0)):  # one task a host and a broadcast; many and a shuffle
        monkeypatch.setattr(wrapper, "FAN_IN", fan_in)
        got = wrapper.extract(table, broadcast_bytes=limit)
        assert sorted((r.page_id, r.text) for r in got.collect()) == expected
    assert wrapper.extract(table.limit(0)).count() == 0


def test_layouts_aligned_in_parts_share_one_template(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "FAN_IN", 2)
    pick = random.Random(4)
    tags = ["p", "h2", "ul.x", "div.y", "dl.z"]
    forms = sorted({"body(" + " ".join(f"{t}(#)" for t in tags if pick.random() < 0.6) + " pre(#))" for _ in range(40)})
    table = spark.createDataFrame([("h", n, f) for n, f in enumerate(forms)], "host string, layout bigint, form string")
    got = defaultdict(dict)
    for r in wrapper.slots(table).collect():
        got[r.layout][r.leaf] = r.slot
    assert len(got) == len(forms)
    tag_of = {}
    for n, form in enumerate(forms):
        order = [got[n][leaf] for leaf in sorted(got[n])]
        assert order == sorted(set(order))  # alignment keeps order
        for slot, tag in zip(order, re.findall(r"([a-z0-9.]+)\(#\)", form)):
            assert tag_of.setdefault(slot, tag) == tag
    assert len(tag_of) < 3 * len(tags)  # parts that saw no common order may repeat a tag


def test_extracted_pages_equal_the_plain_version(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = []
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", b.replace("<b>", ""))).split())
                  for b in re.split("</?(?:p|h1)>", article)]
        want.append((r.page_id, "\n".join(b for b in blocks if b)))
    assert sorted((r.page_id, r.text) for r in wrapper.extract(pages).collect()) == sorted(want)


def test_vectors_of_every_length_link_among_themselves(spark):
    from tallyframe.llm import vectors

    pick = random.Random(11)
    rows, at = [], 0
    for length, count in ((2, 30), (3, 12), (1, 4), (5, 1), (8, 20)):
        base = [[pick.gauss(0, 1) for _ in range(length)] for _ in range(3)]
        for _ in range(count):
            rows.append((at, [x + pick.gauss(0, 0.05) for x in pick.choice(base)]))
            at += 1
    rows += [(200, None), (201, []), (202, [0.0, 0.0]), (203, rows[0][1]), (204, [float("nan"), 1.0])]
    unit = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and np.any(v) and np.all(np.isfinite(v))}
    near = {(i, j) for i, a in unit.items() for j, b in unit.items() if i != j and len(a) == len(b)
            and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95}
    root = {i: i for i, _ in rows}
    while True:
        lower = {i: min([root[i], *(root[b] for a, b in near if a == i)]) for i in root}
        if lower == root:
            break
        root = lower
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert rows_of(got) == sorted((i, sum(a == i for a, _ in near), root[i], root[i] == i) for i, _ in rows)


def rows_of(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())
