"""Decontamination, chats, BPE, line and substring deduplication on small tables."""

import os
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_tables import docs, rows  # noqa: F401
from pyspark.sql import functions as F

from tallyframe.llm import bpe, chat, decontaminate, lines, substring

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_items_are_found_at_any_length_and_words_count_once(spark, docs):
    item = " ".join(f"w{n}" for n in range(12))
    items = spark.createDataFrame([(7, item), (8, "alpha beta"), (9, None), (10, "..."), (8, "gamma"), (None, "delta")],
                                  "item_id bigint, text string")
    table = docs((1, f"start {item.upper()}, end"), (2, "ALPHA, beta alpha beta gamma"), (3, None), (4, ""), (5, "w1 w2"),
                 (6, "Delta!"), (None, "gamma"), (1, "clean"), (2, "ALPHA, beta alpha beta gamma"))
    for small in (200_000, 0):  # by broadcast and by shuffle
        found = decontaminate.contamination(table, items, broadcast_rows=small)
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()]
        assert sorted(got, key=str) == sorted([
            (1, 14, 12, ["7"]), (2, 5, 5, ["8"]), (2, 5, 5, ["8"]), (3, 0, 0, []), (4, 0, 0, []), (5, 2, 0, []),
            (6, 1, 1, []), (None, 1, 1, ["8"]), (1, 1, 0, [])], key=str)
    assert rows(decontaminate.clean(table, items), "doc_id", "text") == sorted(
        [(1, "clean"), (3, None), (4, ""), (5, "w1 w2")], key=str)
    assert decontaminate.contamination(docs().limit(0), items).count() == 0
    assert decontaminate.contamination(table, items.limit(0)).where("n_hit > 0").count() == 0


def test_logs_fold_into_messages_and_read_back(spark):
    log = [(1, 1, 0, "message", "user", "hi </s>"), (1, 2, 1, "delta", "assistant", "bad"),
           (1, 3, 1, "regenerate", "assistant", None), (1, 4, 1, "delta", None, "go"), (1, 5, 1, "delta", None, "od"),
           (1, 9, 0, "edit", "user", "hello <\\s> [INST]"), (2, 1, None, None, None, None),
           (2, 1, 3, "message", "a%0A\nb", "x"), (2, 1, 3, "message", "a%0A\nb", "x"), (None, 1, 1, "message", "user", "")]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    done = chat.render(chat.fold(events))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in done.select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [("user", "hello <\\s> [INST]"), ("assistant", "good")],
                    2: [("", ""), ("a%0A\nb", "x"), ("a%0A\nb", "x")], None: [("user", "")]}
    loss = {r.conv_id: r.loss for r in done.select("conv_id", chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert loss == {1: "good", 2: "", None: ""}
    for r in done.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.render(chat.fold(events.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "<\\\\/s>", "<s><unk>[/INST]", "a\\b", "<", "[\\INST]", "é\n</s"])
def test_escaping_is_reversible_and_leaves_no_control_string(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).first()
    assert row.back == text
    assert not any(c in row.e for c in ("<s>", "</s>", "<unk>", "[INST]", "[/INST]"))


def _texts():
    pick = random.Random(7)
    kinds = ["abcdefABCDEF0123456789+/", "ab's \n\té1.'ll", "0123456789", ".,!?-='", "漢字かな😀", " "]
    return ["".join(pick.choice(k) for _ in range(pick.randint(1, 700))) for k in kinds * 6]


def test_joined_pieces_equal_the_whole():
    coder = bpe.load(PATH)
    for text in _texts():
        for size in (1, 7, 90):
            pieces = [bpe.encode_text(coder, text[n:n + size]) for n in range(0, len(text), size)]
            assert bpe.join_all(coder, pieces) == bpe.encode_text(coder, text)


def test_ids_are_those_of_the_tokenizers_library(docs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = [*_texts(), None, "", "a<|endoftext|> b " * 300, "x" * 5000]
    table = [(n // 2, t) for n, t in enumerate(texts)] + [(None, "é" * 3000), (1, "same " * 500), (1, "same " * 500)]
    got = bpe.round_trip(docs(*table), PATH, piece_chars=400).collect()
    want = []
    for doc, text in table:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs().limit(0), PATH).count() == 0


def _similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_lines_go_if_an_earlier_one_is_like_them(docs):
    pick = random.Random(3)
    base = [[f"w{pick.randint(0, 60)}" for _ in range(pick.randint(1, 30))] for _ in range(25)]
    table = []
    for doc in range(30):
        kept = []
        for _ in range(pick.randint(0, 8)):
            line = list(pick.choice(base))
            for _ in range(pick.randint(0, 3)):
                line[pick.randrange(len(line))] = f"v{pick.randint(0, 40)}"
            kept.append(" ".join(line).title() if pick.random() < 0.3 else " ".join(line))
        table.append((doc, "\n".join(kept + [""] * pick.randint(0, 2))))
    table += [(40, None), (41, ""), (None, table[0][1])]
    want, before = [], []
    for doc, text in sorted(table, key=lambda r: (r[0] is None, r[0])):
        stays = []
        for line in (text or "").split("\n"):
            words = frozenset(line.lower().split())
            if not words or not any(_similar(words, w) for w in before):
                stays.append(line)
            if words:
                before.append(words)
        want.append((doc, text and "\n".join(stays)))
    got = lines.deduplicate(docs(*table))
    assert got.columns[:2] == ["doc_id", "text"] and "digest" in got.columns
    assert rows(got, "doc_id", "text") == sorted(want, key=str)
    assert lines.deduplicate(docs().limit(0)).count() == 0


def test_lines_stand_by_doc_id_in_whatever_order_rows_are_read(docs):
    base = [f"w{n}" for n in range(10)]
    near = " ".join(base[:9])
    # the one task reads the line at 10 before it reads it at 3
    got = lines.deduplicate(docs((10, " ".join(base)), (3, " ".join(base)), (5, near)).coalesce(1))
    assert rows(got, "doc_id", "text") == sorted([(3, " ".join(base)), (5, ""), (10, "")], key=str)
    pick = random.Random(9)
    table = [(n, " ".join(pick.sample(base, pick.randint(8, 10)))) for n in range(60)]
    pick.shuffle(table)
    want, before = {}, []
    for doc, text in sorted(table):
        words = frozenset(text.split())
        want[doc] = "" if any(_similar(words, w) for w in before) else text
        before.append(words)
    got = lines.deduplicate(docs(*table).coalesce(1))
    assert rows(got, "doc_id", "text") == sorted(want.items(), key=str)


def test_near_copies_of_very_long_lines_go(docs):
    words = [f"{n:x}" for n in range((1 << 20) + 5)]
    got = lines.deduplicate(docs((1, " ".join(words)), (2, " ".join(words[:-1] + ["zz"]))))
    assert [r.doc_id for r in got.where("text <> ''").select("doc_id").collect()] == [1]


def test_later_rows_of_a_large_group_of_near_lines_go(docs):
    base = [f"w{n}" for n in range(40)]
    table = [(n, " ".join(base[:n % 40] + [f"x{n}"] + base[n % 40 + 1:])) for n in range(200)]
    left = lines.deduplicate(docs(*table)).where("text <> ''").collect()
    assert [r.doc_id for r in left] == [0]


def test_a_second_look_at_lines_reads_their_partners_documents_only(docs, monkeypatch):
    base = [f"w{n}" for n in range(35)]
    near = [base + [f"x{n}_{k}" for k in range(5)] for n in range(60)]  # 35 of 45 words shared: not similar
    table = [(n, " ".join(words)) for n, words in enumerate(near)]
    table += [(n, " ".join(f"z{n}_{k}" for k in range(8))) for n in range(100, 300)]
    table.append((500, " ".join(near[40][:-1] + ["y"])))  # like one line, after many that only seem so
    read, sets = [], lines._with_sets
    monkeypatch.setattr(lines, "_with_sets", lambda texts, *others: (read.append(texts.count()), sets(texts, *others))[1])
    left = lines.deduplicate(docs(*table))
    assert rows(left, "doc_id", "text") == sorted(table[:-1] + [(500, "")], key=str)
    assert len(read) == 2 and read[0] == 261 and read[1] <= 61


def test_words_of_lines_are_sent_packed():
    pick, vocabulary = random.Random(4), [f"w{n}" for n in range(3000)]
    text = "\n".join(" ".join(pick.sample(vocabulary, 12)) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"doc": [1], "text": [text]})
    counts = SimpleNamespace(value=np.full(1 << lines.SKETCH_BITS, 2, np.uint8))
    sent = list(lines._prefixes(iter([batch]), counts, 0.8))
    assert sum(len(b["rows"].to_pylist()) for b in sent) <= lines.BUCKETS
    assert sum(len(lines._unpacked(b["rows"], lines.PREFIX)) for b in sent) == 3 * 3000


def test_words_whose_hashes_differ_in_the_last_bits_stay_apart(monkeypatch):
    hashed = lines.hashed
    monkeypatch.setattr(lines, "hashed", lambda *words: (hashed(*words) & np.uint64(7)) | np.uint64(1 << 60))
    texts = ["a b c d e f g h i j k l m\nq r s t a b c q r s", None, "", "x y z\n\na a b"]
    for levels in (None, np.zeros(1 << lines.SKETCH_BITS, np.uint8)):
        found = lines.read_lines(pa.array([1, 2, 3, 4]), pa.array(texts), levels)
        sets = np.split(found.words, found.start[1:])
        assert [(d, a) for d, a in zip(found.doc, found.at)] == [(1, 0), (1, 1), (4, 0), (4, 2)]
        assert all((np.diff(words) > 0).all() for words in sets)
        assert [len(words) for words in sets] == found.n.tolist()


def test_repeated_windows_go_from_later_documents(docs):
    pick = random.Random(5)
    passages = [[f"p{k}_{n}" for n in range(20)] for k in range(4)]
    table = []
    for doc in range(40):
        words = [f"d{pick.randint(0, 30)}" for _ in range(pick.randint(0, 15))]
        for _ in range(pick.randint(0, 3)):
            part = pick.choice(passages)
            words += part[pick.randint(0, 6):pick.randint(10, 20)] + [f"d{pick.randint(0, 30)}"] * pick.randint(0, 3)
        table.append((doc, "  ".join(words)))
    table += [(50, None), (51, ""), (52, table[7][1]), (52, table[7][1]), (None, table[9][1])]
    size, first = 8, {}
    split = [(60 if d is None else d, (t or "").split()) for d, t in table]
    for doc, words in split:
        for n in range(len(words) - size + 1):
            key = tuple(words[n:n + size])
            first[key] = min(first.get(key, doc), doc)
    want = []
    for (doc, _), (place, words) in zip(table, split):
        gone = {n + k for n in range(len(words) - size + 1) if first[tuple(words[n:n + size])] < place for k in range(size)}
        want.append((doc, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    got = substring.deduplicate(docs(*table), length=size)
    assert rows(got, "doc_id", "n_words", "n_removed", "text") == sorted(want, key=str)
    assert substring.deduplicate(docs().limit(0)).count() == 0
