import random

import pytest
import regex
from pyspark.sql import functions as F

from claimloom.llm import leakage, lookalike, tokenizer, truncation

VOCABULARY = tokenizer.VOCABULARY


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_library(spark, reference):
    rnd = random.Random(1)
    alphabet = "abcdefgh eiou\n\té中文-='’😀  "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))) for _ in range(300)]
    texts += ["a" * 3001, "-" * 20_001, " " * 3000, "ab" * 9000, "don't <|endoftext|> 12,345.6", "\u0000﻿", "Ünïcödé ﬁ"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*texts, "", None])], "doc_id int, text string, ids string")
    got = {r[0]: list(r[1]) for r in df.select("doc_id", tokenizer.token_ids(F.col("text")).alias("out")).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    assert got[len(texts)] == [] and got[len(texts) + 1] == []


def test_round_trip():
    enc = tokenizer.encoder()
    text = "Ein Satz, с буквами и 字 — и ещё 👩‍🔬!\r\n\tEnd "
    assert b"".join(enc.bytes_of[i] for i in enc.encode(text)).decode() == text


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").casefold())


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60)))) for i in range(25)]
    items += [(90, items[3][1]), (91, None), (92, "short text")]
    docs = []
    for i in range(120):
        body = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if i % 3 == 0:
            src = words(items[rnd.randrange(25)][1])
            a = rnd.randrange(0, max(1, len(src) - 8))
            body[len(body) // 2 : len(body) // 2] = src[a : a + rnd.randrange(8, 30)]
        docs.append((i, rnd.choice([" ", ", ", "\n\n"]).join(x.upper() if rnd.random() < 0.3 else x for x in body)))
    docs += [(500, None), (501, ""), (502, "  "), (503, "x " * 30_000 + items[0][1])]
    want = {}
    for d, t in docs:
        wd = words(t)
        at = {}
        for p in range(len(wd) - 12):
            at.setdefault(tuple(wd[p : p + 13]), []).append(p)
        for it, x in items:
            wi = words(x)
            best = 0
            for q in range(len(wi) - 12):
                for p in at.get(tuple(wi[q : q + 13]), ()):
                    n = 13
                    while q + n < len(wi) and p + n < len(wd) and wi[q + n] == wd[p + n]:
                        n += 1
                    best = max(best, n)
            if best:
                want[d, it] = best
    dd = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, text string")
    for shard in (10**6, 500):
        got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.leaks(dd, ii, shard_chars=shard).collect()}
        assert got == want and want
    found = leakage.leaks(dd, ii)
    assert leakage.without_leaks(dd, found).count() == len(docs) - len({d for d, _ in want})
    assert leakage.leaks(dd, ii.limit(0)).count() == 0 and leakage.leaks(dd.limit(0), ii).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    items = [(i, " ".join(f"b{i}x{j}" for j in range(15))) for i in range(6)]
    dd = spark.createDataFrame([(i, "pre " + t + " post") for i, t in items], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in leakage.leaks(dd, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(i, i) for i in range(6)]


def test_one_row_per_document_and_item(spark, rows):
    text = " ".join(f"w{i}" for i in range(40))
    dd = spark.createDataFrame([(1, text), (1, text[:-8]), (1, text)], "doc_id long, text string").repartition(3)
    ii = spark.createDataFrame([(7, text), (7, text[:-4]), (7, text)], "item_id long, text string")
    assert rows(leakage.leaks(dd, ii).select("doc_id", "item_id", "n_words")) == [(1, 7, 40)]


def test_suffixes_are_in_order():
    texts = ["b a b a b a c", "a b", "", "c c c c c c c c c a"]
    words, ranks, begins = leakage.hashed(texts)
    order = leakage.suffix_array(ranks, 13)
    tails = [tuple(ranks[i : i + 16]) + (0,) * (16 - len(ranks[i : i + 16])) for i in order]
    assert tails == sorted(tails) and sorted(order) == list(range(len(words))) and list(begins) == [0, 8, 11, 12]


LOOKS = [
    (1, "Peace of mind"), (2, "Реace оf mind"), (3, "Peace of mind"), (4, "Pe​ace of mind"), (5, "Ｐeace of mind"), (6, "Peace of mind"), (7, "peace of mind"), (8, "Peace  of mind"), (9, "Peace\nof mind"),
    (10, "café"), (11, "café"), (12, "cafe"), (13, "ﬁne"), (14, "fine"), (15, "x²"), (16, "x2"), (17, "👩‍🔬"), (18, "👩🔬"), (19, None), (20, ""), (21, " ​"), (22, " "), (23, "a½"), (24, "a1/2"),
]


def test_look_alikes(spark, rows):
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in LOOKS], "doc_id long, text string, form string, raw string")
    same = {1, 2, 3, 4, 5, 6}
    want = {(a, b) for a in same for b in same if a < b and (a, b) != (1, 6)} | {(10, 11), (13, 14)}
    assert set(rows(lookalike.look_alikes(df))) == want
    assert rows(lookalike.look_alikes(df.limit(0))) == []
    forms = {r[0]: r[1] for r in df.select("doc_id", lookalike.consistent_form(F.col("text")).alias("f")).collect()}
    assert forms[1] == forms[2] == forms[7] == forms[8] == "peace of mind" and forms[19] is None and forms[20] == ""


def test_letters_of_many_scripts_and_joiners(tmp_path):
    for odd, plain in (("ραικυ", "paiku"), ("Ꭲ", "T"), ("ѡ", "w"), ("սոհ", "unh"), ("ꓢ", "S"), ("Ｆull", "Full")):
        assert lookalike.look(odd) == plain
    assert lookalike.look("می\u200cخواهم") != lookalike.look("میخواهم")  # breaks a join
    assert lookalike.look("را\u200cه") == lookalike.look("راه")  # there is no join to break
    assert lookalike.look("क्\u200dष") != lookalike.look("क्ष")
    assert lookalike.look("a\u200cb\u200d") == "ab"
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# a comment\n05D8 ;\t0076 ;\tMA\t# v\n0031 ;\t006C ;\tMA\n", encoding="utf-8")
    more = lookalike._letters(str(f))
    assert lookalike.look("ט1", more) == "v1" and lookalike.look("а", more) == "a"


def test_classes_of_looks(spark, rows):
    df = spark.createDataFrame([(i, t, "c") for i, t in LOOKS], "doc_id long, text string, class_id string")
    got = rows(lookalike.look_classes(df))
    assert got == [(1, 1, 6, 5), (10, 10, 2, 2), (11, 10, 2, 2), (13, 13, 2, 2), (14, 13, 2, 2), (2, 1, 6, 5), (3, 1, 6, 5), (4, 1, 6, 5), (5, 1, 6, 5), (6, 1, 6, 5)]
    assert rows(lookalike.look_classes(df.limit(0))) == []


def test_a_look_with_many_texts_and_copies(spark, monkeypatch):
    from claimloom.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    texts = ["sa" + "\u200b" * i + "me" for i in range(12)]
    df = spark.createDataFrame([(100 * i + j, t) for i, t in enumerate(texts) for j in range(7)], "doc_id long, text string")
    assert lookalike.look_alikes(df).count() == 66 * 49


def test_copies_are_not_compared_with_each_other(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)] + [(1000, "sаme text")], "doc_id long, text string")
    assert lookalike.look_alikes(df).count() == 400


def cut_data():
    rnd = random.Random(11)
    subj, verb, obj = ["the critic", "a sparse sampler", "the mixing network", "our planner"], ["improves the success rate of", "does not change the wall clock time of", "lowers the regret on"], ["the grid maze", "the harbour crane", "a noisy dispatch task"]
    say = lambda: f"In {rnd.randrange(2000, 2024)} {rnd.choice(subj)} {rnd.choice(verb)} {rnd.choice(obj)}."
    out, want = [], set()
    for i in range(900):
        t = " ".join(say() for _ in range(rnd.randrange(1, 5)))
        if i % 9 == 0:
            stop = t.rstrip(".").rfind(" ", 0, max(20, len(t) - rnd.randrange(6, 30)))
            t = t[: stop + rnd.randrange(0, 4)]
            if not t.endswith("."):
                want.add(f"n{i}")
        elif i % 7 == 0:
            t = f"{rnd.choice(['Sparse', 'Robust'])} {rnd.choice(['sampling', 'planning'])} note"
        out.append((f"n{i}", 1, t, None, "meadow/2020/p.pdf", 0))
    return out, want


def test_truncation_on_made_texts(spark, rows):
    data, want = cut_data()
    data += [("e1", 1, None, None, None, 0), ("e2", 1, "", " ", None, 0), ("e3", None, "n/a", "TBD", None, 0), ("e4", 1, "x", '{"phase": "reduce", "code_span": "sec 4"}', "", 0), ("e5", 1, "word " * 20_000, None, None, 0), data[0]]
    df = spark.createDataFrame(data, "node_id string, version int, context string, provenance string, source_pdf string, kind int")
    found = truncation.truncated(df)
    got = {r["node_id"] for r in found.where("field_name = 'context'").collect()}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    assert not got & {"e1", "e2", "e3", "e4"}
    by = truncation.truncation_by_source(df, found).where("collection = 'meadow' and field_name = 'context'").first()
    assert by["n_values"] == 900 and by["n_cut"] == len(got - {"e5"})
    assert rows(truncation.truncated(df.limit(0))) == []


def test_text_values_inside_provenance(spark, rows):
    df = spark.createDataFrame([("a", 1, None, '{"raw_citation": "A \\"b\\" c", "code_span": "q"}'), ("b", 1, None, "{'code_span': \"it's\", 'x': 1}"), ("c", 1, None, '{"code_span": "cut in the mid')], "node_id string, version int, context string, provenance string")
    got = rows(truncation.field_texts(df).where("field_name = 'provenance' and kind = 'text'").select("id.node_id", "text"))
    assert got == [("a", 'A \\"b\\" c'), ("a", "q"), ("b", "it's")]
