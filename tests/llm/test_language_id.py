import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ripplegraph.llm import language_id as L

SYLLABLES = {"aa": "ba ko mi tu ra", "bb": "sch ung ein kei pf", "cc": "éa ou tre eau qu", "dd": "ción rr ll ñe os", "ee": "жи ши ча ща ло", "ff": "ka shi tsu wo nn"}


def text(lang, rnd, n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(s) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def documents(spark, n=600, langs=6):
    rnd = random.Random(1)
    rows = [(i, text(k := list(SYLLABLES)[rnd.randrange(langs)], rnd), k, "s", 1, "c", 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")


def test_held_out_accuracy_and_edge_texts(spark, write):
    odd = [(10_001, None, "aa"), (10_002, "", "aa"), (10_003, "12 !! 3", "aa"), (None, text("aa", random.Random(5)), "aa"), (10_004, text("cc", random.Random(6), 40_000), None), (10_005, text("bb", random.Random(7)), None), (10_005, text("bb", random.Random(7)), None)]
    extra = spark.createDataFrame([(a, b, c, "s", 1, "c", 0.1) for a, b, c in odd], documents(spark, 1).schema)
    got = L.op2_language_id(spark, write(documents=documents(spark).unionAll(extra))).collect()
    assert len(got) == 607
    by = {r["doc_id"]: r for r in got}
    for i in range(600):
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    truth = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    held = [i for i in range(600) if by[i]["held_out"]]
    assert np.mean([by[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (10_001, 10_002, 10_003))
    assert by[None]["lang_pred"] == "aa" and by[None]["held_out"] is False
    assert by[10_004]["lang_pred"] == "cc"
    assert len({tuple(r) for r in got if r["doc_id"] == 10_005}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)


def test_few_or_no_languages(spark, write):
    docs = documents(spark, 40, 1)
    assert {r["lang_pred"] for r in L.op2_language_id(spark, write(documents=docs)).collect()} == {"aa"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.op2_language_id(spark, write(documents=none)).collect()} == {"und"}
    assert L.op2_language_id(spark, write(documents=docs.limit(0))).count() == 0


def test_six_hundred_languages(spark):
    rnd = random.Random(11)
    word = lambda k: "".join(chr(0x4E00 + 25 * k + rnd.randrange(25)) for _ in range(3))
    rows = [(4 * k + i, " ".join(word(k) for _ in range(40)), f"l{k:03d}") for k in range(600) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert len(model.languages) == 600
    said = model.predict([t for _, t, _ in rows])[0]
    assert np.mean([a == r[2] for a, r in zip(said, rows, strict=True)]) > 0.9


def test_one_doc_id_on_many_rows_brings_a_bounded_sample(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(7, text("aa", rnd, 2), "aa") for _ in range(100_000)] + [(i, text("bb", rnd, 5), "bb") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes, real = [], L.fit
    monkeypatch.setattr(L, "fit", lambda x, langs: sizes.append(len(x)) or real(x, langs))
    for d in (docs, docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, 5).otherwise(F.col("doc_id")))):
        L.train(d)
    assert all(n <= L.SAMPLE_ROWS for n in sizes)


def test_codes_are_apart():
    for k in (2, 3, 4, 5, 6, 20, 60):
        m = L.code_matrix(k)
        assert m.shape[0] == k and len(np.unique(m, axis=0)) == k
        if k > 2:
            far = (m.shape[1] - (m @ m.T)[~np.eye(k, dtype=bool)]).min() / 2
            assert far >= m.shape[1] / 5


def test_a_prediction_does_not_depend_on_its_batch():
    rnd = random.Random(2)
    texts = [text(rnd.choice(list(SYLLABLES)), rnd, 5) for _ in range(30)]
    whole = L.features(texts)
    assert all((L.features([t])[0] == whole[i]).all() for i, t in enumerate(texts))


def test_accept_keeps_all_columns(spark):
    docs = documents(spark, 200, 3)
    model = L.train(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(-1, "??", "aa", "s", 1, "c", 0.1), (-2, None, "aa", "s", 1, "c", 0.1)], docs.schema)
    kept = L.accept(docs.unionAll(odd), model)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
