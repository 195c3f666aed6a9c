import random

import corpus_pipeline
from ripplegraph.llm import catalog, jaccard_join, language_id, packing


def sentence(rnd, lang, n):
    s = {"aa": "ba ko mi tu ra", "bb": "sch ung ein kei pf"}[lang].split()
    return ["".join(rnd.choice(s) for _ in range(rnd.randrange(2, 5))) for _ in range(n)]


def test_stages_do_what_they_say(spark, write):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        w = sentence(rnd, lang, rnd.randrange(40, 90))
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                w.insert(rnd.randrange(len(w)), rnd.choice(["blarg", "fnord"]))
        rows.append((i, " ".join(w), lang, "s", len(w)))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 6]
    items = [(k, " ".join(sentence(rnd, "aa", 30))) for k in range(5)]
    near = clean[7][1].split()
    near[3] = "other"
    planted = [(900, None, "aa"), (901, "!!! 123", "aa"), (902, clean[4][1], "bb"), (903, clean[5][1].upper() + ".", "aa"), (904, " ".join(near), "aa"), (905, f"ba ko {items[2][1]} mi", "aa"), (906, " ".join(sentence(rnd, "bb", 20) + ["fnord", "blarg", "fnord"]), "bb")]
    docs = spark.createDataFrame(rows + [(a, b, c, "s", 0) for a, b, c in planted], "doc_id long, text string, lang string, source string, n_chars long")
    path = write(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    kept, now = [], spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "jaccard_join", "decontaminate", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path).persist()
        assert now.columns == docs.columns
        kept.append({r["doc_id"] for r in now.collect()})
    everyone = {r[0] for r in rows} | set(range(900, 907))
    assert everyone - kept[0] == {900, 901}
    toxic = {r[0] for r in rows if r[0] % 6 == 0} | {906}
    assert kept[0] - kept[1] == toxic
    assert kept[1] - kept[2] == {902, 903, 904}  # their equals have smaller numbers
    assert kept[2] - kept[3] == {905}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, path)
    assert {r["doc_id"] for r in packed.collect()} == kept[3]
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed.collect()))
    text = {r["doc_id"]: r["text"] for r in now.collect()}
    assert sum(r["length"] for r in whole) == sum(len(packing.token_ids(t)) for t in text.values())


def test_empty_corpus(spark, write):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    path = write(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_columns_with_the_operators_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "ba ko mi", "aa", 0.5, "x", 1), (2, "sch ung", "bb", 0.1, "y", 2)], "doc_id long, text string, lang string, score double, lang_pred string, cid int")
    kept = jaccard_join.keep_one(language_id.accept(docs, language_id.train(docs.select("doc_id", "text", "lang"))))
    assert kept.columns == docs.columns and kept.count() == 2


def test_registered_queries():
    assert [n.split("_")[0] for n in catalog.queries()] == ["pipeline", *(f"op{i}" for i in range(1, 11))]
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
