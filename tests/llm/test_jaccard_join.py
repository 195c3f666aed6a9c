import random

import numpy as np

from ripplegraph.llm import jaccard_join as J
from ripplegraph.llm import textkit


def brute(data):
    """{row number: (class, links)} by comparing all pairs of rows."""
    sets = [J.shingle_sets([t or ""])[0] for _, t in data]
    up, links = list(range(len(data))), [0] * len(data)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if data[i][0] is None or data[j][0] is None or not len(sets[i]) or not len(sets[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= J.SIMILARITY * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, None if d is None else least[root(i)], links[i]) for i, (d, _) in enumerate(data)), key=str)


def frame(spark, data):
    return spark.createDataFrame([(*r, 5, "c", 9) for r in data], "doc_id long, text string, n long, class_id string, cid int")


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    shared = words(rnd, 60)
    texts = [" ".join(words(rnd, rnd.randrange(20, 150))) for _ in range(60)]
    texts += [" ".join(words(rnd, 90) + shared + words(rnd, 90)) for _ in range(30)]  # a common passage makes no link
    for size, edits in ((2, 1), (5, 3), (12, 6)):
        texts += family(rnd, words(rnd, 120), size, edits)
    texts += [texts[0]] * 7 + [texts[0].upper(), "one two", "One, two!", "one", "", None, "...", "a b c d e", "long " * 30_000]
    rnd.shuffle(texts)
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, "another text under the same number, long enough to count")]
    got = sorted((tuple(r) for r in J.join(frame(spark, data)).collect()), key=str)
    assert got == brute(data)


def test_dense_groups_take_the_exact_way_too(spark, monkeypatch):
    rnd = random.Random(5)
    for name, value in (("BUCKET", 8), ("GROUP", 1500)):
        monkeypatch.setattr(J, name, value)
    data = list(enumerate(family(rnd, words(rnd, 130), 60, 4) + family(rnd, words(rnd, 60), 40, 1) + [" ".join(words(rnd, 80)) for _ in range(20)]))
    got = sorted((tuple(r) for r in J.join(frame(spark, data)).collect()), key=str)
    assert got == brute(data)


def test_enough_runs_for_the_recall():
    assert J.runs_needed() == 9
    rnd = random.Random(6)
    found = 0
    for _ in range(300):
        shared = {rnd.getrandbits(64) for _ in range(160)}
        a, b = (np.array(sorted(shared | {rnd.getrandbits(64) for _ in range(k)}), np.uint64) for k in (20, 20))
        pa, pb = J.paths([a, b], 9)
        found += bool(len(np.intersect1d(pa, pb)))
    assert found >= 297


def test_paths_do_not_depend_on_the_batch():
    rnd = random.Random(7)
    sets = [np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 40, 700)] + [np.zeros(0, np.uint64)]
    together = J.paths(sets, 3)
    assert len(together) == 4 and not len(together[3])
    for s, p in zip(sets, together, strict=True):
        assert (J.paths([s], 3)[0] == p).all()


def test_keep_one(spark):
    base = " ".join(words(random.Random(8), 50))
    other = "quite another text of some words"
    data = [(5, base), (2, base), (9, base + " tail"), (4, other), (4, other), (4, "the same number but not the same words"), (None, base), (7, None)]
    docs = frame(spark, data)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 4, 4, 7, None]


def test_empty(spark):
    assert J.join(frame(spark, [])).count() == 0
    assert textkit.shingles(np.zeros(0, np.uint64)).size == 0


def test_splits_find_similar_sets_of_any_size():
    rnd = random.Random(9)
    for n in (9, 56, 200, 900):
        missed = 0
        for _ in range(150):
            shared = {rnd.getrandbits(64) for _ in range(n)}
            a, b = (J.sketch(np.array(sorted(shared | {rnd.getrandbits(64) for _ in range(n // 8)}), np.uint64)) for _ in range(2))
            same = (J.sampled(a[None]) == J.sampled(b[None])).reshape(J.SPLITS, J.SPLIT_SIZE)
            missed += not same.all(1).any()
        assert missed <= 1
