import random
from collections import Counter

import numpy as np

from ripplegraph.llm import decontaminate as D
from ripplegraph.llm import textkit


def words(rnd, n):
    return [f"w{rnd.randrange(900)}" for _ in range(n)]


def docs(spark, data):
    return spark.createDataFrame([(*r, 1, 0.5) for r in data], "doc_id long, text string, item_id int, similarity double")


def bench(spark, data):
    return spark.createDataFrame([(*r, 1) for r in data], "item_id long, text string, doc_id int")


def counted(w):
    return Counter(textkit.shingles(w, 5).tolist())


def index(items, tmp_path):
    D.write_index(items, str(tmp_path / "index"))
    return D.Index(str(tmp_path / "index"))


def brute(data, items):
    """The best similarity of each item to any window of its length, at every place of every document."""
    out = {}
    for d, t in data:
        w, _ = textkit.words([t or ""])
        for i, s in items:
            own, _ = textkit.words([s or ""])
            b = counted(own)
            if not b:
                continue
            for at in range(-2, len(w) - 2):
                a = counted(w[max(at, 0) : max(at + len(own), 0)])
                both = sum((a & b).values())
                found = both / (a.total() + b.total() - both)
                if found >= D.THRESHOLD:
                    out[d, i] = max(found, out.get((d, i), 0))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(words(rnd, n))) for i, n in enumerate([5, 6, 9, 15, 22, 40, 57, 90, 300])] + [(50, None), (51, ""), (52, "a b c d"), (53, "w7 w8"), (54, "w3"), (None, " ".join(words(rnd, 30)))]
    items.append((60, items[4][1]))  # a repeated item
    data = [(i, " ".join(words(rnd, rnd.randrange(1, 200)))) for i in range(30)]
    for k, (_, s) in enumerate(items):
        w = (s or "").split()
        if len(w) < 5:
            continue
        around = lambda: " ".join(words(rnd, rnd.randrange(60)))
        data.append((100 + k, f"{around()} {s.upper()}!! {around()}"))
        edited = list(w)
        edited[rnd.randrange(len(w))] = "edit"
        data.append((200 + k, f"{around()} {' '.join(edited)} {around()}"))
        at = rnd.randrange(len(w))
        data.append((300 + k, f"{around()} {' '.join(w[:at] + ['more'] + w[at:])} {around()}"))
        data.append((400 + k, f"{around()} {' '.join(w[:at] + w[at + 1 :])}"))
    data += [(500, None), (501, ""), (502, "one two three"), (None, items[5][1]), (503, " ".join(f"v{rnd.randrange(900)}" for _ in range(40_000)) + " " + items[6][1]), (504, items[3][1]), (504, items[3][1])]
    got = Counter()
    for r in D.matches(docs(spark, data), bench(spark, items)).collect():
        got[r["doc_id"], r["item_id"]] = round(r["similarity"], 9)
    want = {k: round(v, 9) for k, v in brute([x for x in data if x[0] != 503], items).items()} | {(503, 6): 1.0} | {(503, 54): 1.0 for _ in [0] if "w3" in items[6][1].split()}
    assert dict(got) == want


def test_tables_find_every_print_within_the_radius(tmp_path):
    rnd = np.random.default_rng(1)
    block = index([(i, " ".join(f"q{rnd.integers(500)}" for _ in range(30))) for i in range(40)], tmp_path).blocks[0]
    (key, (own, *_)), = block.classes.items()
    prints = own[rnd.integers(len(own), size=3000)].copy()
    for k in range(len(prints)):
        for b in rnd.choice(64, rnd.integers(0, 16), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    i, j = block.near(prints, key)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ own[None]) <= D.RADIUS)
    assert sorted(set(zip(i.tolist(), j.tolist(), strict=True))) == [tuple(x) for x in want.tolist()]


def test_fingerprints_are_majorities_of_hash_bits():
    w, _ = textkit.words([" ".join(f"x{i % 37}" for i in range(700))])
    bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1)
    for width in (4, 33, 255, 600):
        starts = np.arange(0, len(w) - width + 1, 7)
        want = [np.packbits(bits[s : s + width].sum(0) * 2 > width).view(np.uint64)[0] for s in starts]
        assert (D.fingerprints(D.sums(w, D.lane_of(width)), starts, width) == want).all()


def test_clean_keeps_the_rest_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 3)
    rnd = random.Random(4)
    items = [(i, " ".join(words(rnd, 25))) for i in range(8)]
    data = [(i, " ".join(words(rnd, 50))) for i in range(10)] + [(20 + i, f"x {s} y") for i, s in items] + [(None, None)]
    d = docs(spark, data)
    kept = D.clean(d, bench(spark, items))
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(10), None], key=str)
    assert D.matches(d, bench(spark, [])).count() == 0
    assert D.clean(d, bench(spark, [])).count() == len(data)
    assert D.matches(docs(spark, []), bench(spark, items)).count() == 0


def test_many_edits_at_the_threshold(tmp_path):
    """Passages with up to 18 edits are found wherever their similarity reaches the threshold."""
    rnd = random.Random(8)
    items, texts, want = [], [], []
    for n in (15, 30, 60, 120, 250, 500, 1000):
        for k in range(12):
            w = [f"i{len(items)}x{rnd.randrange(10**6)}" for _ in range(n)]
            e = list(w)
            for _ in range(rnd.randrange(1, 1 + max(1, min(18, n // 40 + 1)))):
                e[rnd.randrange(n)] = f"e{rnd.randrange(10**6)}"
            a, b = (counted(textkit.words([" ".join(x)])[0]) for x in (w, e))
            both = sum((a & b).values())
            if both / (a.total() + b.total() - both) >= D.THRESHOLD:
                want.append((len(texts), len(items)))
            items.append((len(items), " ".join(w)))
            texts.append(" ".join([*words(rnd, rnd.randrange(80)), *e, *words(rnd, rnd.randrange(80))]))
    found = [(d, i) for d, i, *_ in index(items, tmp_path).scan(texts)]
    assert len(want) > 50 and set(want) <= set(found)  # other windows of the passage may reach it, too


def test_ten_thousand_items_in_one_scan(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd, rnd.randrange(6, 16)))) for i in range(10_000)]
    data = [(i, f"{' '.join(words(rnd, 9))} {items[i * 97][1]}") for i in range(100)] + [(200 + i, " ".join(words(rnd, 60))) for i in range(100)]
    seen = D.matches(docs(spark, data), bench(spark, items))
    assert {(i, i * 97) for i in range(100)} <= {(r["doc_id"], r["item_id"]) for r in seen.collect()}
    assert seen._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_the_query(spark, write):
    rnd = random.Random(10)
    items = [(i, " ".join(words(rnd, 20))) for i in range(5)]
    data = [(i, " ".join(words(rnd, 50))) for i in range(30)] + [(40 + i, f"x {s} y") for i, s in items]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.op8_decontaminate(spark, write(documents=docs(spark, data), benchmark=bench(spark, items))).collect()}
    assert got == {k: round(v, 9) for k, v in brute(data, items).items()}
