import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ripplegraph.llm import packing as P

TEXTS = [(0, "Hello  world\n\nit's 2026, don't!"), (1, None), (2, ""), (None, "null id"), (4, "x" * 5000), (5, "één ça va ü 😀 \t <|endoftext|> tail"), (6, "same"), (6, "same"), (7, "word " * 4000), (8, "same"), (9, "a\u00a0b\u3000c\r\nd   ")]


def frame(spark, data=TEXTS):
    return spark.createDataFrame([(*r, 3, "k", 0) for r in data], "doc_id long, text string, n long, key string, row int")


def test_ids_are_those_of_the_named_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" + " " * 49_999 + "b", "x" * 300_000, "\x1c" * 60_000 + "\t"]
    for text in [x for _, x in TEXTS] + more:
        assert P.token_ids(text).tolist() == t.encode(text or "", add_special_tokens=False).ids + [0]
    assert 50256 in P.token_ids("a <|endoftext|> b")


def test_long_white_space():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 3_000_000, " " * 3_000_000 + "a", "\n" * 1_000_000 + "a", "\t" * 1_000_000, "w " * 30_000 + "\u3000" * 60_000 + " end"):
        assert P.token_ids(text).tolist() == t.encode(text, add_special_tokens=False).ids + [0]


def test_the_whole_query_is_a_plain_sort_by_the_curve(spark, tmp_path):
    """By one process: vectors, whole sums, keys, one sort, one cut."""
    rnd = np.random.default_rng(5)
    texts = [None if i % 31 == 0 else " ".join(rnd.choice(["lake", "boat", "wheel", "gear", "flour", "oven", "é1"], int(rnd.integers(0, 400)))) for i in range(300)]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in P.op4_packing(spark, str(tmp_path)).collect())
    ids = [P.token_ids(t) for _, t in rows]
    points = np.stack([P.place(x) for x in ids])
    half_up = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    whole = half_up(points * P.SCALE)
    centre = whole.sum(0) / len(rows) / P.SCALE
    spread = np.sqrt((whole**2).sum(0) / len(rows) / P.SCALE**2 - centre**2)
    key = P.hilbert(np.minimum(1 / (1 + np.exp(-1.7 * (points - centre) / spread)) * (1 << P.BITS), (1 << P.BITS) - 1))
    want, at = [], 0
    for i in sorted(range(len(rows)), key=lambda i: (key[i], rows[i][0])):
        x, done = ids[i].astype("<u4"), 0
        while done < len(x):
            take = min(P.LENGTH - at % P.LENGTH, len(x) - done)
            want.append((rows[i][0], done, take, zlib.crc32(x[done : done + take].tobytes()), len(x), at // P.LENGTH, at % P.LENGTH))
            done, at = done + take, at + take
    assert got == sorted(want)


def test_every_id_lies_in_one_piece_and_sequences_are_full(spark):
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        pieces = P.pack(frame(spark)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = sorted(((d, P.token_ids(t).astype("<u4")) for d, t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))
        mine = sorted(pieces, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["sequence_id"], r["offset"]))
        i = 0
        for doc, ids in want:
            at = 0
            while at < len(ids):
                r = mine[i]
                assert (r["doc_id"], r["start"], r["doc_tokens"]) == (doc, at, len(ids))
                assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
                at, i = at + r["length"], i + 1
            assert at == len(ids)
        assert i == len(pieces)
        filled = {}
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == filled.get(r["sequence_id"], 0)
            filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert sorted(filled) == list(range(len(filled)))
        assert all(n == P.LENGTH for s, n in filled.items() if s < len(filled) - 1)


def test_the_curve_visits_every_cell_by_single_steps():
    for bits in (1, 2, 3):
        side = 1 << bits
        cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
        key = P.hilbert(cells, bits)
        assert sorted(key) == list(range(side**3))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    kinds = ["river lake water boat fish ", "engine wheel brake gear road ", "flour sugar butter oven cake "]
    rows = [(i, kinds[i % 3] * 40) for i in range(60)]
    order = {}
    for r in P.pack(frame(spark, rows)).collect():
        order[r["doc_id"]] = min(order.get(r["doc_id"], 1 << 60), r["sequence_id"] * P.LENGTH + r["offset"])
    kind = [d % 3 for d in sorted(order, key=order.get)]
    assert sum(a != b for a, b in zip(kind, kind[1:], strict=False)) <= 4


def test_empty(spark):
    assert P.pack(frame(spark, [])).count() == 0


def test_ranges_are_as_many_as_the_rows_need(spark, monkeypatch):
    rows = [(i // 2, None if i % 9 == 0 else "lake boat " * (i % 40)) for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    parts, got = [], []
    stored = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name, **k: (parts.append((name, (out := stored(df, name, **k)).inputFiles())), out)[1])
    for size in (20_000, 70, 10):
        monkeypatch.setattr(P, "RANGE_ROWS", size)
        got.append(sorted(tuple(r) for r in P.pack(frame(spark, rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]
    assert [name for name, _ in parts] == ["packing-tokens", "packing-order"] * 3  # nothing else is stored
    few, some, many = (len(files) for name, files in parts if name == "packing-order")
    assert few == 1 < some <= 3 < many <= 7


def test_readers_hold_few_rows_of_long_texts_at_once(spark):
    P.ship(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000
