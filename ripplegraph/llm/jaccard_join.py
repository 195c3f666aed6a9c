"""Chosen-path similarity join of documents on their five-word shingles (Jaccard similarity of at least 0.8).

1. Documents with equal shingle sets form a class (counted with map-side partial sums); everything below sees classes.
2. Chosen paths. In each of RUNS runs a set samples about T of its own shingles, for each of these about T again, and so on
   to DEPTH; all sets use the same hash of (path so far, shingle), so similar sets choose common paths. RUNS is the number
   that finds a pair at the threshold with probability RECALL: two sets that share at least 0.8 of the larger one miss each
   other in a run with probability f(f(f(0))), f(s) = exp(0.8 T (s - 1)).
3. Sets that share a path are compared by sketch (the least hash in each of 256 parts of hash space) if the bucket is small.
   Larger buckets are split on further sampled shingles, SPLITS times SPLIT_SIZE of the sketch's (a pair at the threshold is
   missed by all with probability (1 - 0.8^6)^32, less than 0.0001). Where even such a bucket is large
   its sets are near copies or share a passage: all are compared to a few pivots. A set within 0.15 of a pivot is done
   (whoever is within 0.2 of it is within 0.35 of the pivot, and is tied to it), the others are compared in pairs of blocks.
4. These comparisons only tie together groups of candidates; the groups are components of the ties, never all pairs.
5. Within each group all sets are compared exactly, once, on full 64-bit shingles. Groups of more than ROWS sets (into SPREAD
   blocks at most) or of more than GROUP shingles (into as many as it takes) are dealt into blocks and each pair of blocks is a task's work of bounded size; it gives back the number of links of each set and
   a spanning forest of its links, not the pairs. Components of the forests are the result's classes.

Result: (doc_id, class_id, n_links): class_id is the least doc_id among documents tied by links or equality; n_links counts
the other documents whose similarity is at least 0.8, copies included.

Defined cases: null and empty texts, and texts without words, have no shingles and no links and are classes of their own;
texts of one to four words have one shingle, of all their words; a null doc_id has a null class and no links; rows that
repeat a doc_id are documents each and get a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.llm import textkit
from ripplegraph.operators.components import connected_components
from ripplegraph.runtime import drop, materialize, ship, sweep

SIMILARITY = 0.8
RECALL = 0.999
T, DEPTH = 1.6, 3
BINS = 256
SPLITS, SPLIT_SIZE = 32, 6
BUCKET = 512
PIVOTS = 4
NEAR, TIED, TIGHT = 0.68, 0.55, 0.85
GROUP, ROWS, SPREAD = 300_000, 128, 16
U = np.uint64


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    miss = 0.0
    for _ in range(DEPTH):
        miss = math.exp(similarity * T * (miss - 1))
    return math.ceil(math.log(1 - recall) / math.log(miss))


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    w, first = textkit.words(texts)
    return [np.unique(textkit.shingles(w[first[i] : first[i + 1]], size)) for i in range(len(texts))]


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set; 0 for the empty set."""
    return int(textkit.mix(np.array([textkit.mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0] or 1) if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of BINS parts of hash space one byte (1 to 255) of the least hash there, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    part = (s >> U(56)).astype(np.int64)
    least = np.flatnonzero(np.diff(part, prepend=-1))
    out[part[least]] = textkit.mix(s[least]) % U(255) + U(1)
    return out


def paths(sets: list[np.ndarray], runs: int) -> list[np.ndarray]:
    """The chosen paths of each set: 64-bit hashes."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    limit = np.minimum(T / np.maximum(sizes, 1), 1.0) * 2.0**64
    limit = np.minimum(limit, 2.0**64 - 4096).astype(U)
    owner = np.repeat(np.arange(len(sets)), runs)
    path = textkit.mix(np.tile(np.arange(1, runs + 1).astype(U), len(sets)))
    for _ in range(DEPTH):
        grown_owner, grown_path = [], []
        step = max(1, 2_000_000 // max(int(sizes.mean()) if len(sets) else 1, 1))
        for lo in range(0, len(owner), step):
            o, p = owner[lo : lo + step], path[lo : lo + step]
            many = sizes[o]
            node = np.repeat(np.arange(len(o)), many)
            at = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[o], many)
            h = (tokens[at] ^ p[node]) * U(0x9FB21C651E98DF25)
            h ^= h >> U(29)
            h *= U(0xD6E8FEB86659FD93)
            picked = np.flatnonzero(h <= limit[o][node])
            grown_owner.append(o[node[picked]])
            grown_path.append(textkit.mix(h[picked] + U(1)))
        owner, path = np.concatenate(grown_owner or [owner]), np.concatenate(grown_path or [path])
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(sets)))
    return [np.unique(x) for x in np.split(path[order], cuts)] if len(sets) else []


def _featured(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in textkit.chunks(b["text"].to_pylist()):
                sets = shingle_sets(texts)
                columns = [
                    b["doc_id"].slice(at, len(texts)),
                    pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    pa.array([p.view(np.int64) for p in paths(sets, runs)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cid", "n", "sketch", "paths"])

    return run


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row against row (with broadcasting)."""
    return ((a == b) & (a > 0)).sum(-1, dtype=np.int32) / np.maximum(((a > 0) | (b > 0)).sum(-1, dtype=np.int32), 1)


def by_key(batches: Iterator[pa.RecordBatch], names: list[str], many: int = 20_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of batches sorted by `key`: runs of whole groups, with the positions where groups start (and the end)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < many:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t["key"].to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield t.slice(0, last), np.append(np.flatnonzero(np.diff(key[:last], prepend=key[0] - 1)), last)
        held, size = [t.slice(last)], t.num_rows - last
        many = max(many, 2 * size) if not last else many
    if size:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t["key"].to_numpy()
        yield t, np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))


def forest(linked: np.ndarray) -> np.ndarray:
    """The least number in the component of each vertex of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of bounded size to ties (a, b): a star for each component of sets that look alike."""
    for t, cuts in by_key(batches, ["key", "cid", "sketch"]):
        cid, sk, left, right = t["cid"].to_numpy(), _sketches(t["sketch"]), [], []
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        near = two[alike(sk[two], sk[two + 1]) >= NEAR]
        left.append(cid[near])
        right.append(cid[near + 1])
        for lo, n in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
            s = sk[lo : lo + n]
            linked = np.empty((n, n), bool)
            step = max(1, 8_000_000 // (n * BINS))
            for i in range(0, n, step):
                linked[i : i + step] = alike(s[i : i + step, None], s[None]) >= NEAR
            label = forest(linked)
            hung = np.flatnonzero(label != np.arange(n))
            left.append(cid[lo + hung])
            right.append(cid[lo + label[hung]])
        a, b = np.concatenate(left), np.concatenate(right)
        ends = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def sampled(sk: np.ndarray) -> np.ndarray:
    """SPLITS x SPLIT_SIZE sampled elements of each sketch: the first full part in each of as many fixed orders of the parts, with its
    byte. Two sketches agree on each with the probability that they agree on a part that either has."""
    full, rows = sk > 0, np.arange(len(sk))
    out = np.zeros((len(sk), SPLITS * SPLIT_SIZE), U)
    orders = np.random.default_rng(97)
    for j in range(out.shape[1]):
        order = orders.permutation(BINS)
        part = order[full[:, order].argmax(1)]
        out[:, j] = (part.astype(U) << U(8)) | sk[rows, part].astype(U)
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sketch) to SPLITS rows (key, cid): each key hashes SPLIT_SIZE sampled shingles."""
    for b in batches:
        if not b.num_rows:
            continue
        chosen = sampled(_sketches(b["sketch"])).reshape(-1, SPLITS, SPLIT_SIZE)
        key = np.broadcast_to(np.arange(SPLITS).astype(U), chosen.shape[:2])
        for j in range(SPLIT_SIZE):
            key = textkit.mix(key + chosen[:, :, j] + U(1))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b["cid"].to_numpy(), SPLITS))], ["key", "cid"])


def _pivoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cid, sketch, pivots array of (cid, sketch)) to ties with pivots (b not null), and a row with b null for who isn't near any."""
    for t in batches:
        if not t.num_rows:
            continue
        key, cid, sk = t["key"].to_numpy(), t["cid"].to_numpy(), _sketches(t["sketch"])
        pivots = t["pivots"].to_pylist()
        who = np.array([[p["cid"] for p in x] + [x[0]["cid"]] * (PIVOTS - len(x)) for x in pivots])
        near = np.zeros((len(cid), PIVOTS))
        for k in range(PIVOTS):
            near[:, k] = alike(sk, np.frombuffer(b"".join(x[min(k, len(x) - 1)]["sketch"] for x in pivots), np.uint8).reshape(-1, BINS))
        row, k = np.nonzero((near >= TIED) & (who != cid[:, None]))
        rest = np.flatnonzero(~((near >= TIGHT) | (who == cid[:, None])).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[row], key[rest]])), pa.array(np.concatenate([cid[row], cid[rest]])), pa.array(np.concatenate([who[row, k], np.zeros(len(rest), np.int64)]), mask=np.arange(len(row) + len(rest)) >= len(row))],
            ["key", "a", "b"],
        )


def _bucketed(rows: DataFrame, classes: DataFrame, made: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """rows(key, cid) of keys that two or more share, split into small buckets' ties and the rows of large buckets."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "key"), "shared-buckets")
    made.append(shared)
    small = shared.where(F.col("size") <= BUCKET).join(classes.select("cid", "sketch"), "cid").select("key", "cid", "sketch")
    return _compare(small), shared.where(F.col("size") > BUCKET).select("key", "cid")


def _compare(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_tied, "a long, b long")


def candidate_ties(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """classes(cid, sketch, paths) to ties (a, b), and the stored tables that they read."""
    made: list[DataFrame] = []
    ties, large = _bucketed(classes.select(F.explode("paths").alias("key"), "cid"), classes, made)
    hot = materialize(large.select("cid").distinct().join(classes.select("cid", "sketch"), "cid"), "hot-sets")
    more, dense = _bucketed(hot.mapInArrow(_split, "key long, cid long"), hot, made)
    dense = materialize(dense.join(hot, "cid").select("key", "cid", "sketch"), "dense-buckets")
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("cid", "key"), "cid"))  # limited before the shuffle, too
    pivots = dense.withColumn("nth", nth).where(F.col("nth") <= PIVOTS).groupBy("key").agg(F.collect_list(F.struct("cid", "sketch")).alias("pivots"))
    seen = materialize(dense.join(pivots, "key").mapInArrow(_pivoted, "key long, a long, b long"), "pivot-ties")
    rest = seen.where("b IS NULL").select("key", F.col("a").alias("cid"))
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"))
    rest = rest.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cid").join(hot, "cid")
    made += [hot, dense, seen]
    return ties.unionAll(more).unionAll(seen.where("b IS NOT NULL").select("a", "b")).unionAll(_compare(rest.select("key", "cid", "sketch"))).distinct(), made


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which sets have at least that Jaccard similarity; no set with itself."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many > 1
    number = np.cumsum(shared) - 1
    packed = np.zeros((n, -(-max(int(shared.sum()), 1) // 64) * 8), np.uint8)
    at = np.cumsum(sizes) - sizes
    for i in range(n):
        mine = token[at[i] : at[i] + sizes[i]]
        row = np.zeros(packed.shape[1] * 8, bool)
        row[number[mine[shared[mine]]]] = True
        packed[i] = np.packbits(row)
    packed = packed.view(U)
    out = np.zeros((n, n), bool)
    for i in range(n):
        both = np.bitwise_count(packed[i] & packed[i + 1 :]).sum(1, dtype=np.int64)
        out[i, i + 1 :] = both >= similarity * (sizes[i] + sizes[i + 1 :] - both) - 1e-9
    return out | out.T


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (key, cid, copies, side, shingles) to rows (a, b null, links) and forest edges (a, b, links null)."""
    for t, cuts in by_key(batches, ["key", "cid", "copies", "side", "shingles"], 2000):
        cid, copies, side = (t[c].to_numpy() for c in ("cid", "copies", "side"))
        out: list[tuple] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            _, pick = np.unique(cid[lo:hi], return_index=True)  # repeated rows of one document
            pick += lo
            if len(pick) < 2:
                continue
            linked = links([np.frombuffer(t["shingles"][int(i)].as_buffer(), U) for i in pick])
            if (side[pick] >= 0).all():
                linked &= side[pick][:, None] != side[pick][None, :]
            label = forest(linked)
            number = linked @ copies[pick]
            out += [(int(cid[i]), None, int(k)) for i, k in zip(pick, number, strict=True) if k]
            out += [(int(cid[pick[i]]), int(cid[pick[j]]), None) for i, j in enumerate(label) if i != j]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "links"])


def _rehashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of texts, for the rows whose text is the class's (a doc_id may be repeated with another text)."""
    for b in batches:
        for at, texts in textkit.chunks(b["text"].to_pylist()):
            part, sets = b.slice(at, len(texts)), shingle_sets(texts)
            own = pa.array([set_id(s) == c for s, c in zip(sets, part["cid"].to_pylist(), strict=True)])
            columns = [*(part[c] for c in ("cid", "grp", "copies", "blocks")), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "grp", "copies", "blocks", "shingles"]).filter(own)


def join(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) to (doc_id, class_id, n_links)."""
    ship(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    runs = runs_needed()
    features = materialize(documents.mapInArrow(_featured(runs), "doc_id long, cid long, n long, sketch binary, paths array<long>"), "shingle-features")
    real = features.where("doc_id IS NOT NULL AND n > 0")
    classes = materialize(real.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "shingle-classes")
    ties, made = candidate_ties(classes)
    parts = connected_components(ties)
    groups = materialize(parts.select(F.col("id").alias("cid"), F.col("component").alias("grp")), "candidate-groups")
    for table in (*made, parts):
        drop(table)
    del ties, made, parts
    sweep(documents.sparkSession)
    wanted = groups.join(classes.select("cid", "doc_id", "copies", "n"), "cid")
    blocks = wanted.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / GROUP), F.least(F.ceil(F.count("*") / ROWS), F.lit(SPREAD))).cast("int").alias("blocks"))
    wanted = wanted.join(blocks, "grp").select("doc_id", "cid", "grp", "copies", "blocks")
    sets = documents.join(wanted, "doc_id").select("text", "cid", "grp", "copies", "blocks").mapInArrow(_rehashed, "cid long, grp long, copies long, blocks int, shingles binary")
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = F.col("mine") == F.col("other")
    sets = sets.select(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cid", "copies", F.when(inside, -1).otherwise(F.col("mine")).alias("side"), "shingles")
    found = materialize(sets.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long, links long"), "verified-links")
    number = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    tied = parts.select(F.col("id").alias("cid"), "component")
    least = tied.join(classes.select("cid", "doc_id"), "cid").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    tied = tied.join(least, "component").join(number, "cid", "left").select("cid", "class_id", "links")
    told = classes.select("cid", "doc_id", "copies").join(tied, "cid", "left")
    told = told.select("cid", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = materialize(told.where("n_links > 0"), "linked-classes")
    for table in (classes, groups, found, parts):
        drop(table)
    out = features.select("doc_id", "cid").join(told.withColumnRenamed("cid", "c"), (F.col("cid") == F.col("c")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class of the join, that with the least doc_id, with all its columns. Rows with a null doc_id stay; of rows that
    repeat doc_id and text one stays, rows with the same doc_id and another text are documents of their own."""
    kept = join(documents).where("doc_id = class_id").select("doc_id").distinct()
    named = documents.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(documents.where("doc_id IS NULL")).select(*documents.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: By comparing all documents that share a shingle; doc_id is taken as unique.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE same >= 0.8::DOUBLE * (u.n + v.n - same) - 1e-9::DOUBLE),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk AS (SELECT x AS id, x AS seen FROM e UNION SELECT walk.id, e.y FROM walk JOIN e ON e.x = walk.seen),
c AS (SELECT id, min(seen) AS class_id FROM walk GROUP BY id),
k AS (SELECT x AS id, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE coalesce(c.class_id, d.doc_id) END AS class_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.id = d.doc_id
"""
