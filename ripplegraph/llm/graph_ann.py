"""Nearest neighbours by largest inner product, on robust-pruned directed graphs.

Different vectors (equal ones are collapsed to their SMALLEST vec_ids, all that any answer can name) are dealt by hash into
shards of at most about SHARD vectors, two at least where there are enough. A shard lifts its vectors by one coordinate so that Euclidean order is
inner-product order, and builds its graph in growing batches: greedy searches from the medoid propose neighbours, relaxed distance
pruning (a candidate goes if a kept neighbour is ALPHA times nearer to it) keeps at most DEGREE diverse edges, and back
edges are added, pruned alike once a list is SLACK times as long. Graphs are built once and stored; queries walk every shard's graph by
beam search, in blocks of QUERIES, and the shards' answers are merged by exact score.

Shard size and block size are parameters, so memory is bounded however many vectors and queries there are, and a lost
executor repeats only its own shard or block. A larger shard takes longer to build but is walked by hardly more steps: raise SHARD to what
an executor holds (a vector costs its numbers, 4 bytes each, and 200 bytes of edges). The query set meets every shard in blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or
candidates; so do rows with a null vec_id; a query never finds its own vec_id; equal scores rank by the smaller vec_id;
repeated rows count once; a vec_id with several different vectors counts by the largest product of any of them, as a query and as a candidate;
vectors of another length than the query's are no candidates for it; doubles of any finite size are scaled before they are
compared; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.runtime import drop, materialize, ship

SHARD, SPREAD, FEW = 1 << 17, 2, 4096
DEGREE, SLACK = 32, 1.5
BEAM, BUILD_BEAM = 140, 64
ALPHA = 1.2
BLOCK, EXPAND = 256, 8
QUERIES = 1 << 16


def beam_search(points: np.ndarray, norm: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the numbers of the `width` nearest points met, nearest first, and their squared distances less the query's square
    (len(points) and inf: none), and how many distances were worked out. graph has a row for each point and one more, all of them
    len(points), which also stands for no neighbour. All queries of a block advance together, EXPAND points of each beam at a time."""
    m, n, degree = len(queries), len(points), graph.shape[1]
    ids = np.full((m, width), n, np.int32)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    met = np.zeros((m, n + 1), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = norm[start] - 2 * queries @ points[start]
    met[:, start] = met[:, n] = True
    flat, active, worked = met.ravel(), np.arange(m), m
    many = min(EXPAND, width)
    while len(active):
        d = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(d, many - 1, axis=1)[:, :many]
        chosen = np.where(np.isfinite(np.take_along_axis(d, pick, 1)), ids[active[:, None], pick], n)
        done[active[:, None], pick] = True
        q, base = queries[active], active * (n + 1)
        new_d = np.full((len(active), many * degree), np.inf, np.float32)
        new_i = np.full(new_d.shape, n, np.int32)
        filled = np.zeros(len(active), np.int64)
        for k in range(many):
            near = graph[chosen[:, k]]
            at = base[:, None] + near
            fresh = ~flat[at]
            flat[at] = True
            row, column = np.nonzero(fresh)
            v, count = near[row, column], fresh.sum(1)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + filled[row]
            filled += count
            new_d[row, place] = norm[v] - 2 * np.einsum("ij,ij->i", points[v], q[row])
            new_i[row, place] = v
            worked += len(v)
        most = int(filled.max())
        if most:
            all_d = np.concatenate([dist[active], new_d[:, :most]], 1)
            keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[active] = np.take_along_axis(all_d, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new_i[:, :most]], 1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~np.isfinite(new_d[:, :most])], 1), keep, 1)
        active = active[~done[active].all(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), worked


def robust_prune(points: np.ndarray, owner: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` of each owner's candidates (len(points): none): nearest first, each kept one dropping those it is alpha times
    nearer to than the owner."""
    n = len(points)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n  # equal candidates stand side by side
    x = points[np.minimum(candidates, n - 1)]
    product = x @ x.transpose(0, 2, 1)
    norm = np.einsum("mcc->mc", product)
    d = norm - 2 * np.einsum("mcd,md->mc", x, points[owner]) + (points[owner] ** 2).sum(1)[:, None]
    d[(candidates == n) | (candidates == owner[:, None])] = np.inf
    out = np.full((len(owner), degree), n, np.int32)
    rows = np.arange(len(owner))
    for k in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = candidates[rows, best][live]
        apart = norm + norm[rows, best][:, None] - 2 * product[rows, best]
        d[alpha**2 * apart <= d] = np.inf
        d[rows, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph (as beam_search takes it) and its entry, the point nearest to the mean."""
    n, most = len(points), int(degree * SLACK)
    norm = (points**2).sum(1)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph, held = np.full((n + 1, most), n, np.int32), np.zeros(n + 1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + min(at, BLOCK)]
        found, _, _ = beam_search(points, norm, graph, start, points[batch], width)
        kept = robust_prune(points, batch, np.concatenate([found, _mates(points, norm, batch)], 1), degree, alpha)
        graph[batch, :degree], held[batch] = kept, (kept < n).sum(1)
        _back_edges(points, graph, held, batch, kept, alpha)
        at += len(batch)
    return graph, start


def _mates(points: np.ndarray, norm: np.ndarray, batch: np.ndarray, k: int = 12) -> np.ndarray:
    """The nearest of the batch's own points, which its searches can't meet yet."""
    d = norm[batch] - 2 * points[batch] @ points[batch].T
    np.fill_diagonal(d, np.inf)
    k = min(k, len(batch) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), np.int64)
    return batch[near].astype(np.int32)


def _back_edges(points: np.ndarray, graph: np.ndarray, held: np.ndarray, batch: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    n, degree = len(points), kept.shape[1]
    to, source = kept.ravel(), np.repeat(batch, degree)
    to, source = to[to < n], source[to < n]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    heads, first, count = np.unique(to, return_index=True, return_counts=True)
    fits = held[heads] + count <= graph.shape[1]
    place = held[to] + np.arange(len(to)) - np.repeat(first, count)
    simple = np.repeat(fits, count)
    graph[to[simple], place[simple]] = source[simple]
    held[heads[fits]] += count[fits]
    full, first, count = heads[~fits], first[~fits], count[~fits]
    for lo in range(0, len(full), BLOCK):
        h, f, c = full[lo : lo + BLOCK], first[lo : lo + BLOCK], count[lo : lo + BLOCK]
        new = np.full((len(h), int(c.max())), n, np.int32)
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        new[np.repeat(np.arange(len(h)), c), nth] = source[np.repeat(f, c) + nth]
        pruned = robust_prune(points, h, np.concatenate([graph[h], new], 1), degree, alpha)
        graph[h] = n
        graph[h, :degree], held[h] = pruned, (pruned < n).sum(1)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to components of at most 1 and lifted by one coordinate to equal length."""
    v = (vectors / max(float(np.abs(vectors).max()), 1e-300)).astype(np.float32)
    square = (v.astype(np.float64) ** 2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None].astype(np.float32)], 1)


def search_graph(vectors: np.ndarray, points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, vector numbers, inner products in double precision) of the k nearest vectors found to each query, by blocks."""
    n = len(points)
    norm, width = (points**2).sum(1), min(max(beam, 2 * k), n)
    for lo in range(0, len(queries), BLOCK):
        some = queries[lo : lo + BLOCK]
        q = (some / np.maximum(np.abs(some).max(1, keepdims=True), 1e-300)).astype(np.float32)
        found, _, _ = beam_search(points, norm, graph, start, np.concatenate([q, np.zeros((len(q), 1), np.float32)], 1), width)
        score = np.einsum("qd,qkd->qk", some, vectors[np.minimum(found, n - 1)])
        score[found == n] = -np.inf
        keep = np.argsort(-score, axis=1, kind="stable")[:, : min(width, k)]
        found = np.take_along_axis(found, keep, 1)
        ok = found < n
        rows = np.broadcast_to(np.arange(lo, lo + len(q))[:, None], ok.shape)
        yield rows[ok], found[ok], np.take_along_axis(score, keep, 1)[ok]


def nearest(ids: list[list[int]], vectors: np.ndarray, graph: np.ndarray, start: int, numbers: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k nearest vec_ids found to each query. Where one graph walk names fewer, though there are more, the
    walk is repeated with a wider beam, at last of the whole shard."""
    points, out, ask = lifted(vectors), [], k + 1
    names = {i for x in ids for i in x}
    many = np.array([len(x) for x in ids])
    flat, first = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(many) - many
    while len(numbers):
        parts = []
        for q, at, score in search_graph(vectors, points, graph, start, queries, ask):
            each = many[at]
            named = flat[np.repeat(first[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            parts.append(pd.DataFrame({"row": np.repeat(q, each), "query_id": np.repeat(numbers[q], each), "vec_id": named, "score": np.repeat(score, each)}))
        rows = pd.concat(parts)
        rows = rows[rows["query_id"] != rows["vec_id"]].sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
        rows = rows.drop_duplicates(["row", "vec_id"]).groupby("row").head(k)
        have = np.bincount(rows["row"], minlength=len(numbers))
        want = np.array([min(k, len(names) - (int(i) in names)) for i in numbers])
        short = (have < want) if ask < len(points) else np.zeros(len(numbers), bool)
        out.append(rows[~short[rows["row"]]].drop(columns="row"))
        numbers, queries, ask = numbers[short], queries[short], min(8 * ask, len(points))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _built(key: tuple, own: pa.Table) -> pa.Table:
    """A shard's rows (shard, ids, embedding) with their place and edges, a graph for each length of vector; place -1 - entry marks it."""
    out = []
    sizes = np.array([len(x) for x in own["embedding"]])
    for size in np.unique(sizes):
        mine = own.filter(pa.array(sizes == size))
        graph, start = build(lifted(_matrix(mine, size)))
        place = np.arange(len(mine))
        place[start] = -1 - start
        edges = [g[g < len(mine)] for g in graph[:-1]]
        out.append(pa.table({"shard": mine["shard"], "place": pa.array(place, pa.int32()), "ids": mine["ids"], "embedding": mine["embedding"], "edges": pa.array(edges, pa.list_(pa.int32()))}))
    return pa.concat_tables(out)


def _answers(k: int):
    def run(key: tuple, own: pa.Table, queries: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        sizes, asks = (np.array([len(x) for x in t["embedding"]]) for t in (own, queries))
        for size in np.intersect1d(sizes, asks):
            mine, theirs = own.filter(pa.array(sizes == size)), queries.filter(pa.array(asks == size))
            place = mine["place"].to_numpy()
            start = int(-1 - place.min())
            mine = mine.take(pa.array(np.argsort(np.where(place < 0, -1 - place, place))))
            edges = mine["edges"].combine_chunks()
            count = np.diff(edges.offsets.to_numpy())
            graph = np.full((len(mine) + 1, max(int(count.max()), 1)), len(mine), np.int32)
            graph[np.repeat(np.arange(len(mine)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = edges.flatten().to_numpy()
            found = nearest(mine["ids"].to_pylist(), _matrix(mine, size), graph, start, theirs["query_id"].to_numpy(), _matrix(theirs, size), k)
            out.append(pa.Table.from_pandas(found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False))
        return pa.concat_tables(out)

    return run


def search(embeddings: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD) -> DataFrame:
    """embeddings(vec_id, embedding) to (query_id, rank, vec_id, score): for each vec_id divisible by `every` its k nearest found."""
    spark = embeddings.sparkSession
    ship(spark)
    kind = embeddings.schema["embedding"].dataType.simpleString()
    v = F.transform("embedding", lambda x: x.cast("double"))
    real = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & real).distinct()
    nth = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    some = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)  # Spark limits each group before the shuffle too
    some = materialize(some.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = some.count()
    shards = max(1, -(-n // shard), min(SPREAD, n // FEW))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = max(1, -(-asked.count() // QUERIES))
    dealt = some.select(F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding")
    graphs = materialize(dealt.groupBy("shard").applyInArrow(_built, f"shard int, place int, ids array<long>, embedding {kind}, edges array<int>"), "ann-graphs")
    drop(some)
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_answers(k), "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["embedding"].chunks]).reshape(-1, size).astype(np.float64)


def op9_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
