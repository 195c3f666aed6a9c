"""python tests/llm/recall_ann.py FOLDER: recall of op9_graph_ann at 20 against brute force over FOLDER/embeddings.parquet, and the share of a
shard that a query meets. Not a test: for figures."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ripplegraph.llm import graph_ann as G  # noqa: E402

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    got = {}
    for r in G.op9_graph_ann(spark, sys.argv[1]).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{sys.argv[1]}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    hits = all_wanted = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits += len(got.get(ids[i], set()) & set(best.tolist()))
        all_wanted += len(best)
    points = G.lifted(x[: len(x) // G.SPREAD])
    graph, start = G.build(points)
    worked = G.beam_search(points, (points**2).sum(1), graph, start, np.concatenate([x[:500], np.zeros((len(x[:500]), 1))], 1).astype(np.float32), G.BEAM)[2]
    print(f"recall {hits / all_wanted:.4f}; a query meets {worked / len(x[:500]):.0f} of a shard of {len(points)}")
