"""Contact graphs: adjacency, degrees, partitions and borders. Parallel edges count as often as they are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.running import running_sum

LIST = 4096


def contacts(orders: DataFrame) -> DataFrame:
    """edges(a, b): customers whose orders follow each other on the same day; a customer is no contact of its own."""
    w = W.partitionBy("o_orderdate").orderBy("o_orderkey")
    return orders.select(F.col("o_custkey").alias("a"), F.lead("o_custkey").over(w).alias("b")).where("b IS NOT NULL AND a <> b")


def supplies(lineitem: DataFrame) -> DataFrame:
    """edges(a, b): parts and their suppliers, suppliers numbered after the largest part key."""
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    shift = lineitem.agg((F.max("l_partkey") + 1).alias("shift"))
    return pairs.crossJoin(F.broadcast(shift)).select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + F.col("shift")).alias("b"))  # one row


def adjacency(edges: DataFrame) -> DataFrame:
    """edges(a, b) to slots (src, dst), each edge from both its ends; a self-loop gives its node two."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def neighbours(adj: DataFrame, most: int = LIST) -> DataFrame:
    """adj(src, dst) to (src, degree, dsts): each node's slots as lists of about `most` at most, so that a join by src sees a row for each
    node, and a hub's slots are dealt over many rows. degree is that of the node, not of the list."""
    degrees = adj.groupBy("src").agg(F.count("*").alias("degree"))
    part = F.when(F.col("degree") > most, F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / most))).otherwise(0)
    return adj.join(degrees, "src").groupBy("src", "degree", part.alias("part")).agg(F.collect_list("dst").alias("dsts")).select("src", "degree", "dsts")


def degree(people: DataFrame, adj: DataFrame) -> DataFrame:
    """people(id) to (id, degree), 0 for the isolated."""
    count = adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return people.select("id").join(count, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_histogram(degrees: DataFrame) -> DataFrame:
    """(degree, people) for the degrees that occur."""
    return degrees.groupBy("degree").agg(F.count("*").alias("people"))


def degree_summary(degrees: DataFrame) -> DataFrame:
    """One row: mean, upper median, 99th percentile by rank, maximum, the share of all slots that nodes from that rank on hold,
    and maximum over median (0 where the median is 0). Ranks come from running sums over the histogram, not over the people."""
    bins = degree_histogram(degrees)
    bins = running_sum(bins, "people", ["degree"])
    whole = bins.agg(F.sum("people").alias("n"), F.sum(F.col("people") * F.col("degree")).alias("all_slots"))
    bins = bins.crossJoin(F.broadcast(whole))  # one row
    cut = F.floor(F.col("n") * 0.99)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("degree")))
    above = F.when(F.col("upto") > cut, F.least(F.col("people"), F.col("upto") - cut) * F.col("degree")).otherwise(0)
    one = bins.agg((F.max("all_slots") / F.max("n")).alias("mean"), at(F.expr("n div 2")).alias("median"), at(cut).alias("p99"), F.max("degree").alias("largest"), F.sum(above).alias("above"), F.max("all_slots").alias("slots"))
    return one.select(
        F.round("mean", 6).alias("mean"),
        "median",
        "p99",
        "largest",
        F.round(F.when(F.col("slots") > 0, F.col("above") / F.col("slots")).otherwise(0.0), 6).alias("top_share"),
        F.round(F.when(F.col("median") > 0, F.col("largest") / F.col("median")).otherwise(0.0), 6).alias("largest_to_median"),
    )


def block_owner(node: Column, parts: int, people: int) -> Column:
    """Which of `parts` contiguous blocks of 0..people-1 a node is in: node * parts / people, rounded down."""
    scaled = node.cast("long") * parts
    return ((scaled - F.pmod(scaled, F.lit(people).cast("long"))) / people).cast("int")  # exact, where a plain quotient of longs may round


def cut_edges(adj: DataFrame, parts: int, people: int, owners: DataFrame | None = None) -> DataFrame:
    """Slots (src, dst, src_owner, dst_owner) that cross between owners: contiguous blocks, which follow from the ids so that nothing is
    shuffled, or any assignment owners(id, owner), a row for each node."""
    if owners is None:
        owned = adj.select("src", "dst", block_owner(F.col("src"), parts, people).alias("src_owner"), block_owner(F.col("dst"), parts, people).alias("dst_owner"))
    else:
        of = lambda end: owners.select(F.col("id").alias(end), F.col("owner").alias(f"{end}_owner"))
        owned = adj.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", "src_owner", "dst_owner")
    return owned.where("src_owner <> dst_owner")


def halo(adj: DataFrame, parts: int, people: int, owners: DataFrame | None = None) -> DataFrame:
    """(owner, neighbour, ghosts): how many people of `neighbour` the owner `owner` has to know, by at least one of its own."""
    ghosts = cut_edges(adj, parts, people, owners).select(F.col("dst_owner").alias("owner"), F.col("src_owner").alias("neighbour"), "src").distinct()
    return ghosts.groupBy("owner", "neighbour").agg(F.count("*").alias("ghosts"))


def border(adj: DataFrame, parts: int, people: int, owners: DataFrame | None = None) -> DataFrame:
    """(owner, neighbour, people): how many of `owner`'s people have to be sent to `neighbour`."""
    return halo(adj, parts, people, owners).select(F.col("neighbour").alias("owner"), F.col("owner").alias("neighbour"), F.col("ghosts").alias("people"))


def halo_summary(adj: DataFrame, parts: int, people: int, owners: DataFrame | None = None) -> DataFrame:
    """One row: all ghosts, as a share of the people in percent, and whole KB a day at four bytes each."""
    total = halo(adj, parts, people, owners).agg(F.coalesce(F.sum("ghosts"), F.lit(0)).alias("ghosts"))
    return total.select("ghosts", F.round(100.0 * F.col("ghosts") / max(people, 1), 6).alias("percent"), F.expr("ghosts * 4 div 1024").alias("kb_per_day"))


def offsets(people: DataFrame, adj: DataFrame) -> DataFrame:
    """(id, start, stop): each node's slots in a list ordered by node."""
    done = running_sum(degree(people, adj), "degree", ["id"], "stop")
    return done.select("id", (F.col("stop") - F.col("degree")).alias("start"), "stop")
