"""Balanced label propagation: linked documents move towards each other's shards under capacity quotas.

Equal texts are one node, so they share a label. Nodes are linked by the lines they share; a line is kept as one
hyperedge (line, node), never as pairs. In each round every line counts its nodes by shard, every node adds up what its
lines say, a line counting less the more nodes it has, and wants to move to the shard with most
weight. A shard takes in what its free capacity and the wishes to leave it allow; which nodes move is drawn by a hash, so
that a round needs one sum per shard and no ranking.

Lines of fewer than `LINE_BYTES` bytes are no links. The rounds end when no node wants to move, after `ROUNDS` at most.

Last, every shard is filled to the same number of bytes: each label's documents stay up to the quota, those larger than `LARGE` of a shard first,
then the nodes with a link inside their label, then the others, larger ones first and equal texts together; what lies
beyond the quota goes, in order, to the shards with room. So mostly small documents without links leave. A group of equal texts stays in one piece, but for the
few pieces at shard ends; a group larger than a shard fills several. Shards differ by about one of the smaller documents.

Null texts are one group of size 1 each. Rows with equal id and text are told apart by their place alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import as_struct, query, running_totals, stage, table

SHARDS = 16
ROUNDS = 4
SLACK = 0.05
LINE_BYTES = 32
LARGE = 0.04


def uniform(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def line_links(docs: DataFrame, line_bytes: int = LINE_BYTES) -> DataFrame:
    """(link, node, weight): lines of some length that several nodes hold."""
    lines = docs.where("text is not null").select("node", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.octet_length("line") >= line_bytes).select("node", F.xxhash64("line").alias("link"))
    pairs = stage(lines.groupBy("link", "node").agg(F.count("*").alias("times")), "lines")
    # kept, so that both sides of the joins on a link are plain shuffles and a line of very many nodes can be split
    shared = stage(pairs.groupBy("link").agg(F.count("*").alias("nodes")).where("nodes > 1"), "shared")
    return stage(pairs.join(shared, "link").select("link", "node", (F.lit(1.0) / (F.col("nodes") - 1)).alias("weight")), "links")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """(node, bytes, label) of nodes (node, bytes) after the rounds. The driver gets a row for each shard and round."""
    labels = stage(nodes.withColumn("label", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        placed = links.join(labels.select("node", "label"), "node")
        votes = placed.groupBy("link", "label").agg(F.count("*").alias("n"))
        heard = placed.select("link", "node", "weight", F.col("label").alias("own")).join(votes, "link")
        gains = heard.groupBy("node", "own", "label").agg(
            F.sum(F.col("weight") * (F.col("n") - F.when(F.col("own") == F.col("label"), 1).otherwise(0))).alias("gain"))
        best = gains.groupBy("node").agg(F.max(F.struct("gain", (-F.col("label")).alias("to"))).alias("b"),
                                         F.max(F.when(F.col("own") == F.col("label"), F.col("gain"))).alias("stay"))
        wants = best.where("b.gain > coalesce(stay, 0)").select("node", (-F.col("b.to")).alias("to"))
        wished = stage(labels.join(wants, "node", "left"), "wishes")
        totals = {r.label: r for r in wished.groupBy("label").agg(F.sum("bytes").alias("bytes"), F.sum(
            F.when(F.col("to").isNotNull() & (F.col("to") != F.col("label")), F.col("bytes")).otherwise(0)).alias("leaving")).collect()}
        coming = {r.to: r.bytes for r in wished.where("to <> label").groupBy("to").agg(F.sum("bytes").alias("bytes")).collect()}
        if not coming:
            break
        capacity = (1 + slack) * sum(r.bytes for r in totals.values()) / shards
        allowed = {s: max(0.0, capacity - (totals[s].bytes if s in totals else 0)) + 0.5 * (totals[s].leaving if s in totals else 0) for s in coming}
        share = F.create_map(*[F.lit(x) for s in coming for x in (s, min(1.0, allowed[s] / coming[s]))])
        most = F.create_map(*[F.lit(x) for s in coming for x in (s, float(allowed[s]))])
        moves = (F.col("to").isNotNull() & (F.col("to") != F.col("label")) & (uniform("node", F.lit(turn)) < share[F.col("to")])
                 & (F.col("bytes") <= most[F.col("to")]))
        labels = stage(wished.select("node", "bytes", F.when(moves, F.col("to")).otherwise(F.col("label")).cast("int").alias("label")), "labels")
    return labels


def linked_inside(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node) of the nodes that share a line with another node of their label."""
    placed = links.join(labels.select("node", "label"), "node").select("link", "node", "label")
    several = placed.groupBy("link", "label").agg(F.count("*").alias("n")).where("n > 1").select("link", "label")
    return placed.join(several, ["link", "label"]).select("node").distinct()


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, keep: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns `keep` of docs (doc_id, text)."""
    clash = set(keep) & {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    if clash:
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    kept_columns = [as_struct(docs, keep).alias("doc")] if keep else []
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("node"), *kept_columns)
    sizes = stage(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "node", *(["doc"] if keep else []),
                              (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                              F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "sizes")
    nodes = sizes.groupBy("node").agg(F.sum("size").alias("bytes"))
    links = line_links(rows.select("node", "text"))
    labels = propagate(nodes, links, shards, rounds, slack)
    tied = linked_inside(labels, links).withColumn("tied", F.lit(True))
    labels = stage(labels.select("node", "label").join(tied, "node", "left"), "tied")
    labelled = sizes.join(labels, "node").withColumn("one", F.lit(1))
    large = LARGE * (sizes.agg(F.sum("size")).first()[0] or 0) / shards
    group = F.when(F.col("size") > large, 0).when(F.col("tied"), 1).otherwise(2)
    order = [F.col("label"), group, F.desc("size"), F.col("node"), F.col("doc_id")]
    placed = stage(running_totals(labelled, order, {"before": "size"}), "placed")
    by_label = {r.label: r for r in placed.groupBy("label").agg(F.sum("size").alias("bytes"), F.min("before").alias("start")).collect()}
    quota = sum(r.bytes for r in by_label.values()) / shards
    start = F.create_map(*[F.lit(x) for s, r in by_label.items() for x in (s, r.start)]) if by_label else F.lit(None)
    inside = (F.col("before") - start[F.col("label")]) if by_label else F.lit(0)
    placed = placed.withColumn("inside", inside).withColumn("stays", F.col("inside") + F.col("size") / 2 <= F.lit(quota))
    kept = {r.label: r.bytes for r in placed.where("stays").groupBy("label").agg(F.sum("size").alias("bytes")).collect()}
    # what does not stay, laid end to end over the room that is left
    over, moved, room, filled = {}, 0, [], 0.0
    for s in range(shards):
        rest = (by_label[s].bytes if s in by_label else 0) - kept.get(s, 0)
        over[s] = moved - kept.get(s, 0)
        moved += rest
    gaps = [max(0.0, quota - kept.get(s, 0)) for s in range(shards)]
    scale = moved / sum(gaps) if sum(gaps) else 1.0
    for s in range(shards):
        filled += gaps[s] * scale
        room.append(filled)
    offset = F.create_map(*[F.lit(x) for s, v in over.items() for x in (s, v)])
    line = F.col("inside") + offset[F.col("label")] + F.col("size") / 2
    target = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        target = F.when(line < F.lit(room[s]), s).otherwise(target)
    placed = placed.withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(target).cast("int")).drop("before", "inside", "stays")
    ranked = running_totals(placed, [F.col("shard"), F.col("label"), F.col("node"), F.col("doc_id")], {"place": "one"})
    ranked = stage(ranked, "ranked")
    firsts = {r.shard: r.place for r in ranked.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    first = F.create_map(*[F.lit(x) for s, v in firsts.items() for x in (s, v)])[F.col("shard")] if firsts else F.lit(0)
    return ranked.select("doc_id", *[F.col(f"doc.`{c}`").alias(c) for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op1_label_propagation_shards")
def op1(spark, folder):
    return shard_documents(table(spark, folder, "documents").select("doc_id", "text"))
