"""Edge and node tables and their traversal, by joins. Edges: (seq, source, relation, target, file_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, relation, target); empty ends and loops are dropped."""
    kept = edges.where("source <> '' and target <> '' and source <> target")
    return kept.groupBy("source", "relation", "target").agg(F.min_by(F.struct("seq", "file_id"), "seq").alias("e"), F.count("*").alias("sightings")).select("e.seq", "source", "relation", "target", "e.file_id", "sightings")


def ends(edges: DataFrame) -> DataFrame:
    """(node, other, seq) for both directions."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "seq")
    return out.unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "seq"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def prune(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges of active files, and those without a file."""
    own = edges.where("file_id <> ''").join(active.select("file_id").distinct(), "file_id", "left_semi")
    return own.unionByName(edges.where("file_id = '' or file_id is null"))


def without_file(edges: DataFrame, file_id: str) -> DataFrame:
    return edges.where(~F.col("file_id").eqNullSafe(F.lit(file_id)))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node, ...) that an edge touches."""
    return nodes.join(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "node", "left_semi")


def pruned(nodes: DataFrame, edges: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files that are not active went, and with them the nodes left alone; with no active file, neither."""
    kept = prune(edges, active) if not active.isEmpty() else edges.limit(0)
    return connected(nodes, kept), kept


def removed(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a file's edges went, and with them the nodes left alone."""
    kept = without_file(edges, file_id)
    return connected(nodes, kept), kept


def exported(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their degree, less those without; counts: node_count, edge_count in one row)."""
    out = nodes.join(degrees(edges), "node")
    return out, out.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


def saved(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes both tables with all their columns, as packed JSON lines under ``path``."""
    nodes.write.option("compression", "gzip").json(f"{path}/nodes")
    edges.write.option("compression", "gzip").json(f"{path}/edges")


# What a stored node or edge has where its file leaves it out.
STORED_TYPE, STORED_CONFIDENCE = "CONCEPT", 0.9


def loaded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that :func:`saved` wrote, or others of that form; missing values get their defaults."""
    kind = "id string, canonical_id string, name string, type string, aliases array<string>, file_ids array<string>"
    n = spark.read.schema(kind).json(f"{path}/nodes").withColumn("node", F.coalesce("id", "canonical_id", "name"))
    name, none = F.coalesce("name", "node"), F.array().cast("array<string>")
    nodes = n.select("node", name.alias("name"), F.coalesce("type", F.lit(STORED_TYPE)).alias("type"), F.coalesce("aliases", F.array(name)).alias("aliases"), F.coalesce("file_ids", none).alias("file_ids"))
    kind = "seq long, source string, relation string, target string, evidence string, file_id string, filename string, chunk_id string, timestamp string, page_number int, confidence double"
    e = spark.read.schema(kind).json(f"{path}/edges")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("evidence", "file_id", "filename", "chunk_id")}
    return nodes, e.withColumns({**empty, "confidence": F.coalesce("confidence", F.lit(STORED_CONFIDENCE))})


def named_hops(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops with from_name, from_type, to_name, to_type of their source and target; a node that is not known names itself."""
    side = lambda c, p: nodes.select(F.col("node").alias(c), F.col("name").alias(f"{p}_name"), F.col("type").alias(f"{p}_type"))
    rows = hops.join(side("source", "from"), "source", "left").join(side("target", "to"), "target", "left")
    filled = {f"{p}_name": F.coalesce(f"{p}_name", c) for p, c in (("from", "source"), ("to", "target"))}
    return rows.withColumns({**filled, **{f"{p}_type": F.coalesce(f"{p}_type", F.lit(STORED_TYPE)) for p in ("from", "to")}})


def searched(edges: DataFrame, seeds: list[str], depth: int = 3, most: int = 25, target_filename: str | None = None) -> DataFrame:
    """(hop_no, level, seq, source, relation, target): the hops in the order in which a queue would walk them from the seeds.

    A node's edges come as outgoing ones by neighbour (in the order of its first edge) and seq, then incoming ones; each edge is walked from
    the end that is visited first. The search ends with the node at which ``most`` hops are reached, and ``most`` stay, those of
    a target file first. Nodes carry the number of their discovery. A level's first ``most`` hops are taken where they lie;
    only if all were fewer does the search go on, so frontiers never exceed ``most`` nodes, however many edges a hub has.
    """
    spark = edges.sparkSession
    pairs = edges.groupBy("source", "target").agg(F.min("seq").alias("nb"))
    rows = edges.select("seq", "source", "relation", "target", *(["filename"] if target_filename else [])).join(pairs, ["source", "target"])
    out = rows.select("*", F.col("source").alias("node"), F.col("target").alias("other"), F.lit(0).alias("way"))
    both = cut(out.unionByName(rows.where("source <> target").select("*", F.col("target").alias("node"), F.col("source").alias("other"), F.lit(1).alias("way"))))
    order = ["no", "way", "nb", "other", "seq", "relation"]
    own = [F.when(F.lower("filename") == target_filename.lower(), 0).otherwise(1)] if target_filename else []
    numbered = list(dict.fromkeys(seeds))
    visited = front = spark.createDataFrame(list(zip(numbered, range(len(numbered)))), "node string, no long")
    parts, left, last = None, most, len(numbered)
    for level in range(depth):
        # frontier and visited nodes are at most the seeds and ``most`` more
        met = both.join(F.broadcast(front), "node").join(F.broadcast(visited.select(F.col("node").alias("other"), F.col("no").alias("other_no"))), "other", "left")
        met = met.where("other_no is null or other_no >= no")
        counts, reached = 0, None
        for r in met.groupBy("no").agg(F.count("*").alias("n")).orderBy("no").collect():  # a row a frontier node
            counts += r["n"]
            if counts >= left:
                reached = r["no"]
                break
        part = met if reached is None else met.where(F.col("no") <= reached)
        part = cut(part.orderBy(*own, *order).limit(most if own else left).withColumn("level", F.lit(level)))
        parts, left = part if parts is None else parts.unionByName(part), left - counts
        if reached is not None or level == depth - 1:
            break
        new = part.where("other_no is null").groupBy("other").agg(F.min(F.struct(*order)).alias("o"))
        front = cut(new.select(F.col("other").alias("node"), (F.row_number().over(Window.orderBy("o")) + last - 1).cast("long").alias("no")))
        last += front.count()
        visited = visited.unionByName(front)
    every = [*own, "level", *order]
    first = parts.orderBy(*every).limit(most)
    return first.withColumn("hop_no", F.row_number().over(Window.orderBy(*every))).select("hop_no", "level", "seq", "source", "relation", "target")


def around(edges: DataFrame, nodes: DataFrame, seeds: list[str], depth: int = 3, most: int = 25, target_filename: str | None = None) -> DataFrame:
    """The hops of :func:`searched`, with names and types and the columns of the edges."""
    found = searched(edges, seeds, depth, most, target_filename).join(edges, ["seq", "source", "relation", "target"])
    return named_hops(found, nodes)


def matching_nodes(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(end, node): the node an edge's end (end) means: by id, name, name or alias without regard to case; the first of these."""
    low = lambda c: F.lower(F.btrim(c))
    by_id = ends.select("end").join(nodes.select(F.col("node").alias("end"), "node"), "end").withColumn("tier", F.lit(1))
    by_name = ends.select("end").join(nodes.select(F.col("name").alias("end"), "node"), "end").withColumn("tier", F.lit(2))
    forms = nodes.select("node", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("form"))
    by_form = ends.select("end", low("end").alias("k")).join(forms.select("node", low("form").alias("k")), "k").select("end", "node", F.lit(3).alias("tier"))
    every = by_id.unionByName(by_name).unionByName(by_form)
    return every.groupBy("end").agg(F.min(F.struct("tier", "node")).alias("m")).select("end", "m.node")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth) within ``depth`` undirected steps of the seeds: one join and one anti join a level.

    The edge side and each level are checkpointed, so a level's plan does not contain the earlier ones.
    """
    both = cut(ends(edges).select("node", "other").distinct())
    seen = front = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        step = both.join(front.select("node"), "node").select(F.col("other").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def hops(edges: DataFrame, reached: DataFrame, depth: int = 3) -> DataFrame:
    """Edges that the search walks: those with an end of a depth below ``depth``, with the least such depth."""
    near = reached.where(F.col("depth") < depth)
    own = edges.select("seq", "source", "relation", "target")
    touching = own.join(near.withColumnRenamed("node", "source"), "source").unionByName(own.join(near.withColumnRenamed("node", "target"), "target"))
    return touching.groupBy("seq", "source", "relation", "target").agg(F.min("depth").alias("depth"))


def shortest_paths(edges: DataFrame, source: str, target: str, log: list | None = None) -> DataFrame:
    """(path, length): the least node list among the shortest undirected paths, of any length; no row if there is none.

    The search runs from both ends, and the side from which fewer edges lead on grows. Each level keeps one path a node, the
    least, so no frontier exceeds the nodes of the graph. A neighbour of a level lies in it, in the one before or in the next, so two levels are all
    that a step is checked against. Once the frontiers share a node, every shortest path crosses them in one, and its
    least path is the least way to it with the least way on. log: gets (side, nodes) for each step.
    """
    both = cut(ends(edges).select("node", "other").distinct())
    spark = edges.sparkSession
    # as tables their size is known, so the edges are not shuffled to meet them
    front = {s: cut(spark.createDataFrame([(n, [n])], "node string, path array<string>")) for s, n in (("source", source), ("target", target))}
    before = {s: f.limit(0) for s, f in front.items()}
    leading = lambda s: both.join(front[s].select("node"), "node").count()
    size = {s: leading(s) for s in front}
    met = None
    while met is None or (met.isEmpty() and all(size.values())):
        if met is not None:
            s = "source" if size["source"] <= size["target"] else "target"
            grown = F.concat("path", F.array("other")) if s == "source" else F.concat(F.array("other"), "path")
            step = both.join(front[s].select("node", "path"), "node").select(F.col("other").alias("node"), grown.alias("path"))
            seen = before[s].select("node").unionByName(front[s].select("node"))
            before[s], front[s] = front[s], cut(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
            size[s] = leading(s)
            if log is not None:
                log.append((s, front[s].count()))
        met = cut(front["source"].join(front["target"].select("node", F.col("path").alias("rest")), "node"))
    whole = met.select(F.concat("path", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).alias("path"))
    return whole.agg(F.min("path").alias("path")).where("path is not null").select("path", (F.size("path") - 1).alias("length"))


def bridges(nodes: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(source, target): EQUIVALENT_TO links between the greatest node holding a short form as a word and the
    greatest node holding the long form, where no edge leads from one to the other. ``pairs`` is a short list."""
    spark = nodes.sparkSession
    known = F.broadcast(spark.createDataFrame(pairs, "short string, long string"))
    name = F.lower(F.btrim("node"))
    short = nodes.select("node", F.explode(F.split(name, r"\s+")).alias("short")).join(known, "short").groupBy("short", "long").agg(F.max("node").alias("source"))
    long_ = nodes.join(known, F.contains(name, F.col("long"))).groupBy("long").agg(F.max("node").alias("target"))
    made = short.join(long_, "long").where("source <> target").select("source", "target")
    return made.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")
