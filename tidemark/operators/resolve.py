"""Nodes from edges, name lookup in tiers, similar names, entity resolution, relation repair.

Named edges: (seq, source, source_name, source_type, relation, target, target_name, target_type, file_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import cut

from . import graph
from .extract import clean_mention

# Relations whose target is a role of their source.
ROLES = "HAS_ROLE HAS_TITLE EMPLOYED_AS HOLDS_POSITION".split()
LEADS = "LEADS_PROJECT IS_PROJECT_LEAD_OF".split()
# Framing words that name no node, and words too common to tell nodes apart.
GENERIC = "minor minors major majors department course courses requirement requirements detail details program programs getting credit credits info information breakdown explain entity".split()
MODIFIERS = "engineering science sciences technology technologies studies study management development analysis application applications system systems theory theories model models method methods program programs course courses department school degree btech mtech phd".split()
# Short forms and a part of the name they stand for.
ACRONYMS = {"cse": "computer", "cs": "computer", "ece": "electrical", "ee": "electrical", "me": "mechanical", "ce": "civil", "math": "mathematics", "phy": "physics", "emh": "efficient market", "ai": "artificial intelligence"}
# Short and long forms that link nodes of several files.
EQUIVALENCES = [("cse", "computer science and engineering"), ("ece", "electrical and computer engineering"), ("ee", "electrical engineering"), ("me", "mechanical engineering"), ("ce", "civil engineering"), ("math", "mathematics"), ("phy", "physics"), ("chy", "chemistry"), ("sme", "school of management and entrepreneurship"), ("emh", "efficient market hypothesis"), ("rag", "retrieval augmented generation")]
SIMILAR, OVERLAP = 0.88, 0.6
# Words that do not tell names apart.
LINK_WORDS = "the a an and or of in for with at by from to on".split()


def nodes(edges: DataFrame) -> DataFrame:
    """(node, name, type, aliases, file_ids, role, told_role): the first sighting names a node, later ones add aliases and files.

    role: the last target of a role relation; told_role: the same, projects led included.

    Sightings are reduced to distinct (node, alias) and (node, file) pairs before the lists are made, so a node
    of very many edges costs a list of its distinct forms only.
    """
    side = lambda s, n: edges.select(F.col(s).alias("node"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_type").alias("type"), "file_id", (F.col("seq") * 2 + n).alias("at"))
    seen = side("source", 0).unionAll(side("target", 1)).where("node <> ''")
    first = seen.groupBy("node").agg(F.min_by(F.struct("name", "type"), "at").alias("f")).select("node", "f.*")
    forms = _ordered(seen, "name", "aliases")
    files = _ordered(seen.where("file_id <> ''"), "file_id", "file_ids")
    told = edges.where(F.col("relation").isin(ROLES + LEADS))
    role = told.groupBy(F.col("source").alias("node")).agg(F.max_by("target_name", F.when(F.col("relation").isin(ROLES), F.col("seq"))).alias("role"), F.max_by("target_name", "seq").alias("told_role"))
    none = F.array().cast("array<string>")
    return first.join(forms, "node").join(files, "node", "left").join(role, "node", "left").withColumn("file_ids", F.coalesce("file_ids", none))


def _ordered(seen: DataFrame, value: str, name: str) -> DataFrame:
    once = seen.groupBy("node", value).agg(F.min("at").alias("at"))
    return once.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(name))


def similar_names(asked: DataFrame, known: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(mention, name, score) of every pair at ``least`` or more, from (mention) and (name), both distinct.

    A name of length n is within t = floor((1 - least) * floor(n / least)) edits of every partner. It is cut into
    t + 1 segments, of which each partner holds one unchanged, near its place; pairs meet on (length, segment
    number, segment) and are then verified. No pair is lost, and no key is shared by more than look-alike names.
    """
    low = lambda c: F.lower(F.btrim(c))
    edits = lambda n: F.floor(F.lit(1 - least + 1e-9) * F.floor(n / F.lit(least) + 1e-9)).cast("int")
    cut = lambda i, n, t: F.floor(i * n / (t + 1)).cast("int")

    k = known.select("name", low("name").alias("k")).where("k <> ''").withColumn("n", F.length("k")).withColumn("t", edits(F.col("n")))
    pieces = F.transform(F.sequence(F.lit(0), F.col("t")), lambda i: F.struct(i.alias("no"), F.substr("k", cut(i, F.col("n"), F.col("t")) + 1, cut(i + 1, F.col("n"), F.col("t")) - cut(i, F.col("n"), F.col("t"))).alias("piece")))
    k = k.select("name", "n", F.explode(pieces).alias("p")).select("name", "n", "p.*")

    m = asked.select("mention", low("mention").alias("m")).where("m <> ''").withColumn("len", F.length("m"))
    m = m.withColumn("n", F.explode(F.sequence(F.ceil(F.col("len") * F.lit(least) - 1e-9).cast("int"), F.floor(F.col("len") / F.lit(least) + 1e-9).cast("int")))).withColumn("t", edits(F.col("n")))
    m = m.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("t"))))
    place, size, shift = cut(F.col("no"), F.col("n"), F.col("t")), cut(F.col("no") + 1, F.col("n"), F.col("t")) - cut(F.col("no"), F.col("n"), F.col("t")), F.col("len") - F.col("n")
    # a segment moves no farther than the edits before it, nor than those behind it
    lowest = F.greatest(F.lit(0), place - F.col("no"), place + shift - (F.col("t") - F.col("no")))
    highest = F.least(F.col("len") - size, place + F.col("no"), place + shift + (F.col("t") - F.col("no")))
    m = m.select("mention", "m", "n", "no", size.alias("size"), lowest.alias("a"), highest.alias("b")).where("a <= b")
    m = m.select("mention", "n", "no", F.explode(F.transform(F.sequence(F.col("a"), F.col("b")), lambda at: F.substr("m", at + 1, F.col("size")))).alias("piece")).distinct()
    pairs = m.join(k, ["n", "no", "piece"]).select("mention", "name").distinct()
    return pairs.withColumn("score", T.similarity(F.col("mention"), F.col("name"))).where(F.col("score") >= least)


def lookup(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(mention, node, tier): the node a mention means, by the first tier that finds one.

    known: (node, name, aliases, at), ``at`` their order. Tiers: 1 the id itself; 2 the canonical id; 3 a name or
    alias without regard to case; 4 the most similar alias; 5 a short form; 6 a phrase within the name; 7 shared words.
    Tier 6 here needs all words of the mention in sequence within the lower-cased name, so that pairs meet on words.
    A word of framing alone finds nothing after tier 4. Each tier takes only mentions the earlier ones left.
    """
    m = mentions.select("mention").where(F.btrim("mention") != "").distinct()
    aliases = known.select("node", "at", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("alias")).where("alias is not null")
    tiered = lambda rows, tier, score=F.lit(0.0): rows.select("mention", "node", F.lit(tier).alias("tier"), score.alias("score"), "at")
    best = lambda rows: rows.groupBy("mention").agg(F.min_by(F.struct("node", "tier"), F.struct("tier", "score", "at")).alias("x")).select("mention", "x.*")

    by_id = tiered(m.join(known.select("node", "at"), F.btrim("mention") == F.col("node")), 1)
    canonical = tiered(m.withColumn("node", T.canonical_id(F.col("mention"))).join(known.select("node", "at"), "node"), 2)
    named = tiered(m.withColumn("k", F.lower(F.btrim("mention"))).join(aliases.withColumn("k", F.lower("alias")), "k"), 3)
    # what the equi-joins found is kept, since the later tiers need it more than once
    exact = cut(best(by_id.unionByName(canonical).unionByName(named)))
    open_ = m.join(exact.select("mention"), "mention", "left_anti")
    near = similar_names(open_, aliases.select(F.col("alias").alias("name")).distinct()).join(aliases.withColumnRenamed("alias", "name"), "name")
    near = cut(best(tiered(near, 4, -F.col("score"))))

    rest = open_.join(near.select("mention"), "mention", "left_anti").withColumn("low", F.lower(F.btrim("mention"))).where(~F.col("low").isin(GENERIC))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ~w.isin(GENERIC)))
    named_ = known.select("node", "at", F.lower("name").alias("text"), words(F.col("name")).alias("held_words"))
    held = named_.select("node", F.explode("held_words").alias("word"))
    short = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])[F.col("low")]
    spelled = rest.withColumn("long", short).where("long is not null").withColumn("word", F.split_part("long", F.lit(" "), F.lit(1)))
    fifth = spelled.join(held, "word").join(named_, "node").where(F.contains("text", F.col("long")))
    # a node that shares six of ten words shares one of the five rarest: only those meet the nodes' words
    seldom = held.groupBy("word").agg(F.count("*").alias("times"))
    asked = rest.withColumn("ws", words(F.col("mention"))).withColumn("word", F.explode("ws")).join(seldom, "word")
    rare = asked.groupBy("mention", "low", "ws").agg(F.array_sort(F.collect_list(F.struct("times", "word"))).alias("all"))
    most = F.size("ws") - F.ceil(F.lit(OVERLAP) * F.size("ws") - 1e-9).cast("int") + 1 - (F.size("ws") - F.size("all"))
    first = rare.where(most > 0).withColumn("word", F.explode(F.transform(F.slice("all", 1, most), lambda x: x["word"]))).drop("all")
    own = F.filter("ws", lambda w: ~w.isin(MODIFIERS))
    pairs = first.join(held, "word").select("mention", "low", "ws", "node").distinct()
    meets = pairs.join(named_, "node").withColumn("common", F.array_intersect("ws", "held_words"))
    sixth = meets.where((F.length("low") >= 4) & F.contains(F.concat(F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N}_]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace("low", r"[^\p{L}\p{N}_]+", " "), F.lit(" "))))
    share = F.size("common") / F.size("ws")
    seventh = meets.where((share >= OVERLAP) & ((F.size(own) == 0) | F.arrays_overlap(own, F.col("common"))))
    late = best(tiered(fifth, 5).unionByName(tiered(sixth, 6)).unionByName(tiered(seventh, 7, -share)))
    return exact.unionByName(near).unionByName(late)


def healed(edges: DataFrame, prefix: str, branches: list[str], owner: str, owned: list[str]) -> DataFrame:
    """Relations repaired: OFFERED_BY of a source with ``prefix`` to a target naming one of ``branches`` (a short list,
    lower case) becomes OPEN_TO_STUDENTS_OF, unless it is the owner; each of ``owned`` that occurs gets its
    missing OFFERED_BY edge to the owner, with a null seq."""
    hit = F.lit(False)
    for b in branches:
        hit = hit | F.contains(F.lower("target"), F.lit(b))
    wrong = (F.col("relation") == "OFFERED_BY") & F.startswith("source", F.lit(prefix)) & (F.col("target") != owner) & hit
    fixed = edges.withColumn("relation", F.when(wrong, "OPEN_TO_STUDENTS_OF").otherwise(F.col("relation"))).select("seq", "source", "relation", "target")
    present = fixed.select(F.explode(F.array("source", "target")).alias("source")).where(F.col("source").isin(owned)).distinct()
    there = fixed.where((F.col("relation") == "OFFERED_BY") & (F.col("target") == owner)).select("source")
    made = present.join(there, "source", "left_anti").select(F.lit(None).cast("long").alias("seq"), "source", F.lit("OFFERED_BY").alias("relation"), F.lit(owner).alias("target"))
    return fixed.unionByName(made)


# Openings of names that are told first however short.
OPENINGS = ("Minor", "Department")


def ordered_names(names: Column) -> Column:
    """Names as one text: those of up to three characters last, each part in order."""
    late = lambda x: (~(x.startswith(OPENINGS[0]) | x.startswith(OPENINGS[1]) | (F.length(x) > 3))).cast("int")
    placed = F.array_sort(F.transform(names, lambda x: F.struct(late(x).alias("late"), x.alias("name"))))
    return F.array_join(F.transform(placed, lambda x: x["name"]), ", ")


def connecting(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain_id, hop_no, source, target, relation, is_reverse, seq): the edge between two nodes of a chain.

    The first forward edge, else the first reverse one, else CONNECTED_TO without an edge.
    """
    e = edges.select("seq", F.col("source").alias("s"), "relation", F.col("target").alias("t"))
    first = e.groupBy("s", "t").agg(F.min_by(F.struct("seq", "relation"), "seq").alias("e"))
    forward = pairs.join(first.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("e").alias("f")), ["source", "target"], "left")
    both = forward.join(first.select(F.col("t").alias("source"), F.col("s").alias("target"), F.col("e").alias("r")), ["source", "target"], "left")
    pick = F.coalesce("f", "r")
    return both.select("chain_id", "hop_no", "source", "target", F.coalesce(pick["relation"], F.lit("CONNECTED_TO")).alias("relation"), (F.col("f").isNull() & F.col("r").isNotNull()).alias("is_reverse"), pick["seq"].alias("seq"))


def path_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The hops of node lists (chain_id, path), each with its edge, in the path's direction."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop_no"), F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))
    pairs = paths.where(F.size("path") > 1).select("chain_id", F.explode(steps).alias("h")).select("chain_id", "h.*")
    return connecting(pairs, edges)


def hops_told(hops: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Path hops with the names and types of their ends and with the edge's evidence, file, page and stamp.

    known: (node, name, type); edges: (seq, source, relation, target, evidence, filename, file_id, page_number, timestamp). A hop without an edge has
    its names as evidence.
    """
    rev = F.col("is_reverse")
    placed = graph.named_hops(hops, known).withColumns({"_s": F.when(rev, F.col("target")).otherwise(F.col("source")), "_t": F.when(rev, F.col("source")).otherwise(F.col("target"))})
    told = edges.select("seq", F.col("source").alias("_s"), "relation", F.col("target").alias("_t"), "evidence", "filename", "file_id", "page_number", "timestamp").dropDuplicates(["seq", "_s", "relation", "_t"])
    rows = placed.join(told, ["seq", "_s", "relation", "_t"], "left").drop("_s", "_t")
    said = F.concat("from_name", F.lit(" -> "), "to_name")
    return rows.withColumns({"evidence": F.coalesce("evidence", said), "filename": F.coalesce("filename", F.lit("Unknown Source")), "file_id": F.coalesce("file_id", F.lit(""))})


def entity_of(mentions: DataFrame, known: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(mention, node, name): the node a cleaned mention means, else its own canonical id under its own form.

    known: (node, name, aliases, at). The canonical id counts first. Otherwise the first node by ``at`` counts for which one
    of these holds: its name or an alias is the mention without regard to case; both have four characters and are similar;
    the words of both are the same set, titles and short words aside. Pairs meet on these keys, not each with each.
    """
    m = mentions.select("mention").distinct().withColumn("clean", clean_mention(F.col("mention"))).withColumn("id", F.when(F.col("clean") == "", "ENTITY_UNKNOWN").otherwise(T.canonical_id(F.col("clean"))))
    low = lambda c: F.lower(F.col(c))
    words = lambda c: F.array_sort(F.array_except(F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")), F.array(*[F.lit(w) for w in (*T.HONORIFICS, *LINK_WORDS)])))
    forms = known.select("node", "at", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("form")).select("node", "at", F.lower("form").alias("k"))
    named = m.withColumn("k", low("clean")).join(forms, "k").select("mention", "node", "at")
    long_ = m.where(F.length("clean") >= 4)
    pairs = similar_names(long_.select(F.col("clean").alias("mention")).distinct(), known.where(F.length("name") >= 4).select("name").distinct(), least).select(F.col("mention").alias("clean"), "name")
    near = long_.join(pairs, "clean").join(known.select("node", "at", "name"), "name").select("mention", "node", "at")
    same = m.withColumn("ws", words("clean")).where(F.size("ws") > 0).join(known.withColumn("ws", words("name")), "ws").select("mention", "node", "at")
    first = named.unionByName(near).unionByName(same).groupBy("mention").agg(F.min_by("node", "at").alias("other"))
    exact = m.join(known.select(F.col("node").alias("id")), "id", "left_semi").select("mention", F.col("id").alias("own"))
    node = F.when(F.col("clean") == "", F.col("id")).otherwise(F.coalesce("own", "other", "id"))
    rows = m.join(exact, "mention", "left").join(first, "mention", "left").withColumn("node", node)
    rows = rows.join(known.select("node", F.col("name").alias("known_name")), "node", "left")
    return rows.select("mention", "node", F.when(F.col("clean") == "", "Unknown").otherwise(F.coalesce("known_name", "clean")).alias("name"))


def traversed(edges: DataFrame, source: str, target: str, depth: int = 3, most: int = 20) -> DataFrame:
    """(hop_no, source, relation, target, part): hops of the shortest path, then the first ``most`` of the search around both
    ends by (depth, seq, source, target), the first of each (source, relation, target)."""
    spark = edges.sparkSession
    path = cut(graph.shortest_paths(edges, source, target).select(F.lit(1).alias("chain_id"), "path"))
    own = path_hops(path, edges).select(F.lit("path").alias("part"), F.col("hop_no").cast("long").alias("at"), F.col("seq"), "source", "relation", "target")
    seeds = spark.createDataFrame([(source,), (target,)], "node string")
    around = graph.hops(edges, graph.bfs(edges, seeds, depth), depth).orderBy("depth", "seq", "source", "target").limit(most)
    around = around.select(F.lit("search").alias("part"), F.col("depth").cast("long").alias("at"), "seq", "source", "relation", "target")
    order = F.struct("part", "at", "seq", "source", "target")
    first = own.unionByName(around).groupBy("source", "relation", "target").agg(F.min(order).alias("o"))
    n = F.row_number().over(Window.orderBy("o"))  # the path and ``most`` hops at the most
    return first.select(n.alias("hop_no"), "source", "relation", "target", F.col("o.part").alias("part"))


def search(known: DataFrame, degree: DataFrame, text: str) -> DataFrame:
    """Connected nodes (node, name, type, degree) whose name or type holds the text without regard to case."""
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("type"), F.lit(text.lower()))
    return known.where(hit).join(degree, "node").select("node", "name", "type", "degree")
