"""The running registry of entities, in parallel: the result of telling triples one after another, without doing so.

Told in order of ``seq``, a triple's two mentions are looked up among the nodes that earlier triples registered: the node of the mention's own
id; else the first registered whose name is the same without regard to case, similar, or has the same words; else the mention becomes a
node, once its triple is kept. A triple whose ends are one node, or unknown, is dropped and registers nothing.

What a mention means hangs only on earlier mentions that are like it. So likeness is found once, by equi-joins over distinct forms, and triples
are decided in rounds: a triple is decided once no open earlier triple could still register a node that one of its mentions is
like. The first open triple always can be, and unlike ones don't wait for each other, so rounds grow with the longest chain of forms
each like the one before, not with the triples. A form holds back others only up to the time from which it has a node itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import cut

from .extract import clean_mention, relation_name
from .resolve import LINK_WORDS, SIMILAR, similar_names

#: Before and after all places in the order; places are 2 * seq for sources and 2 * seq + 1 for targets.
FIRST, NEVER = -(1 << 62), 1 << 62
#: The shortest names that count as similar.
LEAST_LETTERS = 4


def words(name):
    """The words of a name that tell it apart, as an ordered set."""
    own = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_except(F.array_distinct(own), F.array(*[F.lit(w) for w in (*T.HONORIFICS, *LINK_WORDS)])))


def alike(forms: DataFrame, names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(form, name): every pair of which a mention of the form finds a node of the name; forms (form), names (name), distinct."""
    same = forms.withColumn("k", F.lower("form")).join(names.withColumn("k", F.lower("name")), "k").select("form", "name")
    long_ = lambda df, c: df.where(F.length(c) >= LEAST_LETTERS)
    near = similar_names(long_(forms, "form").withColumnRenamed("form", "mention"), long_(names, "name"), least).select(F.col("mention").alias("form"), "name")
    worded = forms.withColumn("ws", words(F.col("form"))).where(F.size("ws") > 0).join(names.withColumn("ws", words(F.col("name"))), "ws").select("form", "name")
    return same.unionByName(near).unionByName(worded).distinct()


def registered(triples: DataFrame, known: DataFrame | None = None, least: float = SIMILAR, log: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, nodes). Triples (seq, source, relation, target, ...), seq unique, come with source_id, source_name, target_id and
    target_name, the dropped ones gone; nodes: (node, name, at, aliases), known ones included.

    known: (node, name, aliases, at) of nodes that were there before, in order of ``at``. log: gets (round, open, decided).
    """
    spark = triples.sparkSession
    raw = triples.select(F.col("seq").cast("long").alias("seq"), "source", "target")
    clean = lambda c: clean_mention(F.col(c))
    open_ = cut(raw.select("seq", clean("source").alias("s"), clean("target").alias("t")))
    forms = cut(open_.select(F.explode(F.array("s", "t")).alias("form")).where("form <> ''").distinct().withColumn("id", T.canonical_id(F.col("form"))))
    # forms of one id hold each other back like similar ones, and all are their own like
    own_id = forms.select("form", "id").join(forms.select(F.col("form").alias("name"), "id"), "id").select("form", "name")
    like = cut(alike(forms.select("form"), forms.select(F.col("form").alias("name")), least))
    holds = cut(like.unionByName(own_id).distinct())

    # settled: for each form, the first place from which its own id is a node (of), and of the first node that it is like (other)
    leaders = spark.createDataFrame([], "id string, name string, at long")
    if known is not None:
        old = known.select(F.col("node").alias("id"), "name", (F.lit(FIRST) + F.col("at")).cast("long").alias("at"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
        leaders = cut(old.select("id", "name", "at"))
        told = old.select("id", "at", F.explode(F.array_union("aliases", F.array("name"))).alias("alias"))
        by_alias = forms.select("form", F.lower("form").alias("k")).join(told.withColumn("k", F.lower("alias")), "k").select("form", "id", "at")
        by_name = alike(forms.select("form"), leaders.select("name").distinct(), least).join(leaders, "name").select("form", "id", "at")
        first_like = by_alias.unionByName(by_name).withColumnRenamed("id", "other")
        first_like = first_like.groupBy("form").agg(F.min(F.struct("at", "other")).alias("o")).select("form", F.col("o.at").alias("other_at"), F.col("o.other").alias("other"))
    else:
        first_like = spark.createDataFrame([], "form string, other_at long, other string")
    state = forms.join(leaders.select("id", F.col("at").alias("own_at")), "id", "left").join(first_like, "form", "left")
    state = cut(state.select("form", "id", F.coalesce("own_at", F.lit(NEVER)).alias("own_at"), F.coalesce("other_at", F.lit(NEVER)).alias("other_at"), "other"))
    done, number = None, 0
    while not open_.isEmpty():
        number += 1
        # a form may become a node at its first open place, unless it finds one there
        mention = open_.select(F.explode(F.array(F.struct(F.col("s").alias("form"), (F.col("seq") * 2).alias("at")), F.struct(F.col("t").alias("form"), (F.col("seq") * 2 + 1).alias("at")))).alias("m")).select("m.*")
        free = mention.groupBy("form").agg(F.min("at").alias("at")).join(state.select("form", F.least("own_at", "other_at").alias("until")), "form").where(_before("until", "at") == F.lit(False))
        held = holds.join(free.select(F.col("form").alias("name"), "at"), "name").groupBy("form").agg(F.min("at").alias("held"))
        now = cut(state.join(held, "form", "left").withColumn("held", F.coalesce("held", F.lit(NEVER))))
        side = lambda c: now.select(F.col("form").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("id", "own_at", "other_at", "other", "held")])
        rows = open_.join(side("s"), "s", "left").join(side("t"), "t", "left")
        ready, node = {}, {}
        for c, n in (("s", 0), ("t", 1)):
            at = F.col("seq") * 2 + n
            own = _seen(F.col(f"{c}_own_at"), at)
            other = _seen(F.col(f"{c}_other_at"), at)
            ready[c] = (F.col(c) == "") | own | ~_seen(F.col(f"{c}_held"), at)
            node[c] = F.when(F.col(c) == "", "ENTITY_UNKNOWN").when(own, F.col(f"{c}_id")).when(other, F.col(f"{c}_other")).otherwise(F.col(f"{c}_id"))
            rows = rows.withColumn(f"{c}_new", (F.col(c) != "") & ~own & ~other)
        rows = rows.withColumns({"ready": ready["s"] & ready["t"], "s_node": node["s"], "t_node": node["t"]})
        rows = cut(rows.select("seq", "s", "t", "ready", "s_node", "t_node", "s_new", "t_new"))
        kept = rows.where("ready and s_node <> t_node and s_node <> 'ENTITY_UNKNOWN' and t_node <> 'ENTITY_UNKNOWN'")
        made = kept.where("s_new").select(F.col("s_node").alias("id"), F.col("s").alias("name"), (F.col("seq") * 2).alias("at"))
        made = cut(made.unionByName(kept.where("t_new").select(F.col("t_node").alias("id"), F.col("t").alias("name"), (F.col("seq") * 2 + 1).alias("at"))))
        leaders = leaders.unionByName(made)
        part = kept.select("seq", "s_node", "t_node")
        done = part if done is None else done.unionByName(part)
        if log is not None:
            n = rows.agg(F.count("*").alias("open"), F.count(F.when(F.col("ready"), 1)).alias("decided")).first()
            log.append((number, n["open"], n["decided"]))
        found = like.join(made, "name").groupBy("form").agg(F.min(F.struct("at", "id")).alias("o")).select("form", F.col("o.at").alias("new_at"), F.col("o.id").alias("new_other"))
        state = state.join(made.select("id", F.col("at").alias("new_own")), "id", "left").join(found, "form", "left")
        nearer = F.col("new_at") < F.col("other_at")
        state = cut(state.select("form", "id", F.least("own_at", F.coalesce("new_own", F.lit(NEVER))).alias("own_at"), F.when(nearer, F.col("new_at")).otherwise(F.col("other_at")).alias("other_at"), F.when(nearer, F.col("new_other")).otherwise(F.col("other")).alias("other")))
        open_ = rows.where("not ready").select("seq", "s", "t")
    names = cut(leaders)
    done = done if done is not None else spark.createDataFrame([], "seq long, s_node string, t_node string")
    name = lambda c: names.select(F.col("id").alias(f"{c}_node"), F.col("name").alias(f"{'source' if c == 's' else 'target'}_name"))
    told = triples.join(done, "seq").join(name("s"), "s_node").join(name("t"), "t_node")
    told = told.withColumnsRenamed({"s_node": "source_id", "t_node": "target_id"}).withColumn("relation", relation_name(F.col("relation")))
    return told, _nodes(names, told, known)


def _seen(place, at):
    """Whether a node of that place is there when the triple of ``at`` is told."""
    return F.shiftright(place, 1) < F.shiftright(at, 1)


def _before(place: str, at: str):
    return _seen(F.col(place), F.col(at))


def _nodes(names: DataFrame, told: DataFrame, known: DataFrame | None) -> DataFrame:
    """(node, name, at, aliases): an alias list is the name and every form told of the node, in their order."""
    side = lambda c, n: told.select(F.col(f"{c}_id").alias("id"), F.col(c).alias("alias"), (F.col("seq").cast("long") * 2 + n).alias("at"))
    seen = side("source", 0).unionByName(side("target", 1)).unionByName(names.select("id", F.col("name").alias("alias"), (F.col("at")).alias("at")))
    if known is not None:
        seen = seen.unionByName(known.select(F.col("node").alias("id"), F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("k", "alias")).select("id", "alias", (F.lit(FIRST) + F.col("k")).cast("long").alias("at")))
    once = seen.where("alias is not null").groupBy("id", "alias").agg(F.min("at").alias("at"))
    lists = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return names.join(lists, "id").select(F.col("id").alias("node"), "name", "at", "aliases")
