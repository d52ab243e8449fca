"""Sentences to relation triples, cleaning of entity names, and edge attributes: column expressions throughout.

Triples: (chunk_id, source, relation, target, source_type, target_type, evidence, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Words that are no entities.
STOP_ENTITIES = (
    "this,that,these,those,it,they,them,he,she,we,you,i,me,my,there,here,what,which,who,whom,whose,why,how,all,any,each,"
    "every,some,none,one,two,other,another,such,same,different,various,several,many,much,more,most,few,the,a,an,system,"
    "program,method,process,approach,right,fact,summary,image,content,audio,video,transcript,document,page,file,something,"
    "anything,everything,nothing,someone,anyone,who you ask,it totally,explicitly,explicitly — it,connecting someone who,"
    "connecting someone,and,but,also,above,below,then,so,thus,therefore,however,furthermore,meanwhile,instead,this course,"
    "the course,course,courses,topic,curriculum,syllabus,student,students,subject,unit,section,chapter,implement,criticize,"
    "evaluate,meet,meet specified,it also,understand,provide,equip,learning,study,studies,objective,objectives,outcome,"
    "outcomes,understanding,knowledge,skill,skills,way,ways,thing,things,part,parts,someone who"
).split(",")
LEADS = "to for in with which and by from that of at on who".split()
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# Verbs between two names, the relation they state, and the types of its ends.
VERBS = (
    (r"is(?: the)? (?:lead |senior |principal )?(?:software |systems? )?engineer at|works at|employed by", "EMPLOYED_AT", "PERSON", "ORGANIZATION"),
    (r"depends on|relies on|built upon", "DEPENDS_ON", "TECH", "TECH"),
    (r"requires|needs|mandates", "REQUIRES", "CONCEPT", "CONCEPT"),
    (r"uses|integrates with|connects to", "INTEGRATES_WITH", "TECH", "TECH"),
    (r"authored by|created by|designed by", "AUTHORED_BY", "CONCEPT", "PERSON"),
    (r"presented|introduced", "PRESENTED", "PERSON", "CONCEPT"),
)
NAME = r"([A-Z][a-zA-Z0-9_\-\s]{2,35})"
PATTERNS = tuple((rf"(?i)\b{NAME}\s+(?:{verbs})\s+{NAME}\b", *rest) for verbs, *rest in VERBS)
# Headers, contacts and course rows of a curriculum.
DEPARTMENT = r"(?:Department|School)\s+of\s+([A-Za-z\s&,]+?)(?:[\n_\r.]|\b)"
MINOR = r"Minor\s+in\s+([A-Za-z\s&,]+?)(?:[\n_\r.]|\b)"
ADVISOR = r"(?:UG\s+Advisor|Advisor|Faculty|Instructor|Professor|Lead):\s*([A-Za-z.\s]+?)(?:[\n\r.]|\b)"
EMAIL = r"\b([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+)\b"
COURSE = r"(?i)\b([A-Z]{2,4}\d{3})\b\s+(\d+)\s+([A-Z]{2,4}\d{3}|None|Nil|-)?\s+(Monsoon|Spring|Autumn|Winter|Summer|[1-8](?:st|nd|rd|th)\s+Semester)"
# Relations whose evidence may state an amount.
BUDGETS = "HAS_ALLOCATION HAS_TOTAL_BUDGET HAS_BUDGET ALLOCATED_FOR RESERVED_FOR COSTS HAS_COST BUDGETED_AT".split()
MONEY = r"(?i)(\$|USD|EUR|GBP)?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{4,}(?:\.\d+)?)\s*(USD|EUR|GBP|dollars?)?"
REGION = r"(?i)\b(top-left|top-right|bottom-left|bottom-right|header|footer|center|sidebar|diagram-box-[A-Z0-9]+)\b"
# What is cut from the ends of names, tags inside them, articles before and joining words behind, amounts and frames that
# are names as they stand, and the bounds of a name in characters and words.
_EDGES = r"""^[\s"'‘“(\[{,.:;–—-]+|[\s"'’”)\]},.:;–—-]+$"""
TAGS = r"\[(?:Page\s*\d+|\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2})?)\]"
ARTICLES = r"(?i)^(?:The|A|An|And|Well|So|Here|There|But|Also)\s+"
LOOSE_END = r"(?i)\s+(?:and|or|of|to|in|for|with|by|from|the|a|an)$"
MONEY_NAME = r"(?i)^\$?\d+(?:,\d+)*(?:\.\d+)?(?:\s*(?:USD|EUR|GBP|USD\$|K|M|B))?$"
FRAME_NAME = r"(?i)^(?:Video_Frame_|Keyframe_|Frame_)\d+:\d+"
NAME_LENGTHS, NAME_WORDS = (2, 65), 7
# Names and sentences of the triples of a curriculum.
DEPARTMENT_NAME, MINOR_NAME, CURRICULUM, ADVISOR_ROLE, CREDITS = "Department of ", "Minor in ", "University Curriculum", "UG Academic Advisor", " Credits"
SAID = {
    "offered": ("", " is offered by ", "."), "programs": ("", " offers academic programs."), "advises": ("", " serves as UG Advisor."), "advisor": ("Department has advisor ", "."), "email": ("Contact email for ", " is ", "."),
    "credits": ("Course ", " carries ", "."), "term": ("Course ", " is scheduled in ", "."), "before": ("", " requires prerequisite ", "."), "part": ("Course ", " is part of ", "."),
}
_TRIPLE = "struct<source:string,relation:string,target:string,source_type:string,target_type:string,evidence:string>"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def clean_mention(text: Column) -> Column:
    """A surface form without bracketed parts and outer punctuation, its blanks single."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[.*?\]", "")
    return F.regexp_replace(F.regexp_replace(bare, _EDGES, ""), r"\s+", " ")


def clean_name(raw: Column) -> Column:
    """An entity name, or null where the text cannot be one: too short or long, a stop word, a loose preposition."""
    return T.let(F.btrim(raw, F.lit(" \n\t\r")), lambda text: T.let(_bare_name(text), lambda x: _named(text, x)))


def _bare_name(text: Column) -> Column:
    """A name without tags, marks at its ends, an article before it and a joining word behind it."""
    x = F.regexp_replace(text, TAGS, "")
    x = F.regexp_replace(x, _EDGES, "")
    x = F.btrim(F.regexp_replace(x, ARTICLES, ""), F.lit(" \n\t\r"))
    return F.btrim(F.regexp_replace(x, LOOSE_END, ""), F.lit(" \n\t\r"))


def _named(text: Column, x: Column) -> Column:
    """The end of :func:`clean_name`, from the trimmed text and the bare name."""
    low, words = F.lower(x), F.size(F.split(x, r"\s+"))
    bad = ~F.length(x).between(*NAME_LENGTHS) | (words > NAME_WORDS) | low.isin(STOP_ENTITIES) | low.rlike(f"^(?:{'|'.join(LEADS)}) ")
    month = x.rlike(rf"(?i)^(?:{MONTHS})\s+\d{{4}}$")
    money = x.rlike(MONEY_NAME)
    plain = ~x.rlike(r"\p{Lu}") & (x.rlike(r"\p{Ll}") | (words > 1))
    frame = text.rlike(FRAME_NAME)
    return F.when(frame, text).when(bad, F.lit(None)).when(month, title_case(x)).when(money, x).when(plain, title_case(x)).otherwise(x)


def relation_name(raw: Column) -> Column:
    """UPPER_SNAKE_CASE."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.btrim(raw), r"[\s-]+", "_")), r"[^\p{L}\p{N}_]", "")


def _triple(source, relation, target, source_type, target_type, evidence) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    parts = {"source": source, "relation": relation, "target": target, "source_type": source_type, "target_type": target_type, "evidence": evidence}
    return F.struct(*[lit(v).alias(k) for k, v in parts.items()]).cast(_TRIPLE)


def _dealt(chunks: DataFrame) -> DataFrame:
    """The chunks over all tasks by their id, as a small file is read by one; the triples are told apart where they are found."""
    return chunks.select("chunk_id", "text").repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """The rows with the values, each computed once a row: filters on them are not moved below the generator with a copy of the expressions."""
    kept = [c for c in rows.columns if c not in values]
    one = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once")
    return rows.select(*kept, one).select(*kept, "_once.*")


def _kept(rows: DataFrame, order: list[str]) -> DataFrame:
    """Cleaned triples, the first of each (chunk, source, relation, target) without regard to case."""
    rows = _once(rows, source=clean_name(F.col("source")), target=clean_name(F.col("target")))
    rows = rows.where("source is not null and target is not null and lower(source) <> lower(target)")
    keys = [F.col("chunk_id"), F.lower("source").alias("_s"), F.col("relation"), F.lower("target").alias("_t")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("source", "target", "source_type", "target_type", F.left("evidence", F.lit(220)).alias("evidence")), F.struct(*order)).alias("e"))
    return first.select("chunk_id", "e.source", "relation", "e.target", "e.source_type", "e.target_type", "e.evidence", F.lit(0.88).alias("confidence"))


def sentence_triples(chunks: DataFrame) -> DataFrame:
    """Triples of the verb patterns in sentences of 15 characters or more of (chunk_id, text)."""
    parts = F.transform(F.split("text", r"[.\n;]+"), lambda s: F.btrim(s, F.lit(" \n\t\r")))
    s = _dealt(chunks).select("chunk_id", F.posexplode(parts).alias("sentence_no", "s")).where(F.length("s") >= 15)

    def hits(no: int, pattern: str, relation: str, source_type: str, target_type: str) -> Column:
        # a match holds one of the verbs between blanks, which is found in one pass
        held = F.col("s").rlike(rf"(?i)\s(?:{VERBS[no][0]})\s")
        group = lambda n: F.when(held, F.regexp_extract_all("s", F.lit(pattern), F.lit(n))).otherwise(F.array().cast("array<string>"))
        ends = F.zip_with(group(1), group(2), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.transform(ends, lambda e, i: F.struct(F.lit(no).alias("pattern_no"), i.alias("hit_no"), _triple(e["x"], relation, e["y"], source_type, target_type, F.col("s")).alias("t")))

    rows = s.select("chunk_id", "sentence_no", F.explode(F.flatten(F.array(*[hits(n, *p) for n, p in enumerate(PATTERNS)]))).alias("h"))
    return _kept(rows.select("chunk_id", "sentence_no", "h.pattern_no", "h.hit_no", "h.t.*"), ["sentence_no", "pattern_no", "hit_no"])


def curriculum_triples(chunks: DataFrame) -> DataFrame:
    """Triples of department and minor headers, advisors with e-mail addresses, and course rows."""
    every = lambda p, g=1: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    course = F.zip_with(F.zip_with(every(COURSE, 1), every(COURSE, 2), lambda a, b: F.struct(F.upper(a).alias("code"), b.alias("credits"))), F.zip_with(every(COURSE, 3), every(COURSE, 4), lambda a, b: F.struct(a.alias("before"), b.alias("term"))), lambda a, b: F.struct(a["code"].alias("code"), a["credits"].alias("credits"), b["before"].alias("before"), b["term"].alias("term")))
    rows = _once(_dealt(chunks.where("text is not null")), d=every(DEPARTMENT), m=every(MINOR), a=every(ADVISOR), e=F.slice(every(EMAIL), 1, 2), c=course).drop("text")
    rows = rows.where("size(d) + size(m) + size(c) > 0")
    dept, minor = F.concat(F.lit(DEPARTMENT_NAME), F.btrim(F.get("d", F.lit(0)))), F.concat(F.lit(MINOR_NAME), F.btrim(F.get("m", F.lit(0))))
    single = (F.size("d") == 1) & (F.size("m") == 1)

    def say(kind: str, *names: Column) -> Column:
        """A fixed sentence with the names in its gaps."""
        gaps = SAID[kind]
        return F.concat(F.lit(gaps[0]), *[x for name, text in zip(names, gaps[1:]) for x in (name, F.lit(text))])

    none = F.array().cast(f"array<{_TRIPLE}>")
    headers = F.when(single, F.array(
        _triple(minor, "OFFERED_BY", dept, "COURSE", "ORGANIZATION", say("offered", minor, dept)),
        _triple(dept, "PART_OF", CURRICULUM, "ORGANIZATION", "ORGANIZATION", say("programs", dept)))).otherwise(none)
    named = F.filter(F.transform("a", lambda x: F.btrim(x)), lambda x: (F.length(x) > 3) & ~F.lower(x).startswith("if "))
    advisors = F.flatten(F.transform(named, lambda x: F.concat(
        F.array(_triple(x, "ROLE_AS", ADVISOR_ROLE, "PERSON", "RULE", say("advises", x))),
        F.when(F.size("d") > 0, F.array(_triple(dept, "HAS_ADVISOR", x, "ORGANIZATION", "PERSON", say("advisor", x)))).otherwise(none),
        F.transform("e", lambda m: _triple(x, "HAS_EMAIL", m, "PERSON", "RULE", say("email", x, m))))))
    owner = F.when(F.size("m") > 0, minor).otherwise(dept)

    def of_course(c: Column) -> Column:
        credits, term, before = F.concat(c["credits"], F.lit(CREDITS)), title_case(F.btrim(c["term"])), F.upper(c["before"])
        return F.concat(
            F.array(_triple(c["code"], "AWARDS_CREDITS", credits, "COURSE", "METRIC", say("credits", c["code"], credits)),
                    _triple(c["code"], "OFFERED_IN", term, "COURSE", "SEMESTER", say("term", c["code"], term))),
            F.when(before.rlike(r"^[A-Z]{2,4}\d{3}$"), F.array(_triple(c["code"], "REQUIRES_PREREQUISITE", before, "COURSE", "COURSE", say("before", c["code"], before)))).otherwise(none),
            F.when(F.size("m") + F.size("d") > 0, F.array(_triple(c["code"], "PART_OF", owner, "COURSE", "ORGANIZATION", say("part", c["code"], owner)))).otherwise(none))

    courses = F.flatten(F.transform("c", of_course))
    out = rows.select("chunk_id", F.posexplode(F.concat(headers, advisors, courses)).alias("no", "t"))
    return _kept(out.select("chunk_id", "no", "t.*"), ["no"])


def template_triples(chunks: DataFrame, templates: DataFrame) -> DataFrame:
    """Fixed triples of each chunk whose text holds a template's trigger.

    templates: (trigger, source, relation, target, source_type, target_type); a trigger is a lower-case word or phrase. The
    words of a chunk meet its first word in an equi-join, so the table may be of any size; the phrase is then looked for.
    """
    low = chunks.select("chunk_id", F.lower("text").alias("low"))
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    first = templates.withColumn("_first", F.get(words(F.col("trigger")), F.lit(0)))
    # single words meet by the word alone; only phrases need the text
    single = F.col("trigger") == F.col("_first")
    held = low.select("chunk_id", F.explode(F.array_distinct(words(F.col("low")))).alias("_first"))
    phrased = held.join(first.where(~single), "_first").join(low, "chunk_id").where(F.contains("low", F.col("trigger"))).drop("low")
    found = held.join(first.where(single), "_first").unionByName(phrased)
    return _kept(found.withColumn("evidence", F.concat_ws(" ", "source", "relation", "target")), ["source", "target"])


# A sentence of captions that says nothing, the least text to extract from, and the confidence of edges.
CAPTION_OPENING = r"(?i)Here is a (?:detailed, )?factual summary of the image content:?"
LEAST_TEXT, EDGE_CONFIDENCE = 20, 0.92
FRAMES = r"^ENTITY_(?:VIDEO_FRAME_|KEYFRAME_|FRAME_)"


def triples_of(chunks: DataFrame, templates: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """The triples of (chunk_id, text): those of a model (``told``, in the same form) where a chunk has any, else those of
    the sentence, curriculum and template rules, each (source, relation, target) of a chunk once. Texts of under 20
    characters have none."""
    usable = chunks.where(F.length(F.btrim("text", F.lit(" \n\t\r"))) >= LEAST_TEXT).withColumn("text", F.regexp_replace("text", CAPTION_OPENING, ""))
    open_ = usable if told is None else usable.join(told.select("chunk_id").distinct(), "chunk_id", "left_anti")
    ruled = sentence_triples(open_).withColumn("_rule", F.lit(1)).unionByName(curriculum_triples(open_).withColumn("_rule", F.lit(2)))
    if templates is not None:
        ruled = ruled.unionByName(template_triples(open_, templates).withColumn("_rule", F.lit(3)))
    keys = [F.col("chunk_id"), F.lower("source").alias("_s"), F.upper("relation").alias("_r"), F.lower("target").alias("_t")]
    rest = [c for c in ruled.columns if c not in ("chunk_id", "_rule")]
    once = ruled.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_rule", "source", "target")).alias("t")).select("chunk_id", "t.*")
    return once if told is None else once.unionByName(told.join(usable.select("chunk_id"), "chunk_id", "left_semi").select(once.columns))


def edges_of(triples: DataFrame) -> DataFrame:
    """Edges of resolved triples (source_id, source_name, target_id, target_name, relation, evidence, and of their chunk file_id,
    filename, chunk_id, page_number, timestamp): stamps, frame, region, amount and currency from the evidence."""
    said = F.btrim(F.coalesce("evidence", F.lit("")))
    stamp = stamp_of(said, F.col("timestamp"))
    span = F.split(stamp, " - ")
    frame = F.when(F.col("source_id").rlike(FRAMES), F.col("source_name")).when(F.col("target_id").rlike(FRAMES), F.col("target_name"))
    relation = checked_relation(F.col("relation"), said)
    money = F.concat_ws(" ", said, "target_name", "source_name")
    return triples.select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), relation.alias("relation"),
        F.coalesce(F.nullif(said, F.lit("")), F.concat_ws(" ", "source_name", relation, "target_name")).alias("evidence"),
        "file_id", "filename", "chunk_id", "page_number", stamp.alias("timestamp"), F.btrim(F.get(span, F.lit(0))).alias("start_timestamp"), F.btrim(F.get(span, F.lit(1))).alias("end_timestamp"),
        frame.alias("frame_id"), region_of(said).alias("spatial_location"), amount_of(relation, money).alias("amount"), currency_of(relation, money).alias("currency"), F.lit(EDGE_CONFIDENCE).alias("confidence"),
    )


def stamp_of(evidence: Column, fallback: Column | None = None) -> Column:
    """The first MM:SS or MM:SS - MM:SS of the evidence, else the fallback."""
    own = found(evidence, r"\[?(\d{1,2}:\d{2}(?:\s*-\s*\d{1,2}:\d{2})?)\]?")
    return own if fallback is None else F.coalesce(own, fallback)


def region_of(evidence: Column) -> Column:
    return F.lower(found(evidence, REGION))


def checked_relation(relation: Column, evidence: Column) -> Column:
    """OFFERED_BY becomes OPEN_TO_STUDENTS_OF where the evidence tells of eligibility."""
    return F.when((relation == "OFFERED_BY") & F.lower(evidence).rlike("eligible|matrix|table|open to|allowed"), "OPEN_TO_STUDENTS_OF").otherwise(relation)


def amount_of(relation: Column, text: Column) -> Column:
    """The amount of a budget relation's evidence: the first number with thousands groups or four digits, if 100 or more."""
    value = F.replace(found(text, MONEY, 2), F.lit(",")).cast("double")
    return F.when(relation.isin(BUDGETS) & (value >= 100), value)


def currency_of(relation: Column, text: Column) -> Column:
    """USD unless another currency stands before or behind the amount; null without amount."""
    before, after = F.upper(F.regexp_extract(text, MONEY, 1)), F.upper(F.regexp_extract(text, MONEY, 3))
    dollars = before.contains("$") | after.contains("USD") | after.contains("DOLLAR")
    named = F.when(dollars, "USD").otherwise(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")), F.lit("USD")))
    return F.when(amount_of(relation, text).isNotNull(), named)
