"""Triple extraction, names, resolution, ports and Word files on small fixtures."""

import random
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import extract, ports, resolve, synthesis
from tidemark.sources.docx import docx_files


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(7)
    names = {"".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(150)}
    names |= {n[:3] + rng.choice("abc") + n[4:] + rng.choice(["", "b", "ab"]) for n in list(names)} | {"", " "}
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    for least in (0.75, 0.88):
        got = {(r.mention, r.name) for r in resolve.similar_names(rows.withColumnRenamed("name", "mention"), rows, least).collect()}
        want = {(a, b) for a in names for b in names if a.strip() and b.strip() and 1 - distance(a, b) / max(len(a), len(b)) >= least}
        assert got == want


def test_clean_names(spark):
    texts = ["the Gateway of", "[00:12 - 00:20] (Project Alpha),", "it", "to the river", "march 2024", "$4,000 USD", "alice smith", "x" * 66, "Frame_00:15", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in rows.orderBy("i").select(extract.clean_name(F.col("t")).alias("c")).collect()]
    assert got == ["Gateway", "Project Alpha", None, None, "March 2024", "$4,000 USD", "Alice Smith", None, "Frame_00:15", None]


def test_sentence_triples(spark):
    text = "Alice works at Acme Labs. Orion requires Postgres; Orion requires Postgres.\nThis uses it. Tiny."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "chunk_id long, text string")
    got = {(r.source, r.relation, r.target, r.source_type) for r in extract.sentence_triples(rows).collect()}
    assert got == {("Alice", "EMPLOYED_AT", "Acme Labs", "PERSON"), ("Orion", "REQUIRES", "Postgres", "CONCEPT")}


def test_amounts(spark):
    f = lambda t, r="HAS_BUDGET": (extract.amount_of(F.lit(r), F.lit(t)), extract.currency_of(F.lit(r), F.lit(t)))
    a, b, c = f("paid $30,000 today"), f("5000 dollars"), f("costs 70,000 eur")
    r = one(spark, a=a[0], a2=a[1], b=b[0], b2=b[1], c=c[0], c2=c[1], d=f("9,000", "USES")[0], e=f("only 12")[1])
    assert tuple(r) == (30000.0, "USD", 5000.0, "USD", 70000.0, "EUR", None, None)


def test_lookup_tiers(spark):
    known = spark.createDataFrame([("ENTITY_MINOR_IN_DANCE", "Minor in Dance", ["Dance Minor"], 1), ("ENTITY_CS", "Computer Science", None, 2), ("ENTITY_CIVIL", "Civil Engineering", ["Civil Engineering"], 3)], "node string, name string, aliases array<string>, at long")
    asked = ["ENTITY_CS", "dr. cs", "DANCE MINOR", "Computer Sciense", "cse", "dance", "civil works engineering", "program", " ", "engineering of stars"]
    got = {r.mention: (r.node, r.tier) for r in resolve.lookup(spark.createDataFrame([(a,) for a in asked], "mention string"), known).collect()}
    assert got == {"ENTITY_CS": ("ENTITY_CS", 1), "dr. cs": ("ENTITY_CS", 2), "DANCE MINOR": ("ENTITY_MINOR_IN_DANCE", 3), "Computer Sciense": ("ENTITY_CS", 4), "cse": ("ENTITY_CS", 5), "dance": ("ENTITY_MINOR_IN_DANCE", 6), "civil works engineering": ("ENTITY_CIVIL", 7)}


def test_nodes_and_roles(spark):
    rows = [(1, "a", "Alice", "PERSON", "HAS_ROLE", "r", "Engineer", "RULE", "f1"), (2, "a", "Al", "OTHER", "HAS_ROLE", "q", "Lead", "RULE", "f2"), (3, "a", "Alice", "PERSON", "KNOWS", "q", "Lead", "RULE", "")]
    edges = spark.createDataFrame(rows, "seq long, source string, source_name string, source_type string, relation string, target string, target_name string, target_type string, file_id string")
    a = resolve.nodes(edges).where("node = 'a'").first()
    assert (a.name, a.type, a.aliases, a.file_ids, a.role) == ("Alice", "PERSON", ["Alice", "Al"], ["f1", "f2"], "Lead")


def test_snippets_and_windows(spark):
    text = "[Page 1] alpha\n--- Page 2 ---\nbeta gamma\n[Page 3]"
    r = one(spark, a=T.page_text(F.lit(text), F.lit(2)), b=T.page_text(F.lit(text), F.lit(9)), c=T.snippet(F.lit("x" * 200 + "Word" + "y" * 300), F.lit("word")), d=T.snippet(F.lit("short"), F.lit("zz")))
    assert (r.a, r.b, r.d) == ("beta gamma", None, "short") and r.c == "..." + "x" * 100 + "Word" + "y" * 236 + "..."
    hit = spark.createDataFrame([("gateway port", "intro line\nnothing here\nmore text\nstill none\nthe gateway\nits port\nend of it")], "query string, text string")
    w = synthesis.windows(hit).first()
    assert (w.start, w.score) == (2, 2)


def test_ports(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert [r.o for r in ports.applied(rows, ["text"], "o", "string", None).collect()] == [None, None]
    got = ports.applied(rows, ["text"], "o", "string", lambda b: b["text"].str.upper())
    assert {r.id: r.o for r in got.collect()} == {1: "AB", 2: None}
    assert ports.expanded(rows, "id long, part string", None).count() == 0
    split = ports.expanded(rows, "id long, part string", lambda b: pd.DataFrame([(i, c) for i, t in zip(b["id"], b["text"]) if t for c in t], columns=["id", "part"]))
    assert {(r.id, r.part) for r in split.collect()} == {(1, "a"), (1, "b")}


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title')}{p('')}<w:tbl>{row('k', 'v')}{row('1', '2')}</w:tbl></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = {r.path[-6:]: (r.text, bool(r.error)) for r in docx_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Title\n\nk | v\n\n1 | 2", False), "b.docx": (None, True)}
