"""The registry in rounds against telling the triples one after another."""

import random
import re

from tidemark.operators import registry

TITLES = "mr mrs ms miss dr prof professor advisor lead director dept department".split()
SMALL = "the a an and or of in for with at by from to on".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def cleaned(raw):
    text = re.sub(r"\[.*?\]", "", raw or "")
    return re.sub(r"\s+", " ", re.sub(r"^[\s\"'(,.:;-]+|[\s\"'),.:;-]+$", "", text))


def own_id(clean):
    parts = clean.split()
    if len(parts) > 1 and parts[0].lower().rstrip(".:,") in TITLES:
        parts = parts[1:]
    x = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"[\s\-_/\\|:,.]+", "_", " ".join(parts).strip(".,"))).strip("_").upper()
    return f"ENTITY_VAL_{x}" if x.isdigit() else f"ENTITY_{x or 'UNKNOWN'}"


def told(mention, nodes):
    clean = cleaned(mention)
    if not clean:
        return "ENTITY_UNKNOWN", None
    if own_id(clean) in nodes:
        return own_id(clean), None
    low = clean.lower()
    split = lambda x: set(x.lower().split()) - set(TITLES) - set(SMALL)
    for node, (name, aliases) in nodes.items():
        if low == name.lower() or low in [a.lower() for a in aliases]:
            return node, None
        a, b = low.strip(), name.lower().strip()
        if min(len(clean), len(name)) >= 4 and (a == b or a and b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.88):
            return node, None
        if split(clean) and split(clean) == split(name):
            return node, None
    return own_id(clean), clean


def sequential(triples, nodes=None):
    nodes, out = dict(nodes or {}), {}
    for seq, source, _, target in sorted(triples):
        (s, s_name), (t, t_name) = told(source, nodes), told(target, nodes)
        if s == t or "ENTITY_UNKNOWN" in (s, t):
            continue
        for node, name, raw in ((s, s_name, source), (t, t_name, target)):
            if node not in nodes:
                nodes[node] = (name, [])
            if raw not in nodes[node][1]:
                nodes[node][1].append(raw)
        out[seq] = (s, t)
    return out, nodes


def mentions(rng):
    """Chains of likeness: each name is one letter from the one before it and two from the next but one."""
    chains = []
    for _ in range(25):
        name = list("".join(rng.choices("abcdefgh", k=9)).title() + " " + "".join(rng.choices("mnopqrst", k=8)).title())
        for _ in range(9):
            chains.append("".join(name))
            name[rng.choice([i for i, x in enumerate(name) if x != " "])] = rng.choice("uvwxyz")
    return chains


TRIPLES = "seq long, source string, relation string, target string"


def test_rounds_equal_the_sequence(spark):
    rng = random.Random(7)
    names = mentions(rng)
    odd = [None, "", " .", "[x]", "Dr. " + names[0], names[1].upper(), names[2].replace(" ", "-"), " ".join(reversed(names[3].split())), "the " + names[4], "12", "Ab", "ab", "abc", "A b"]

    def mention():
        x = rng.choice(names) if rng.random() < 0.9 else rng.choice(odd)
        return x if x is None or rng.random() < 0.8 else rng.choice([x.lower(), f" {x},", f"{x} [3]", x.replace(" ", "_")])

    rows = [(i * 3, mention(), "is-part of", mention()) for i in range(1000)]
    rows += [(3001 + i, rows[i][1], "AGAIN", rows[i][1]) for i in range(5)]
    log = []
    out, nodes = registry.registered(spark.createDataFrame(rng.sample(rows, len(rows)), TRIPLES).repartition(3), log=log)
    expected, kept = sequential(rows)
    assert {r.seq: (r.source_id, r.target_id) for r in out.collect()} == expected
    assert {r.node: r.name for r in nodes.collect()} == {k: v[0] for k, v in kept.items()}
    assert {r.node: sorted(set(r.aliases) - {r.name}) for r in nodes.collect()} == {k: sorted(set(v[1]) - {v[0], None}) for k, v in kept.items()}
    assert sum(d for _, _, d in log) == len(rows) and len(log) < 40, log


def test_nodes_that_were_there(spark):
    known = {"ENTITY_ONE": ("Amber Lantern", ["The Lamp"]), "ENTITY_TWO": ("Amber Lanterns", []), "ENTITY_X": ("Xylophone", ["x phone"])}
    rows = [(1, "amber lantern", "r", "the lamp"), (2, "Amber Lanterms", "r", "X PHONE"), (3, "New Thing", "r", "Xylophones"), (4, "New Things", "r", "Lantern Amber"), (5, "ONE", "r", "new thing")]
    table = spark.createDataFrame([(k, n, a, i) for i, (k, (n, a)) in enumerate(known.items())], "node string, name string, aliases array<string>, at long")
    out, nodes = registry.registered(spark.createDataFrame(rows, TRIPLES), table)
    expected, kept = sequential(rows, known)
    assert {r.seq: (r.source_id, r.target_id) for r in out.collect()} == expected and {r.node: r.name for r in nodes.collect()} == {k: v[0] for k, v in kept.items()}
    none = spark.createDataFrame([], TRIPLES)
    assert registry.registered(none)[0].count() == 0 and registry.registered(none)[1].count() == 0
