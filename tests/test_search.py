"""Graph searches against a plain queue and plain breadth-first paths, on graphs with hubs."""

import random
from collections import defaultdict, deque

import pytest

from tidemark.operators import graph

EDGES = "seq long, source string, relation string, target string, file_id string, filename string"


def made(seed, nodes=40, edges=160):
    rng = random.Random(seed)
    end = lambda: "hub" if rng.random() < 0.25 else f"n{rng.randrange(nodes)}"
    seqs = rng.sample(range(10_000), edges)
    return [(s, end(), rng.choice("RST"), end(), f"f{s % 3}", f"F{s % 3}.txt") for s in seqs]


def walked(rows, seeds, depth, most, filename=None):
    """The hops of a queue: outgoing edges by neighbour, then incoming ones."""
    out, into = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
    for r in sorted(rows):
        out[r[1]][r[3]].append(r)
        into[r[3]][r[1]].append(r)
    seen, queue, hops, told = set(seeds), deque((s, 0) for s in dict.fromkeys(seeds)), [], set()
    while queue and len(hops) < most:
        node, level = queue.popleft()
        if level >= depth:
            continue
        for side, incoming in ((out, False), (into, True)):
            for other, own in side[node].items():
                if incoming and other == node:
                    continue
                for r in own:
                    if r[0] not in told:
                        told.add(r[0])
                        hops.append(r)
                if other not in seen and level + 1 < depth:
                    seen.add(other)
                    queue.append((other, level + 1))
    if filename:
        hops = [h for h in hops if h[5].lower() == filename.lower()] + [h for h in hops if h[5].lower() != filename.lower()]
    return [h[0] for h in hops[:most]]


@pytest.mark.parametrize("depth, most, filename", [(1, 9, None), (3, 25, None), (3, 70, "f1.TXT"), (4, 500, None), (2, 30, "f0.txt")])
def test_walk_equals_a_queue(spark, depth, most, filename):
    rows = made(depth * most)
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    for seeds in (["n1", "hub", "n1"], ["n2", "n3"], ["nobody"]):
        got = graph.searched(df, seeds, depth, most, filename).orderBy("hop_no").collect()
        assert [r.seq for r in got] == walked(rows, seeds, depth, most, filename) and [r.hop_no for r in got] == list(range(1, len(got) + 1))


def least_path(rows, a, b):
    near = defaultdict(set)
    for _, s, _, t, _, _ in rows:
        near[s].add(t)
        near[t].add(s)
    level, seen = {a: [a]}, {a}
    while level and b not in level:
        step = {}
        for node, path in level.items():
            for other in near[node] - seen:
                step[other] = min(step.get(other, ["~"]), path + [other])
        seen |= set(step)
        level = step
    return level.get(b)


def test_paths_from_both_ends(spark):
    rows = [r for r in made(5, nodes=60, edges=90) if "hub" not in (r[1], r[3])]
    rows += [(20_000 + i, f"c{i}", "R", f"c{i + 1}", "", "") for i in range(7)] + [(30_000 + i, "hub", "R", f"h{i}", "", "") for i in range(300)] + [(40_000, "c7", "R", "h0", "", "")]
    df = spark.createDataFrame(rows, EDGES)
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(5)] + [("c0", "h7"), ("h9", "c3"), ("n1", "nobody"), ("n1", "n1")]
    for a, b in pairs:
        found, path = graph.shortest_paths(df, a, b).collect(), least_path(rows, a, b) if a != b else [a]
        assert [(r.path, r.length) for r in found] == ([(path, len(path) - 1)] if path else [])
    log = []
    graph.shortest_paths(df, "h9", "c3", log).collect()
    assert sum(n for _, n in log) < 20  # the hub's three hundred neighbours are never walked
