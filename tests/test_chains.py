"""Chains of skeleton graphs and the longest paths on them, against graphs held whole."""

import time

import numpy as np
import pytest

from stratavox.operators import chains, skeletons

from .small_graphs import Graph, prune

EDGES = "obj long, u long, v long, w double"


def edges_frame(spark, graphs):
    return spark.createDataFrame([(o, int(min(a, b)), int(max(a, b)), float(w)) for o, g in graphs.items() for a, b, w in g], EDGES).repartition(3)


def with_chains(r, keys, extra, most):
    """A random graph: a tree over keys and more edges, each a chain of new nodes."""
    pairs = [(k, int(r.integers(k))) for k in range(1, keys)] + [tuple(map(int, r.choice(keys, 2, replace=False))) for _ in range(extra)]
    edges, new, names = [], keys, r.permutation(10000)
    for a, b in pairs:
        way = [a, *range(new, new + int(r.integers(1, most))), b]
        new += len(way) - 2
        edges += [(p, q, float(r.choice([1.0, 2**0.5, 3**0.5]))) for p, q in zip(way, way[1:])]
    return [(int(names[a]), int(names[b]), w) for a, b, w in edges]


def graphs():
    r = np.random.default_rng(4)
    out = {i: with_chains(r, int(r.integers(2, 9)), int(r.integers(0, 4)), 6) for i in range(40)}
    out[100] = [(k, (k + 1) % 17, 1.0) for k in range(17)]  # a ring
    out[101] = [(k, k + 1, 1.0) for k in range(30)]  # a line
    out[102] = [*((k, (k + 1) % 10, 1.0) for k in range(10)), *((k, 20 if k == 29 else k + 1, 1.0) for k in range(20, 30)), (0, 40, 1.0), (40, 20, 1.0)]  # two rings and a bridge
    out[103] = [*((k, k + 1, 1.0) for k in range(10)), (8, 11, 1.0), *((k, k + 1, 1.0) for k in range(11, 14))]  # a line with a branch
    out[104] = [(0, 1, 1.0)]
    out[105] = [*((k, (k + 1) % 12, 1.0) for k in range(12)), (3, 50, 1.0), (50, 51, 1.0), *((k, (k + 1) if k < 69 else 60, 1.0) for k in range(60, 70))]  # a ring with a branch, and another part of the object
    return out


@pytest.fixture(scope="module")
def known():
    return graphs()


def arrays(g):
    u, v, w = (np.array(c) for c in zip(*g))
    return np.unique(np.r_[u, v]), u, v, w


def test_contraction(spark, known):
    rows, inner = (t.collect() for t in chains.contract(edges_frame(spark, known)))
    for o, g in known.items():
        nodes, u, v, w = arrays(g)
        degree = {n: int((u == n).sum() + (v == n).sum()) for n in nodes.tolist()}
        own, within = [r for r in rows if r.obj == o], [r for r in inner if r.obj == o]
        keys = {r.k1 for r in own} | {r.k2 for r in own}
        assert {n for n, d in degree.items() if d != 2} <= keys and not keys & {r.node for r in within} and keys | {r.node for r in within} == set(degree)
        assert sum(r.length for r in own) == pytest.approx(w.sum())
        length = {(a, b): x for a, b, x in g} | {(b, a): x for a, b, x in g}
        for r in own:
            way = [r.k1, *(n.node for n in sorted((q for q in within if (q.k1, q.x1) == (r.k1, r.x1)), key=lambda q: q.offset)), r.k2]
            assert way[1] == r.x1 and way[-2] == r.x2 and sum(length[p] for p in zip(way, way[1:])) == pytest.approx(r.length)


@pytest.mark.parametrize("least", [0.0, 2.5, 4.0])
def test_paths_equal_whole_graphs(spark, known, least):
    vertices = [(o, int(n), float(1 + n % 3)) for o, g in known.items() for n in arrays(g)[0]] + [(200, 7, 2.0), (200, 9, 4.0)]
    found = skeletons.length_and_thickness(spark.createDataFrame(vertices, "obj long, node long, radius double"), edges_frame(spark, known), 4.0, least).collect()
    assert len(found) == len(known) + 1
    for r in found:
        if r.obj == 200:
            assert (r.length_nm, r.path, r.pruned, r.radius_mean_nm) == (0.0, [7], [7, 9], 8.0)
            continue
        nodes, u, v, w = prune(*arrays(known[r.obj]), least)
        graph = Graph(nodes, u, v, w)
        start, end, length = graph.longest()
        assert r.pruned == graph.nodes.tolist(), r.obj
        assert r.length_nm == pytest.approx(4 * length) and (r.path[0], r.path[-1]) in ((nodes[start], nodes[end]), (nodes[end], nodes[start]))
        step = {(a, b): x for a, b, x in zip(u.tolist(), v.tolist(), w.tolist())}
        assert sum(step.get(p, step.get(p[::-1])) for p in zip(r.path, r.path[1:])) == pytest.approx(length) and len(set(r.path)) == len(r.path)
        assert r.radius_mean_nm == pytest.approx(4 * np.mean([1 + n % 3 for n in r.path]))


def test_a_large_ring_with_a_tail(spark):
    """A ring of 100,000 nodes and a tail: its answer is closed, and the object's task is quick."""
    n, tail = 100_000, 1000
    edges = [(1, k, k + 1, 1.0) for k in range(n - 1)] + [(1, 0, n - 1, 1.0)] + [(1, 50, n, 1.0)] + [(1, k, k + 1, 1.0) for k in range(n, n + tail - 1)]
    rows, inner = chains.contract(spark.createDataFrame(edges, EDGES))
    began = time.time()
    solved = chains.solve(rows, inner, 0.0)
    assert solved.first().length == n / 2 + tail and rows.count() == 2
    assert time.time() - began < 10
    way = chains.nodes_of(solved, "way", inner)
    assert way.count() == n / 2 + tail + 1


def test_searches_are_few():
    """A ladder of loops: bounds leave far fewer searches than nodes."""
    parts = {}
    for k in range(300):
        for side in (0, 1):
            places = np.arange(1.0, 20 + side)
            parts[2 * k + side] = chains.Chain(1000 * k, 1000 * (k + 1), 20.0 + side, places, 1000 * k + 100 * (side + 1) + np.arange(len(places)), [("chain", 1000 * k, side, 20.0 + side, False)])
    graph = chains.Chains(parts)
    searches, plain = [], graph.distances
    graph.distances = lambda s: searches.append(1) or plain(s)
    assert graph.longest()[0] == 300 * 20.0 and len(searches) < 60
