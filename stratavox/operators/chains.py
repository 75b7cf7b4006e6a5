"""Skeleton graphs contracted to chains, and the longest shortest path of each object on what is left.

Nodes with two neighbours are inner nodes of a chain between two keys: ends, branch points, or the least node of a ring. Spark contracts chains by pointer doubling over the two directions of each
edge, in as many rounds as the longest chain has binary digits. The task of an object gets its chains, not its nodes: one row a chain. Only chains on cycles
bring the places of their inner nodes, two numbers a node, since a longest path may end there; on other chains it can't, as one could go on to their end.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut, drop

#: Lengths within this are the same.
SAME = 1e-9
CHAIN = ["obj", "k1", "x1"]


# Contraction


def _doubled(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs whose way on has ended, arcs that go round in a ring), from arcs (obj, u, v, nu, nv, lu, lv, length, low, rep): the next arc, the last one so far, the length and the least node to there.

    In each round an arc goes on to where the arc ahead of it had got. If in a round none ended and no least node changed, all that are left go round.
    """
    ended, active = None, cut(first)
    while True:
        done, more = active.where("nu is null"), active.where("nu is not null")
        ended = done if ended is None else ended.unionByName(done)
        if more.isEmpty():
            return ended, more
        a, b = more.alias("a"), more.unionByName(ended).alias("b")
        on = (F.col("a.obj") == F.col("b.obj")) & (F.col("a.nu") == F.col("b.u")) & (F.col("a.nv") == F.col("b.v"))
        ahead = a.join(b, on).select("a.obj", "a.u", "a.v", *(f"b.{c}" for c in ("nu", "nv", "lu", "lv")), (F.col("a.length") + F.col("b.length")).alias("length"), F.least("a.low", "b.low").alias("low"), "a.rep", (F.col("b.low") < F.col("a.low")).alias("lower"))
        active = cut(ahead)
        if active.where("nu is null or lower").isEmpty():
            return ended, active.drop("lower")
        active = active.drop("lower")


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, inner nodes), cuts, of edges (obj, u, v, w), each once.

    chains: (obj, k1, x1, k2, x2, length) with the nodes next to both keys, (k1, x1) the lesser end and the chain's name. inner: (obj, k1, x1, offset, node).
    """
    arcs = cut(edges.select("obj", "u", "v", "w").unionByName(edges.select("obj", F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    inner = cut(arcs.groupBy("obj", "u").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).where("n = 2").select("obj", F.col("u").alias("v"), "a", "b"))
    ahead = F.when(F.col("a") == F.col("u"), F.col("b")).otherwise(F.col("a"))
    first = arcs.join(inner, ["obj", "v"], "left").select(
        "obj", "u", "v", F.when(F.col("a").isNotNull(), F.col("v")).alias("nu"), F.when(F.col("a").isNotNull(), ahead).alias("nv"),
        F.col("u").alias("lu"), F.col("v").alias("lv"), F.col("w").alias("length"), F.col("v").alias("low"), F.lit(None).cast("long").alias("rep"),
    )
    ended, rings = _doubled(first)
    if not rings.isEmpty():
        # the least node of a ring becomes its key, and its arcs go on to there
        own = first.drop("rep", "low").join(rings.select("obj", "u", "v", F.col("low").alias("rep")), ["obj", "u", "v"])
        stop = F.col("v") == F.col("rep")
        own = own.withColumns({"nu": F.when(~stop, F.col("nu")), "nv": F.when(~stop, F.col("nv")), "low": F.col("v")})
        ended = ended.unionByName(_doubled(own.select(first.columns))[0])
    ended = ended.join(inner.select("obj", F.col("v").alias("u"), F.lit(True).alias("within")), ["obj", "u"], "left").withColumn("within", F.col("within").isNotNull() & ~F.coalesce(F.col("u") == F.col("rep"), F.lit(False)))
    ended = cut(ended.select("obj", "u", "v", "lu", "lv", "length", "within"))
    least = F.struct(F.col("u").alias("k"), F.col("v").alias("x")) < F.struct(F.col("lv").alias("k"), F.col("lu").alias("x"))
    chains = ended.where(~F.col("within")).where(least).select("obj", F.col("u").alias("k1"), F.col("v").alias("x1"), F.col("lv").alias("k2"), F.col("lu").alias("x2"), "length")
    nearest = ended.where("within").groupBy("obj", F.col("u").alias("node")).agg(F.min(F.struct(F.col("lv").alias("k1"), F.col("lu").alias("x1"), F.col("length").alias("offset"))).alias("m"))
    out = cut(chains), cut(nearest.select("obj", "m.k1", "m.x1", "m.offset", "node"))
    for t in (arcs, inner, ended):
        drop(t)
    return out


# One object's chains


@dataclass
class Chain:
    """A chain from key a to key b: the places of its inner nodes, if known, and what it is made of: ("chain", k1, x1, length, reversed) and ("node", id) in order."""

    a: int
    b: int
    length: float
    places: np.ndarray
    nodes: np.ndarray
    parts: list[tuple]

    def turned(self) -> Chain:
        parts = [(*p[:4], not p[4]) if p[0] == "chain" else p for p in reversed(self.parts)]
        return Chain(self.b, self.a, self.length, self.length - self.places[::-1], self.nodes[::-1], parts)


class Chains:
    """The graph of an object's chains; a place is (key, None) or (chain number, index of an inner node)."""

    def __init__(self, chains: dict[int, Chain]):
        self.chains = chains
        self.at: dict[int, list[int]] = defaultdict(list)
        for i, c in chains.items():
            self.at[c.a].append(i)
            self.at[c.b].append(i)

    def core(self) -> set[int]:
        """The chains that are left when those with a loose end are taken away again and again: those on cycles, and between cycles."""
        left, degree = set(self.chains), {k: len(v) for k, v in self.at.items()}
        loose = [k for k, n in degree.items() if n == 1]
        while loose:
            k = loose.pop()
            for i in self.at[k]:
                if i in left:
                    left.discard(i)
                    for e in (self.chains[i].a, self.chains[i].b):
                        degree[e] -= 1
                        if degree[e] == 1:
                            loose.append(e)
        return left

    def distances(self, sources: dict[int, float]) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
        """Distances of keys from the nearest source, and the chain and key before each on that way."""
        d, before, heap = dict(sources), {}, [(x, k) for k, x in sources.items()]
        heapq.heapify(heap)
        while heap:
            far, k = heapq.heappop(heap)
            if far > d[k]:
                continue
            for i in self.at[k]:
                c = self.chains[i]
                to, new = c.b if c.a == k else c.a, far + c.length
                if new < d.get(to, np.inf) - SAME:
                    d[to], before[to] = new, (i, k)
                    heapq.heappush(heap, (new, to))
        return d, before

    # The longest shortest path. ``best`` is (length, ids of its ends with the greater first, their places).

    @staticmethod
    def _better(best, length: float, id_: int, place, other: int, other_place):
        ends = ((id_, other), (place, other_place)) if id_ >= other else ((other, id_), (other_place, place))
        if length > best[0] + SAME or (length > best[0] - SAME and ends[0] < best[1]):
            return (max(length, best[0]), *ends)
        return best

    def _peaks(self, i: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, inner node, distance): the inner nodes of a chain that are farthest from sources at distances u and v of its two ends, all on ties."""
        c = self.chains[i]
        top = np.searchsorted(c.places, (v + c.length - u) / 2)
        near = np.stack([np.clip(top + s, 0, len(c.places) - 1) for s in (-1, 0)], 1)
        far = np.minimum(u[:, None] + c.places[near], v[:, None] + c.length - c.places[near])
        row, col = np.nonzero(far >= far.max(1)[:, None] - SAME)
        return row, near[row, col], far[row, col]

    def longest(self) -> tuple[float, tuple[int, int], tuple]:
        """The longest shortest path between any two nodes: (length, (start, end) ids, their places), end <= start, the first pair in that order.

        Bounds of how far each key can reach leave few searches from keys, and bounds of pairs of chains few pairs of chains whose inner nodes are compared, each in one sorted search.
        """
        inner = [i for i, c in self.chains.items() if len(c.places)]
        best, most, left, high = (0.0, (-1, -1), (None, None)), dict.fromkeys(self.at, np.inf), set(self.at), True
        while left:
            k = (max if high else min)(left, key=lambda q: (most[q], -q))
            high = not high
            d, _ = self.distances({k: 0.0})
            far = max(d.values())
            for q, x in d.items():
                if x >= best[0] - SAME:
                    best = self._better(best, x, k, (k, None), q, (q, None))
            for i in inner:
                c = self.chains[i]
                if c.a in d:
                    bound = (d[c.a] + d[c.b] + c.length) / 2
                    far = max(far, bound)
                    if bound >= best[0] - SAME:
                        for _, n, x in zip(*self._peaks(i, np.array([d[c.a]]), np.array([d[c.b]])), strict=True):
                            best = self._better(best, float(x), k, (k, None), int(c.nodes[n]), (i, int(n)))
            for q, x in d.items():
                most[q] = min(most[q], x + far)
            left.discard(k)
            left = {q for q in left if most[q] >= best[0] - SAME}
        bound = lambda i: (most[self.chains[i].a] + most[self.chains[i].b] + self.chains[i].length) / 2
        order = sorted(inner, key=bound, reverse=True)
        for at, i in enumerate(order):
            if bound(i) < best[0] - SAME:
                break
            a = self.chains[i]
            (da, _), (db, _) = self.distances({a.a: 0.0}), self.distances({a.b: 0.0})
            s = a.places
            for j in order[at + 1 :]:
                b = self.chains[j]
                if b.a in da and bound(j) >= best[0] - SAME and min(da[b.a] + db[b.b], da[b.b] + db[b.a]) / 2 + (a.length + b.length) / 2 >= best[0] - SAME:
                    u, v = (np.minimum(s + da[e], a.length - s + db[e]) for e in (b.a, b.b))
                    best = self._best_of(best, i, j, *self._peaks(j, u, v))
            if (a.length + da[a.b]) / 2 >= best[0] - SAME:
                # on the chain itself: straight on, or round by both ends
                top = np.searchsorted(s, s + (a.length + da[a.b]) / 2)
                near = np.stack([np.clip(top + e, 0, len(s) - 1) for e in (-1, 0)], 1)
                gap = np.abs(s[near] - s[:, None])
                far = np.minimum(gap, a.length + da[a.b] - gap)
                row, col = np.nonzero(far >= best[0] - SAME)
                best = self._best_of(best, i, i, row, near[row, col], far[row, col])
        return best

    def _best_of(self, best, i: int, j: int, row: np.ndarray, n: np.ndarray, far: np.ndarray):
        if not len(far):
            return best
        top = np.flatnonzero(far >= far.max() - SAME)
        ids, others = self.chains[i].nodes[row[top]], self.chains[j].nodes[n[top]]
        first = np.lexsort((np.minimum(ids, others), np.maximum(ids, others)))[0]
        at = top[first]
        return self._better(best, float(far[at]), int(ids[first]), (i, int(row[at])), int(others[first]), (j, int(n[at])))

    def prune(self, least: float) -> tuple[list[tuple], list[int]]:
        """Takes away branches of at most ``least``, the shortest first, while the longest path is over three times that; (parts, end keys) that are gone.

        A branch is a chain from an end to a branch point. A branch point that keeps two ends of chains becomes an inner node.
        """
        parts, gone, best = [], [], None
        while True:
            loose = sorted((round(self.chains[v[0]].length, 9), k) for k, v in self.at.items() if len(v) == 1 and len(self.at[self._far(v[0], k)]) >= 3)
            if not loose or loose[0][0] > least:
                return parts, gone
            if best is None:
                best = self.longest()
            if best[0] <= 3 * least:
                return parts, gone
            k = loose[0][1]
            i = self.at[k][0]
            to = self._far(i, k)
            parts += self.chains.pop(i).parts
            gone.append(k)
            del self.at[k]
            self.at[to].remove(i)
            # without a branch other distances stay what they were
            if k in best[1]:
                best = None
            if len(self.at[to]) == 2 and self.at[to][0] != self.at[to][1]:
                self._join(to)

    def _far(self, i: int, k: int) -> int:
        c = self.chains[i]
        return c.b if c.a == k else c.a

    def _join(self, k: int) -> None:
        """Two chains that meet at a key become one."""
        i, j = self.at.pop(k)
        one, two = self.chains[i], self.chains.pop(j)
        one = one if one.b == k else one.turned()
        two = two if two.a == k else two.turned()
        places = np.concatenate([one.places, [one.length], one.length + two.places])
        nodes = np.concatenate([one.nodes, [k], two.nodes]).astype(np.int64)
        self.chains[i] = Chain(one.a, two.b, one.length + two.length, places, nodes, [*one.parts, ("node", k), *two.parts])
        self.at[two.b][self.at[two.b].index(j)] = i

    # Paths

    def path(self, start: tuple, end: tuple) -> list[tuple]:
        """The way between two places: ("node", id) and ("chain", k1, x1, from, to) in order, from and to by the original chain's offsets."""
        if start == end:
            return [("node", start[0])] if start[1] is None else self._stretch(start[0], *[self.chains[start[0]].places[start[1]]] * 2)
        reach = lambda p: {p[0]: 0.0} if p[1] is None else self._ends(p)
        d, before = self.distances(reach(end))
        ways = [(x + d[k], k) for k, x in reach(start).items() if k in d]
        length, k = min(ways, default=(np.inf, None))
        if start[1] is not None and start[0] == end[0] and end[1] is not None:
            s, t = (self.chains[start[0]].places[p[1]] for p in (start, end))
            if abs(s - t) <= length + SAME:
                return self._stretch(start[0], s, t)
        out = []
        if start[1] is not None:
            c = self.chains[start[0]]
            s = c.places[start[1]]
            to_a = k == c.a and (c.a != c.b or s <= c.length - s)
            out += self._stretch(start[0], s, 0.0 if to_a else c.length)
        out.append(("node", k))
        while k in before:
            i, nxt = before[k]
            c = self.chains[i]
            out += self._stretch(i, 0.0, c.length) if c.a == k and c.b == nxt else self._stretch(i, c.length, 0.0)
            k = nxt
            out.append(("node", k))
        if end[1] is not None:
            c = self.chains[end[0]]
            t = c.places[end[1]]
            from_a = k == c.a and (c.a != c.b or t <= c.length - t)
            out += self._stretch(end[0], 0.0 if from_a else c.length, t)
        return out

    def _ends(self, place: tuple) -> dict[int, float]:
        c = self.chains[place[0]]
        s = float(c.places[place[1]])
        return {c.a: s, c.b: c.length - s} if c.a != c.b else {c.a: min(s, c.length - s)}

    def _stretch(self, i: int, low: float, high: float) -> list[tuple]:
        """A chain's parts between two of its places, both included, in the order from low to high."""
        c = self.chains[i]
        if low > high:
            return [(p[0], p[1]) if p[0] == "node" else (*p[:3], p[4], p[3]) for p in reversed(self._stretch(i, high, low))]
        out, at = [], 0.0
        for p in c.parts:
            if p[0] == "node":
                if low - 1e-6 <= at <= high + 1e-6:
                    out.append(p)
                continue
            _, k, x, length, back = p
            a, b = max(low, at) - at, min(high, at + length) - at
            if a <= b + 1e-6:
                out.append(("chain", k, x, *((length - a, length - b) if back else (a, b))))
            at += length
        return out


# Spark again


def _graph(t: pa.Table) -> Chains:
    col = {c: t.column(c).to_pylist() for c in t.column_names}
    chains = {}
    for i in range(t.num_rows):
        places = col["places"][i] if "places" in col and col["places"][i] is not None else []
        # offsets and ids of the known inner nodes, in order
        chains[i] = Chain(col["k1"][i], col["k2"][i], col["length"][i], np.array([p["offset"] for p in places], float), np.array([p["node"] for p in places], np.int64), [("chain", col["k1"][i], col["x1"][i], col["length"][i], False)])
    return Chains(chains)


_STEP = "struct<k1:long,x1:long,low:double,high:double,node:long>"


def solve(chains: DataFrame, inner: DataFrame, least: float) -> DataFrame:
    """Rows (obj, length, way, gone): each object's longest path after pruning as steps in order, and the steps that pruning took away, a cut."""

    def core(t: pa.Table) -> pa.Table:
        on = sorted(_graph(t).core())
        return t.select(CHAIN).take(pa.array(on, pa.int64()))

    def run(t: pa.Table) -> pa.Table:
        g = _graph(t)
        parts, ends = g.prune(least)
        length, _, (start, end) = g.longest()
        step = lambda p: {"k1": None, "x1": None, "low": None, "high": None, "node": p[1]} if p[0] == "node" else {"k1": p[1], "x1": p[2], "low": float(p[3]), "high": float(p[4]), "node": None}
        gone = [step((*p[:3], 0.0, p[3]) if p[0] == "chain" else p) for p in [*parts, *(("node", k) for k in ends)]]
        kind = pa.list_(pa.struct([("k1", pa.int64()), ("x1", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("node", pa.int64())]))
        return pa.table({"obj": t.column("obj")[:1], "length": [float(length)], "way": pa.array([[step(p) for p in g.path(start, end)]], kind), "gone": pa.array([gone], kind)})

    cyclic = chains.groupBy("obj").applyInArrow(core, "obj long, k1 long, x1 long")
    places = inner.join(cyclic, CHAIN, "left_semi").groupBy(*CHAIN).agg(F.array_sort(F.collect_list(F.struct("offset", "node"))).alias("places"))
    return cut(chains.join(places, CHAIN, "left").groupBy("obj").applyInArrow(run, f"obj long, length double, way array<{_STEP}>, gone array<{_STEP}>"))


def nodes_of(solved: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    """Rows (obj, at, along, node) of the nodes in a column's steps, ordered by at and along."""
    steps = solved.select("obj", F.posexplode(column).alias("at", "s"))
    keys = steps.where("s.node is not null").select("obj", "at", F.lit(0.0).alias("along"), "s.node")
    low, high = F.least("s.low", "s.high") - 1e-6, F.greatest("s.low", "s.high") + 1e-6
    within = steps.where("s.node is null").select("obj", "at", "s", F.col("s.k1").alias("k1"), F.col("s.x1").alias("x1")).join(inner, CHAIN).where(F.col("offset").between(low, high))
    along = F.when(F.col("s.low") <= F.col("s.high"), F.col("offset")).otherwise(-F.col("offset"))
    return keys.unionByName(within.select("obj", "at", along.alias("along"), "node"))
