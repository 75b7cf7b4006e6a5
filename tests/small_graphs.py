"""Paths and pruning on small graphs held whole, to compare with."""

import heapq
import math

import numpy as np


class Graph:
    """An object's skeleton graph: neighbours of each node in arrays, nodes in the order of their ids."""

    def __init__(self, nodes: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.nodes = np.sort(nodes)
        i, j = np.searchsorted(self.nodes, np.r_[u, v]), np.searchsorted(self.nodes, np.r_[v, u])
        order = np.lexsort((j, i))
        self.to, self.length = j[order].tolist(), np.r_[w, w][order].tolist()
        self.start = np.searchsorted(i[order], np.arange(len(nodes) + 1)).tolist()
        self.degree = np.diff(self.start)

    def distances(self, sources: list[int]) -> tuple[np.ndarray, list[int]]:
        """Distance to the nearest source, infinite beyond its part of the graph, and the node before on that path, -1 at sources."""
        d, before, heap = [math.inf] * len(self.nodes), [-1] * len(self.nodes), [(0.0, s) for s in sources]
        for s in sources:
            d[s] = 0.0
        while heap:
            at, node = heapq.heappop(heap)
            if at > d[node]:
                continue
            for k in range(self.start[node], self.start[node + 1]):
                new = at + self.length[k]
                if new < d[self.to[k]] - 1e-9:
                    d[self.to[k]], before[self.to[k]] = new, node
                    heapq.heappush(heap, (new, self.to[k]))
        return np.array(d), before

    def longest(self) -> tuple[int, int, float]:
        """(start, end, length) of the longest shortest path, end <= start, the first pair in that order.

        Bounds of each node's farthest distance shrink with every node looked at; a node is looked at only while it may still be an end of a path as long as the
        longest one found, so most never are.
        """
        n = len(self.nodes)
        most, best = np.full(n, np.inf), (0, 0, 0.0)
        left, high = np.ones(n, bool), True
        while left.any():
            # in turn the node that may reach farthest, and a node near the middle, which bounds all others
            node = int(np.where(left, most, -1).argmax()) if high else int(np.where(left, most, np.inf).argmin())
            high = not high
            d, _ = self.distances([node])
            reached = np.isfinite(d)
            far = float(d[reached].max())
            ends = np.flatnonzero(reached & (d >= far - 1e-9))
            start, end = min((max(node, int(e)), min(node, int(e))) for e in ends)
            if far > best[2] + 1e-9 or (far > best[2] - 1e-9 and (start, end) < best[:2]):
                best = (start, end, max(far, best[2]))
            most[reached] = np.minimum(most[reached], d[reached] + far)
            left[node] = False
            left &= most >= best[2] - 1e-9
        return best


def path(before: list[int], end: int) -> list[int]:
    """From an end back to the source of a search."""
    out = [end]
    while before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return out


def prune(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Without branches from an end to its nearest branch point of at most ``least``, while the longest path is over three times that."""
    while True:
        graph = Graph(nodes, u, v, w)
        nodes = graph.nodes
        ends, branches = np.flatnonzero(graph.degree == 1), np.flatnonzero(graph.degree >= 3)
        if not len(branches) or not len(ends):
            return nodes, u, v, w
        d, before = graph.distances(branches.tolist())
        at = int(ends[d[ends].argmin()])
        if d[at] > least or graph.longest()[2] <= 3 * least:
            return nodes, u, v, w
        gone = nodes[path(before, at)[:-1]]
        stay = ~np.isin(u, gone) & ~np.isin(v, gone)
        nodes, u, v, w = nodes[~np.isin(nodes, gone)], u[stay], v[stay], w[stay]
