"""Graphs of whole repositories inside one task, for buckets of repositories of bounded size.

A bucket is an Arrow table (repo_id, src, dst) without duplicates and self edges; ``graph`` deals out the
buckets and sends larger repositories through rounds over all of them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PATHS = 1 << 20  # paths of one step of ``short_cycles``


class Bucket:
    """Nodes as numbers in the order of repository and name, edges sorted by source; rows without a source are ``starts``."""

    def __init__(self, rows: pa.Table):
        edges, starts = rows.filter(pc.is_valid(rows["src"])), rows.filter(pc.is_null(rows["src"]))
        m = len(edges)
        ends = [edges["src"], edges["dst"], starts["dst"]]
        names = pa.chunked_array([c for e in ends for c in e.chunks], rows.schema.field("dst").type).combine_chunks().dictionary_encode()
        repos = pa.chunked_array([c for t in (edges, edges, starts) for c in t["repo_id"].chunks], rows.schema.field("repo_id").type)
        repos = repos.combine_chunks().dictionary_encode("encode")
        in_order = pc.sort_indices(names.dictionary)
        rank = np.empty(len(in_order), "int64")
        rank[in_order.to_numpy()] = np.arange(len(in_order))
        width = max(len(in_order), 1)
        keys, nodes = np.unique(repos.indices.to_numpy().astype("int64") * width + rank[names.indices.to_numpy()], return_inverse=True)
        order = np.lexsort((nodes[m:2 * m], nodes[:m]))
        self.order = order
        self.n, self.src, self.dst, self.starts = len(keys), nodes[:m][order], nodes[m:2 * m][order], nodes[2 * m:]
        self.repo = keys // width
        self.at = np.searchsorted(self.src, np.arange(self.n + 1))
        self._repos, self._names, self._rank = repos.dictionary, names.dictionary.take(in_order), keys % width

    def repos(self, nodes: np.ndarray) -> pa.Array:
        return self._repos.take(pa.array(self.repo[nodes]))

    def names(self, nodes: np.ndarray) -> pa.Array:
        return self._names.take(pa.array(self._rank[nodes]))

    def components(self) -> np.ndarray:
        """Strong component of every node, numbered so that edges between components lead to smaller numbers (Tarjan)."""
        at, dst, n = self.at.tolist(), self.dst.tolist(), self.n
        seen, low, found, place = [0] * n, [0] * n, [-1] * n, at[:n]
        stack, clock, number = [], 0, 0
        for root in range(n):
            if seen[root]:
                continue
            todo = [root]
            while todo:
                x = todo[-1]
                if not seen[x]:
                    clock += 1
                    seen[x] = low[x] = clock
                    stack.append(x)
                deeper = False
                while place[x] < at[x + 1]:
                    y = dst[place[x]]
                    if not seen[y]:
                        todo.append(y)
                        deeper = True
                        break
                    if found[y] < 0 and low[y] < low[x]:
                        low[x] = low[y]
                    place[x] += 1
                if deeper:
                    continue
                todo.pop()
                if low[x] == seen[x]:
                    while True:
                        y = stack.pop()
                        found[y] = number
                        if y == x:
                            break
                    number += 1
        return np.array(found, "int64")


def strong_components(rows: pa.Table) -> pa.Table:
    """Nodes on a cycle with the smallest name of their component."""
    g = Bucket(rows)
    comp = g.components()
    _, first, inverse, size = np.unique(comp, return_index=True, return_inverse=True, return_counts=True)
    nodes = np.flatnonzero(size[inverse] > 1)
    return pa.table({"repo_id": g.repos(nodes), "node": g.names(nodes), "component": g.names(first[inverse[nodes]])})


def cycle_edges(rows: pa.Table) -> pa.Table:
    g = Bucket(rows)
    comp = g.components()
    return pa.table({"repo_id": g.repos(g.src), "src": g.names(g.src), "dst": g.names(g.dst), "in_cycle": pa.array(comp[g.src] == comp[g.dst])})


def blast_radius(rows: pa.Table) -> pa.Table:
    """Direct and transitive dependents of every node: sets of nodes as bits, handed on from component to component."""
    g = Bucket(rows)
    comp = g.components()
    at, dst, of = g.at.tolist(), g.dst.tolist(), comp.tolist()
    base = np.searchsorted(g.repo, g.repo).tolist()
    order = np.argsort(-comp, kind="stable").tolist()
    above, transitive = {}, [0] * g.n
    i = 0
    while i < len(order):
        c, j = of[order[i]], i
        while j < len(order) and of[order[j]] == c:
            j += 1
        members = order[i:j]
        whole = above.pop(c, 0)
        dependents = whole.bit_count() + len(members) - 1
        for x in members:
            whole |= 1 << (x - base[x])
            transitive[x] = dependents
        for x in members:
            for y in dst[at[x]:at[x + 1]]:
                if of[y] != c:
                    above[of[y]] = above.get(of[y], 0) | whole
        i = j
    nodes = np.arange(g.n)
    direct = np.bincount(g.dst, minlength=g.n).astype("int64")
    return pa.table({"repo_id": g.repos(nodes), "node": g.names(nodes), "direct": pa.array(direct), "transitive": pa.array(transitive, pa.int64())})


def blast_from(rows: pa.Table) -> pa.Table:
    """Nodes that lead to a start, with the least number of steps."""
    g = Bucket(rows)
    order = np.argsort(g.dst, kind="stable")
    back, at = g.src[order].tolist(), np.searchsorted(g.dst[order], np.arange(g.n + 1)).tolist()
    level = [-1] * g.n
    todo = np.unique(g.starts).tolist()
    for x in todo:
        level[x] = 0
    for x in todo:
        for y in back[at[x]:at[x + 1]]:
            if level[y] < 0:
                level[y] = level[x] + 1
                todo.append(y)
    level = np.array(level, "int32")
    nodes = np.flatnonzero(level > 0)
    return pa.table({"repo_id": g.repos(nodes), "node": g.names(nodes), "level": pa.array(level[nodes])})


def short_cycles(rows: pa.Table, longest: int) -> Iterator[pa.RecordBatch]:
    """Simple cycles of up to ``longest`` nodes from their smallest node on, a bounded number of paths at a time."""
    g = Bucket(rows)
    todo = [np.stack([g.src, g.dst], 1)[g.src < g.dst]]
    while todo:
        paths = todo.pop()
        last = paths[:, -1]
        degree = g.at[last + 1] - g.at[last]
        if degree.sum() > PATHS and len(paths) > 1:
            todo += np.array_split(paths, 2)
            continue
        path = np.repeat(np.arange(len(paths)), degree)
        edge = np.arange(len(path)) + np.repeat(g.at[last] - (np.cumsum(degree) - degree), degree)
        after, first = g.dst[edge], paths[path, 0]
        closed = paths[path[after == first]]
        if len(closed):
            length = closed.shape[1]
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(closed) + 1, dtype="int32") * length), g.names(closed.ravel()))
            yield pa.record_batch({"repo_id": g.repos(closed[:, 0]), "path": whole, "length": pa.array(np.full(len(closed), length, "int32"))})
        if paths.shape[1] < longest:
            on = after > first
            path, after = path[on], after[on]
            new = (paths[path, 1:] != after[:, None]).all(axis=1)
            if new.any():
                todo.append(np.column_stack([paths[path[new]], after[new]]))


def _neighbours(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[list, list, list]:
    """Both directions of the edges as (first place of each node, neighbour, weight), edges between the same nodes added up."""
    keys, at = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
    weight = np.bincount(at, np.tile(w, 2)).astype("int64")
    return np.searchsorted(keys // n, np.arange(n + 1)).tolist(), (keys % n).tolist(), weight.tolist()


def _moved(graph: tuple[list, list, list], k: list, m2: list, label: list) -> tuple[list, bool]:
    """Labels after every node has moved to the neighbouring community with the largest gain until none gains."""
    (at, to, weight), label, changed = graph, list(label), False
    total = [0] * len(k)
    for x, c in enumerate(label):
        total[c] += k[x]
    todo, waits = deque(range(len(k))), [True] * len(k)
    while todo:
        x = todo.popleft()
        waits[x] = False
        own, near = label[x], {label[x]: 0}
        for i in range(at[x], at[x + 1]):
            c = label[to[i]]
            near[c] = near.get(c, 0) + weight[i]
        total[own] -= k[x]
        best, most = own, m2[x] * near[own] - k[x] * total[own]
        for c, w in near.items():
            gain = m2[x] * w - k[x] * total[c]
            if gain > most:
                best, most = c, gain
        total[best] += k[x]
        if best != own:
            label[x], changed = best, True
            for i in range(at[x], at[x + 1]):
                y = to[i]
                if label[y] != best and not waits[y]:
                    waits[y] = True
                    todo.append(y)
    return label, changed


def communities(rows: pa.Table) -> pa.Table:
    """Communities of the weighted pairs (repo_id, src, dst, w) by modularity.

    Nodes move, then whole communities, until none gains; then nodes again from
    there. Every move gains, in whole numbers, so it ends.
    """
    g = Bucket(rows)
    w = rows["w"].to_numpy()[g.order]
    k = np.bincount(g.src, w, g.n).astype("int64") + np.bincount(g.dst, w, g.n).astype("int64")
    m2 = np.bincount(g.repo, k).astype("int64")[g.repo]
    nodes, label = _neighbours(g.n, g.src, g.dst, w), range(g.n)
    while True:
        label, changed = _moved(nodes, k.tolist(), m2.tolist(), label)
        if not changed:
            break
        while changed:
            first, of = np.unique(label, return_index=True, return_inverse=True)[1:]
            n, a, b = len(first), of[g.src], of[g.dst]
            cross = a != b
            whole = np.bincount(of, k, n).astype("int64")
            merged, changed = _moved(_neighbours(n, a[cross], b[cross], w[cross]), whole.tolist(), m2[first].tolist(), range(n))
            label = np.array(merged)[of].tolist()
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    every = np.arange(g.n)
    return pa.table({"repo_id": g.repos(every), "node": g.names(every), "community": g.names(first[of])})
