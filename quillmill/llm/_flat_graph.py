"""A robust-pruned flat graph over some vectors, and searches in it for many queries at once (NumPy).

Sims are inner products of vectors of length one.  A search keeps, for each
query, a beam of the best nodes met; nodes within the range never fall out of it
and are all expanded, so the beam widens with what the range holds.
"""

from __future__ import annotations

import numpy as np

#: Links of a node, nodes of a beam, nodes a query expands in one step, candidates a node's links are pruned from.
DEGREE, BEAM, WIDTH, POOL = 24, 40, 4, 48
#: How much nearer to a chosen neighbour than to the node a candidate must be to be dropped.
ALPHA = 1.2
#: Queries that search together, and further nodes that searches begin at.
TOGETHER, ENTRIES = 256, 8


def _places(key: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def padded(key: np.ndarray, value: np.ndarray, rows: int, width: int) -> np.ndarray:
    """value by row (key, sorted), the first ``width`` of each; -1 where there is none."""
    at = _places(key)
    out = np.full((rows, width), -1, np.int32)
    some = at < width
    out[key[some], at[some]] = value[some]
    return out


def pruned(x: np.ndarray, node: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Links of each node: of its pool, nearest first, those that no chosen one is ALPHA times nearer to."""
    q, c = pool.shape
    out = np.full((q, DEGREE), -1, np.int32)
    some = pool >= 0
    v = x[np.where(some, pool, 0)]
    own = np.maximum(1 - np.einsum("qcd,qd->qc", v, x[node]), 0)  # half the squared distances
    between = np.maximum(1 - v @ v.transpose(0, 2, 1), 0)
    alive, taken = some & (pool != node[:, None]), np.zeros(q, np.int64)
    for k in range(c):
        mine = np.flatnonzero(alive[:, k] & (taken < DEGREE))
        out[mine, taken[mine]] = pool[mine, k]
        taken[mine] += 1
        alive[mine] &= ALPHA**2 * between[mine, k] > own[mine]
    return out


class Graph:
    """links[i] are the neighbours of node i, -1 behind the last."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None):
        self.x, n = x, len(x)
        self.medoid = int(np.argmax(x @ x.mean(0)))
        self.entries = np.unique(np.append(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64), self.medoid))
        self.links = np.full((n, DEGREE), -1, np.int32) if links is None else links

    @staticmethod
    def build(x: np.ndarray, beam: int = BEAM) -> Graph:
        """Nodes join in batches as large as the graph: each is searched, its beam pruned, and its links returned."""
        g, n = Graph(x), len(x)
        order = np.random.default_rng(11).permutation(n)
        order = np.concatenate([[g.medoid], order[order != g.medoid]])
        g.entries, at = np.array([g.medoid]), 0
        while at < n:
            new = order[at : at + max(min(at, 2 * TOGETHER), 64)]
            q, p, s = (np.zeros(0, t) for t in (np.int64, np.int64, np.float32)) if at == 0 else g.search(x[new], beam=beam)
            near = x[new] @ x[new].T  # those that join together don't meet in the graph
            np.fill_diagonal(near, -2)
            k = min(len(new) - 1, POOL if at == 0 else DEGREE // 2)
            if k > 0:
                c = np.argpartition(-near, k - 1, 1)[:, :k]
                r = np.repeat(np.arange(len(new)), k)
                q, p, s = np.append(q, r), np.append(p, new[c.ravel()]), np.append(s, near[r, c.ravel()])
            g._join(new[q], p, s)
            at += len(new)
        g.entries = Graph(x).entries
        g._return_links()
        return g

    def _return_links(self) -> None:
        """Each node takes up to DEGREE of the nodes that link to it, first those that fewest link to: none must be out of reach."""
        node, c = np.nonzero(self.links >= 0)
        to = self.links[node, c]
        known = np.bincount(to, minlength=len(self.x))
        order = np.lexsort((c, known[node], to))
        self.links = np.hstack([self.links, padded(to[order], node[order], len(self.x), DEGREE)])

    def _join(self, node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        """Prune the links of nodes from what was found, then those of the neighbours they chose."""
        for back in (False, True):
            order = np.lexsort((-sim, node))
            own, row = np.unique(node[order], return_inverse=True)
            pool = padded(row, other[order], len(own), POOL)
            crowded = (pool >= 0).sum(1) > DEGREE if back else np.ones(len(own), bool)
            self.links[own[~crowded]] = pool[~crowded][:, :DEGREE]
            for a in range(0, len(own), TOGETHER):
                part = np.flatnonzero(crowded[a : a + TOGETHER]) + a
                self.links[own[part]] = pruned(self.x, own[part], pool[part])
            if not back:
                r, c = np.nonzero(self.links[own] >= 0)
                a, b = self.links[own][r, c].astype(np.int64), own[r]
                target = np.unique(a)
                r, c = np.nonzero(self.links[target] >= 0)
                pair = np.unique(np.append(a * len(self.x) + b, target[r] * len(self.x) + self.links[target][r, c]))
                node, other = pair // len(self.x), pair % len(self.x)
                sim = np.einsum("ij,ij->i", self.x[node], self.x[other])

    def search(self, q: np.ndarray, floor: float = 2.0, starts: np.ndarray | None = None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, sim), by query and best first: the beam of each query, and whatever of at least ``floor`` it met.

        starts: further nodes to begin at, a row for each query, -1 behind the last.
        """
        out = []
        for a in range(0, len(q), TOGETHER):
            found = self._search(q[a : a + TOGETHER], floor, None if starts is None else starts[a : a + TOGETHER], beam)
            out.append((found[0] + a, found[1], found[2]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _search(self, q: np.ndarray, floor: float, starts: np.ndarray | None, beam: int) -> tuple:
        n, m = len(self.x), len(q)
        met = np.zeros(m * n, bool)
        at_q, at_p, sim, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
        new = (np.arange(m)[:, None] * n + self.entries).ravel()
        if starts is not None:
            r, c = np.nonzero(starts >= 0)
            new = np.append(new, r * n + starts[r, c])
        while len(new):
            new = np.unique(new[~met[new]])
            met[new] = True
            nq, np_ = new // n, new % n
            at_q, at_p = np.append(at_q, nq), np.append(at_p, np_)
            sim, open_ = np.append(sim, np.einsum("ij,ij->i", q[nq], self.x[np_])), np.append(open_, np.ones(len(new), bool))
            order = np.lexsort((-sim, at_q))
            near = sim[order] >= floor
            stays = (_places(at_q[order]) < beam) | near
            order, near = order[stays], near[stays]
            at_q, at_p, sim, open_ = at_q[order], at_p[order], sim[order], open_[order]
            waiting = np.flatnonzero(open_)
            now = waiting[(_places(at_q[waiting]) < WIDTH) | near[waiting]]
            open_[now] = False
            links = self.links[at_p[now]]
            r, c = np.nonzero(links >= 0)
            new = at_q[now][r] * n + links[r, c]
        return at_q, at_p, sim
