"""Hierarchical navigable small-world graphs over unit vectors, for tasks of the embedding operators."""

from __future__ import annotations

import numpy as np

#: Links of a node on a level above the lowest, and on the lowest; the beam that a node is placed with.
LINKS, LOWEST_LINKS, PLACING = 12, 32, 64
#: Nodes of each of the first steps of a level, which are compared with all of it; nodes of a step after those.
FIRST, STEP = 192, 512
#: Beam entries that are left in one round of a search.
OPENED = 4


def levels(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The highest level of each node, geometric in a hash of its id."""
    h = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in (33, 29):
            h = (h ^ (h >> np.uint64(k))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    u = (h.astype(np.float64) + 1) / 2.0**64
    return np.minimum(-np.log(np.minimum(u, 1)) / np.log(links), 12).astype(np.int64)


def beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, least: float = np.inf):
    """(ids, similarities) of the ``beam`` best nodes that a walk from the entries reaches for each row of
    q, best first, -1 where there are fewer; and (query, node) of all that it saw at ``least`` or above."""
    b, n = len(q), len(x)
    seen, order = np.zeros((b, n + 1), bool), np.zeros((b, n + 1), np.int16)  # the last column is that of no node
    ids, sims = np.full((b, beam), -1, np.int64), np.full((b, beam), -np.inf, np.float32)
    fresh = np.zeros((b, beam), bool)
    hits = []

    def add(rows: np.ndarray, got: np.ndarray) -> None:
        """Nodes ``got`` (-1: none) that rows meet go into their beams."""
        at = rows[:, None]
        place = np.arange(got.shape[1], dtype=np.int16)[None]
        order[at, got] = place  # of a node that comes twice the last place stays
        ok = (got >= 0) & ~seen[at, got] & (order[at, got] == place)
        r, c = np.nonzero(ok)
        node = got[r, c]
        seen[rows[r], node] = True
        s = np.full(got.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[rows[r]], x[node])
        near = s[r, c] >= least
        if near.any():
            hits.append((rows[r[near]], node[near]))
        all_s, all_i = np.concatenate([sims[rows], s], 1), np.concatenate([ids[rows], got], 1)
        all_f = np.concatenate([fresh[rows], ok], 1)
        top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
        sims[rows], ids[rows], fresh[rows] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_f))

    add(np.arange(b), entry)
    rows = np.flatnonzero(fresh.any(1))
    opened = min(OPENED, beam)
    while len(rows):
        s = np.where(fresh[rows], sims[rows], -np.inf)
        top = np.argpartition(-s, opened - 1, 1)[:, :opened]
        ok = np.take_along_axis(s, top, 1) > -np.inf
        node = np.take_along_axis(ids[rows], top, 1)
        fresh[rows[:, None], top] = False
        got = np.where(ok[:, :, None], links[node], -1).reshape(len(rows), -1)
        add(rows, got)
        rows = rows[fresh[rows].any(1)]
    best = np.argsort(-sims, 1, kind="stable")
    found = [np.concatenate(c) if hits else np.zeros(0, np.int64) for c in (zip(*hits) if hits else ((), ()))]
    ids = np.where(np.isinf(sims), -1, ids)
    return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1), found


def chosen(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first, -1: none) ``most`` for each row: those that are nearer to it than to any
    taken before, and the best others where there is room."""
    got = x[near]
    mutual = np.einsum("bcd,bed->bce", got, got, optimize=True)
    b, c = near.shape
    taken = np.zeros((b, c), bool)
    closest = np.full((b, c), -np.inf, np.float32)  # to those taken
    for k in range(c):
        take = (near[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (taken.sum(1) < most)
        taken[:, k] = take
        closest = np.where(take[:, None], np.maximum(closest, mutual[:, k]), closest)
    rank = np.where(near < 0, 2 * c, np.where(taken, 0, c)) + np.arange(c)
    order = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(near, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def sorted_out(near: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best of each row's candidates, without repeats, best first."""
    order = np.lexsort((-sims, near), axis=1)
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    twice = np.zeros(near.shape, bool)
    twice[:, 1:] = near[:, 1:] == near[:, :-1]
    sims = np.where(twice | (near < 0), -np.inf, sims)
    order = np.argsort(-sims, 1, kind="stable")[:, :most]
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isinf(sims), -1, near), sims


#: Links that a node gets for those that others have dropped.
KEPT = 8


def held(links: np.ndarray, nearest: int = 3) -> np.ndarray:
    """links with more columns, so that every node is linked from the ``nearest`` first that it links to:
    a node that all others have dropped for better ones would never be met. Those of one node hang
    under it as a tree, KEPT to each, so that no node has many links."""
    for k in range(min(nearest, links.shape[1])):
        to = links[:, k]
        at = np.flatnonzero(to >= 0)
        at = at[~(links[to[at]] == at[:, None]).any(1)]
        if not len(at):
            continue
        at = at[np.argsort(to[at], kind="stable")]
        _, first, count = np.unique(to[at], return_index=True, return_counts=True)
        nth, start = np.arange(len(at)) - np.repeat(first, count), np.repeat(first, count)
        above = np.where(nth < KEPT, to[at], at[start + np.maximum(nth // KEPT - 1, 0)])
        more = np.full((len(links), 2 * KEPT), -1, np.int64)  # as the root of a tree and within another
        more[above, nth % KEPT + KEPT * (nth >= KEPT)] = at
        links = np.concatenate([links, more], 1)
    none = links < 0
    return np.take_along_axis(links, np.argsort(none, 1, kind="stable"), 1)[:, : max(1, int((~none).sum(1).max()))]


class Graph:
    """A graph over the rows of x (unit vectors, 32 bits): for each level from the lowest up its nodes and
    their links, as places among these nodes."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.nodes, self.links = x, nodes, links

    @classmethod
    def build(cls, x: np.ndarray, height: np.ndarray) -> Graph:
        top = int(height.max())
        nodes = [np.flatnonzero(height >= k) for k in range(top + 1)]
        graph = cls(x, nodes, [np.zeros((0, 0), np.int64)] * (top + 1))
        for k in range(top, -1, -1):
            graph.links[k] = graph._linked(k)
        return graph

    def _linked(self, k: int) -> np.ndarray:
        """Links of a level whose upper levels stand: its nodes come in steps, those of upper levels first."""
        nodes, most = self.nodes[k], LOWEST_LINKS if k == 0 else LINKS
        x, n = self.x[nodes], len(nodes)
        links = np.full((n, most), -1, np.int64)
        upper = np.isin(nodes, self.nodes[k + 1]) if k + 1 < len(self.nodes) else np.zeros(n, bool)
        order = np.concatenate([np.flatnonzero(upper), np.flatnonzero(~upper)])
        done = 0
        while done < n:
            step = order[done : done + (FIRST if done < 2 * FIRST else min(STEP, done))]
            s = x[step] @ x[step].T
            np.fill_diagonal(s, -np.inf)
            m = min(PLACING, len(step))
            own = np.argpartition(-s, m - 1, 1)[:, :m]
            near, sims = step[own], np.take_along_axis(s, own, 1)
            near = np.where(np.isinf(sims), -1, near)
            if 0 < done < 2 * FIRST:
                s = x[step] @ x[order[:done]].T
                near, sims = np.concatenate([near, np.broadcast_to(order[:done], s.shape)], 1), np.concatenate([sims, s], 1)
            elif done:
                start = np.broadcast_to(order[:4], (len(step), 4))  # entries of the levels above may not be placed yet
                ids, s, _ = beams(x, links, x[step], np.concatenate([self._entries(x[step], k), start], 1), PLACING)
                near, sims = np.concatenate([near, ids], 1), np.concatenate([sims, s], 1)
            near, sims = sorted_out(near, sims, PLACING)
            links[step] = chosen(x, near, sims, most)
            self._answered(x, links, step, most)
            done += len(step)
        return held(links)

    def _answered(self, x: np.ndarray, links: np.ndarray, step: np.ndarray, most: int) -> None:
        """Links back from all that the nodes of a step link to."""
        at, to = np.repeat(step, most), links[step].ravel()
        at, to = at[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(node), 2048):
            some, n = node[lo : lo + 2048], count[lo : lo + 2048]
            wide = int(n.max())
            back = np.full((len(some), wide), -1, np.int64)
            r = np.repeat(np.arange(len(some)), n)
            c = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            back[r, c] = at[np.repeat(first[lo : lo + 2048], n) + c]
            near = np.concatenate([links[some], back], 1)
            sims = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(near >= 0)
            sims[r, c] = np.einsum("ij,ij->i", x[some[r]], x[near[r, c]])
            near, sims = sorted_out(near, sims, max(PLACING, most))
            fits = (near >= 0).sum(1) <= most
            links[some[fits]] = near[fits, :most]
            full = np.flatnonzero(~fits)
            for a in range(0, len(full), 512):
                f = full[a : a + 512]
                links[some[f]] = chosen(x, near[f], sims[f], most)

    def _entries(self, q: np.ndarray, k: int, beam: int = 4) -> np.ndarray:
        """Places on level k to start from: what a walk down the levels above comes to."""
        at = None
        for j in range(len(self.nodes) - 1, k, -1):
            x = self.x[self.nodes[j]]
            if at is None:
                at = np.broadcast_to(np.arange(min(beam, len(x))), (len(q), min(beam, len(x))))
            ids, _, _ = beams(x, self.links[j], q, at, beam)
            down = np.searchsorted(self.nodes[j - 1], self.nodes[j][np.maximum(ids, 0)])
            at = np.where(ids < 0, -1, down)
        return np.zeros((len(q), 1), np.int64) if at is None else at

    def search(self, q: np.ndarray, beam: int, least: float):
        """(query, node) with a similarity of ``least`` or more, as far as beams find them. A beam full of
        such nodes is widened until it holds others or all nodes."""
        n = len(self.x)
        rows, at = np.arange(len(q)), self._entries(q, 0)
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        beam = min(beam, n)
        while len(rows):
            _, sims, (r, node) = beams(self.x, self.links[0], q[rows], at[rows], beam, least)
            more = (sims[:, -1] >= least) & (beam < n)
            keep = ~more[r]
            got.append((rows[r[keep]], node[keep]))
            rows, beam = rows[more], min(2 * beam, n)
        return tuple(np.concatenate(c) for c in zip(*got))
