"""Walks over one connected component's edges, as arrays within a task; callers bound its size."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np


class Arrows:
    """Distinct edges between nodes numbered in their order."""

    def __init__(self, src, dst):
        self.nodes, codes = np.unique(np.concatenate([np.asarray(src), np.asarray(dst)]), return_inverse=True)
        pairs = np.unique(codes[: len(src)].astype(np.int64) * len(self.nodes) + codes[len(src) :])
        self.src, self.dst = pairs // max(1, len(self.nodes)), pairs % max(1, len(self.nodes))

    def after(self) -> list[list[int]]:
        """Each node's successors in order."""
        return self._lists(self.src, self.dst)

    def before(self) -> list[list[int]]:
        order = np.argsort(self.dst, kind="stable")
        return self._lists(self.dst[order], self.src[order])

    def _lists(self, keys: np.ndarray, values: np.ndarray) -> list[list[int]]:
        cuts = np.searchsorted(keys, np.arange(1, len(self.nodes)))
        return [x.tolist() for x in np.split(values, cuts)]

    def number(self, values) -> list[int]:
        """The numbers of those values that are nodes."""
        values = np.asarray(values)
        at = np.minimum(np.searchsorted(self.nodes, values), len(self.nodes) - 1)
        return at[self.nodes[at] == values].tolist()


def strong_groups(arrows: Arrows) -> np.ndarray:
    """Each node's strongly connected group, as the group's smallest node: nodes in the order in which a walk leaves them, then walks
    backwards from the last one left."""
    after, before = arrows.after(), arrows.before()
    n = len(after)
    left: list[int] = []
    seen = [False] * n
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        trail = [(root, iter(after[root]))]
        while trail:
            node, rest = trail[-1]
            onward = next((x for x in rest if not seen[x]), None)
            if onward is None:
                left.append(node)
                trail.pop()
            else:
                seen[onward] = True
                trail.append((onward, iter(after[onward])))
    group = np.full(n, -1)
    for root in reversed(left):
        if group[root] >= 0:
            continue
        group[root] = root
        members = [root]
        for node in members:
            for x in before[node]:
                if group[x] < 0:
                    group[x] = root
                    members.append(x)
        group[members] = min(members)
    return group


def shortest_cycle(arrows: Arrows, root: int) -> list[int]:
    """A shortest cycle through `root`, both ends included, of equals the one whose nodes come first; empty if there is none."""
    after = arrows.after()
    came = {root: -1}
    queue = deque([root])
    while queue:
        node = queue.popleft()
        for x in after[node]:
            if x == root:
                path = [root, node] if node != root else [root]
                while node != root and (node := came[node]) != root:
                    path.append(node)
                return [root, *path[1:][::-1], root]
            if x not in came:
                came[x] = node
                queue.append(x)
    return []


def cheapest_cycle(edges: Iterable[tuple], root) -> list[tuple]:
    """(at, node, first) of a shortest cycle through `root` over edges (src, dst, first, steps) that stand for chains; `at` counts steps from the root. Of equals
    the one whose first nodes come first: steps to the root are counted backwards, then the way is chosen node by node."""
    after, before = defaultdict(list), defaultdict(list)
    for src, dst, first, steps in edges:
        after[src].append((first, dst, steps))
        before[dst].append((src, steps))
    far, heap = {}, [(0, root)]
    while heap:
        n, node = heappop(heap)
        if node in far:
            continue
        far[node] = n
        for src, steps in before[node]:
            if src not in far:
                heappush(heap, (n + steps, src))
    out, at, node = [], 0, root
    while node != root or not out:
        ways = [(steps + far[dst], first, dst, steps) for first, dst, steps in after[node] if dst in far]
        if not ways:
            return []
        _, first, dst, steps = min(ways)
        out.append((at, node, first))
        at, node = at + steps, dst
    return out


def reached(arrows: Arrows, roots: list[int]) -> list[int]:
    after = arrows.after()
    seen = set(roots)
    queue = deque(roots)
    while queue:
        for x in after[queue.popleft()]:
            if x not in seen:
                seen.add(x)
                queue.append(x)
    return sorted(seen)


def longest_walks(arrows: Arrows, outward: dict) -> list[tuple]:
    """(node, depth, next) of nodes that lead to no cycle: `outward` has the callee of nodes with calls that aren't followed, a depth of one. Of
    equally deep callees the first is next."""
    after, before = arrows.after(), arrows.before()
    name = arrows.nodes
    best = [(-1, outward[v]) if (v := name[i]) in outward else (0, None) for i in range(len(name))]
    waiting = [len(x) for x in after]
    queue = deque(i for i, n in enumerate(waiting) if n == 0)
    out = []
    while queue:
        node = queue.popleft()
        out.append((name[node], -best[node][0], best[node][1]))
        for caller in before[node]:
            found = (best[node][0] - 1, name[node])
            if best[caller][0] == 0 or found < best[caller]:
                best[caller] = found
            waiting[caller] -= 1
            if waiting[caller] == 0:
                queue.append(caller)
    return out
