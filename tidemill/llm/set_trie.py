"""Prefix tree over globally ordered token sets, for joins by Jaccard similarity."""

from __future__ import annotations

import numpy as np


def needed(x: int, y: int, percent: int) -> int:
    """Least intersection of sets of sizes x and y with 100 * intersection >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


class SetTrie:
    """Path-compressed tree of sets whose tokens are ranks in one order, each set sorted.

    A node is a run of tokens shared by all sets below it. A search counts, once per node, how many
    of the run's tokens the searched set holds; sets below share that partial overlap. A subtree is
    left where even its best-placed set could not reach the overlap it needs.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.tokens: list[np.ndarray] = []  # run of each node
        self.depth: list[int] = []  # tokens up to and with the run
        self.children: list[list[int]] = []
        self.leaves: list[list[int]] = []  # sets that end here
        self.smallest: list[int] = []  # sizes of the sets below
        self.largest: list[int] = []
        path = [self._node(np.empty(0, np.int64), 0)]
        before = np.empty(0, np.int64)
        for i in order:
            now = sets[i]
            n = min(len(before), len(now))
            differ = np.flatnonzero(before[:n] != now[:n])
            common = int(differ[0]) if len(differ) else n
            last = -1
            while self.depth[path[-1]] > common:
                last = path.pop()
            if self.depth[path[-1]] < common:  # split the run of ``last`` at ``common``
                top = path[-1]
                cut = common - self.depth[top]
                middle = self._node(self.tokens[last][:cut], common)
                self.tokens[last] = self.tokens[last][cut:]
                self.children[top][-1] = middle
                self.children[middle].append(last)
                path.append(middle)
            if len(now) > common:
                leaf = self._node(now[common:], len(now))
                self.children[path[-1]].append(leaf)
                path.append(leaf)
            self.leaves[path[-1]].append(i)
            before = now
        for node in self._bottom_up():
            sizes = [self.depth[node]] * bool(self.leaves[node])
            self.smallest[node] = min(sizes + [self.smallest[c] for c in self.children[node]], default=0)
            self.largest[node] = max(sizes + [self.largest[c] for c in self.children[node]], default=0)

    def _node(self, run: np.ndarray, depth: int) -> int:
        self.tokens.append(run)
        self.depth.append(depth)
        for x in (self.children, self.leaves):
            x.append([])
        self.smallest.append(0)
        self.largest.append(0)
        return len(self.tokens) - 1

    def _bottom_up(self) -> list[int]:
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(self.children[node])
        return order[::-1]

    def linked(self, x: np.ndarray, percent: int, mask: np.ndarray, skip) -> list[int]:
        """Sets similar to x. ``mask``: truth per token rank, true for x's tokens; ``skip(node)``: leave this subtree."""
        low, high = -(-percent * len(x) // 100), len(x) * 100 // percent
        out, stack = [], [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            if self.largest[node] < low or self.smallest[node] > high or skip(node):
                continue
            run = self.tokens[node]
            if len(run):
                overlap += int(np.count_nonzero(mask[run]))
                left = len(x) - int(np.searchsorted(x, run[-1], side="right"))
            else:
                left = len(x)
            least = needed(len(x), max(low, self.smallest[node]), percent)
            if overlap + min(left, self.largest[node] - self.depth[node]) < least:
                continue
            if self.leaves[node] and low <= self.depth[node] <= high and overlap >= needed(len(x), self.depth[node], percent):
                out += self.leaves[node]
            stack.extend((c, overlap) for c in self.children[node])
        return out


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def group_of(node: int, trie: SetTrie, groups: Groups, one_group: list[int]) -> int:
    """The group of all sets of a subtree, else -1; of subtrees below only those noted in ``one_group`` and single nodes count."""
    if one_group[node] >= 0:
        return groups.find(one_group[node])
    found = -1
    for s in trie.leaves[node]:
        g = groups.find(s)
        if found not in (-1, g):
            return -1
        found = g
    for c in trie.children[node]:
        g = group_of(c, trie, groups, one_group) if one_group[c] >= 0 or not trie.children[c] else -1
        if g == -1 or found not in (-1, g):
            return -1
        found = g
    one_group[node] = found
    return found


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly the sets connected by similar pairs; subtrees of one's own group are left out.

    Functions that call each other stand outside, as a closure would keep the tree in memory until Python looks for cycles.
    """
    trie, groups, links = SetTrie(sets), Groups(len(sets)), []
    one_group = [-1] * len(trie.tokens)  # a set of the subtree, once all its sets are in one group
    bottom_up = trie._bottom_up()
    width = max((int(s[-1]) for s in sets if len(s)), default=0) + 1
    mask = np.zeros(width, bool)
    fresh = 0
    for i, x in enumerate(sets):
        if fresh > len(bottom_up) // 4:  # after many unions, note which subtrees have become one group
            for node in bottom_up:
                group_of(node, trie, groups, one_group)
            fresh = 0
        mask[x] = True
        for j in trie.linked(x, percent, mask, lambda node, i=i: group_of(node, trie, groups, one_group) == groups.find(i)):
            if groups.join(i, j):
                links.append((i, j))
                fresh += 1
        mask[x] = False
    return links
