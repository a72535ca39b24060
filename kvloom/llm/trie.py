"""A trie of globally ordered token sets that finds which sets are similar, for one task."""

from __future__ import annotations

import sys

from kvloom.llm.graph import Sets


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest overlap that links sets of n and m tokens at a Jaccard similarity of ``percent`` percent."""
    return -(-percent * (n + m) // (100 + percent))


class Node:
    """A run of tokens that every set below shares."""

    __slots__ = ("run", "children", "ends", "least_size", "most_left", "group")

    def __init__(self, run: list[int], ends: list[int]):
        self.run, self.ends = run, ends
        self.children: list[Node] = []
        self.least_size = 0  # of a set below
        self.most_left = 0  # tokens of a set below, from this run on
        self.group: int | None = None  # a set below, once all of them are known to be in one group


class Trie:
    """Groups of similar sets.

    ``tokens`` are the sets' tokens in one global order; tokens that a single set holds may be left
    out, ``sizes`` are those of the whole sets. ``sets`` holds the groups found so far and takes the
    new ones. A probe walks the trie with the overlap of the path so far, which all sets below
    share, and leaves a subtree out when the tokens left, of the probe or of any set below, cannot
    reach the overlap that the smallest set below asks for, or when all sets below are in the
    probe's group already.
    """

    def __init__(self, tokens: list[list[int]], sizes: list[int], percent: int, sets: Sets):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(tokens) + 2000))
        self.tokens, self.sizes, self.percent, self.sets = tokens, sizes, percent, sets
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        self.root = self.build(order, 0, len(order), 0) if order else None

    def build(self, order: list[int], lo: int, hi: int, at: int) -> Node:
        """Node of the sorted sets order[lo:hi], which agree before position ``at``."""
        first, last = self.tokens[order[lo]], self.tokens[order[hi - 1]]
        end, most = at, min(len(first), len(last))
        while end < most and first[end] == last[end]:
            end += 1
        k = lo
        while k < hi and len(self.tokens[order[k]]) == end:
            k += 1
        node = Node(first[at:end], order[lo:k])
        while k < hi:
            token, stop = self.tokens[order[k]][end], k + 1
            while stop < hi and self.tokens[order[stop]][end] == token:
                stop += 1
            node.children.append(self.build(order, k, stop, end))
            k = stop
        node.least_size = min([c.least_size for c in node.children] + [self.sizes[e] for e in node.ends])
        node.most_left = len(node.run) + max((c.most_left for c in node.children), default=0)
        if not node.children and len(node.ends) == 1:
            node.group = node.ends[0]
        return node

    def probe(self, x: int) -> None:
        """Put set x into one group with every set that it is similar to."""
        if self.root is None:
            return
        own, size, percent, sizes, sets = self.tokens[x], self.sizes[x], self.percent, self.sizes, self.sets
        place = {t: i for i, t in enumerate(own)}
        holds = place.keys()
        find, union = sets.find, sets.union

        def walk(node: Node, overlap: int, passed: int) -> None:
            if node.group is not None and find(node.group) == find(x):
                return
            if overlap + min(len(own) - passed, node.most_left) < least_overlap(size, node.least_size, percent):
                return
            met = holds & node.run if len(node.run) < len(own) else set(node.run) & holds
            if met:
                overlap += len(met)
                passed = max(passed, max(map(place.__getitem__, met)) + 1)
            for e in node.ends:
                if overlap >= least_overlap(size, sizes[e], percent):
                    union(x, e)
            for c in node.children:
                walk(c, overlap, passed)
            if node.group is None:
                group = node.ends[0] if node.ends else node.children[0].group
                if group is not None and all(find(e) == find(group) for e in node.ends) and all(c.group is not None and find(c.group) == find(group) for c in node.children):
                    node.group = group

        walk(self.root, 0, 0)


def similar(tokens: list[list[int]], sizes: list[int], probes: list[int], percent: int, sets: Sets) -> None:
    """Join the groups of ``sets`` along every similar pair with a probe in it; large sets go first."""
    trie = Trie(tokens, sizes, percent, sets)
    for x in sorted(probes, key=lambda i: (-len(tokens[i]), i)):
        trie.probe(x)
