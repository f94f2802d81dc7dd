"""Words within an edit distance of any of many queries, by a walk over the words' common beginnings.

Sorted words are a tree: each beginning is a node, once for all words that share it. Level by level, a row of the edit table is made for every query
and node that may still come near, in arrays over all such pairs at once. A beginning from which no word can be near any more is left
with all words below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Words of a tree, and pairs of a query and a node that are held at once; a level with more pairs is walked in parts.
WORDS, PAIRS = 100_000, 200_000


class Tree:
    """The beginnings of sorted distinct words, by length: parent in the level above, last character, and the word that ends there or -1."""

    def __init__(self, words: list[str]):
        self.words = words
        longest = max(map(len, words), default=0)
        chars = np.zeros((len(words), longest), np.int32)
        for i, w in enumerate(words):
            chars[i, : len(w)] = [ord(c) for c in w]
        size = np.array([len(w) for w in words])
        self.levels = []
        above = np.zeros(len(words), np.int64)  # the node of each word in the level above
        alive = np.arange(len(words))
        for depth in range(longest):
            alive = alive[size[alive] > depth]
            c = chars[alive, depth]
            new = np.append(True, (np.diff(above[alive]) != 0) | (np.diff(c) != 0)) if len(alive) else np.zeros(0, bool)
            node = np.cumsum(new) - 1
            ends = np.full(int(new.sum()), -1)
            last = size[alive] == depth + 1
            ends[node[last]] = alive[last]
            parent = above[alive[new]]
            self.levels.append((np.searchsorted(parent, np.arange(int(above[alive].max()) + 2)), c[new], ends))
            above[alive] = node


def near(tree: Tree, queries: list[str], most: int) -> Iterator[tuple[int, int, int]]:
    """(query, word, distance) of all pairs within the distance; restricted transpositions of neighbours cost 1."""
    width = max(map(len, queries), default=0)
    text = np.zeros((len(queries), width), np.int32)
    for i, q in enumerate(queries):
        text[i, : len(q)] = [ord(c) for c in q]
    size = np.array([len(q) for q in queries])
    first = np.tile(np.minimum(np.arange(width + 1), most + 2).astype(np.int16), (len(queries), 1))
    none = np.full_like(first, most + 2)
    todo = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), first, none, np.zeros(len(queries), np.int32))]
    while todo:
        depth, q, node, row, before, last = todo.pop()
        if depth == len(tree.levels):
            continue
        if len(q) > PAIRS:
            half = len(q) // 2
            todo += [(depth, q[s], node[s], row[s], before[s], last[s]) for s in (slice(half, None), slice(0, half))]
            continue
        starts, chars, ends = tree.levels[depth]
        node = np.minimum(node, len(starts) - 1)
        many = np.append(starts, starts[-1])[node + 1] - starts[node]
        pair = np.repeat(np.arange(len(q)), many)
        child = starts[node][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        for at in range(0, len(pair), PAIRS):
            p, c = pair[at : at + PAIRS], child[at : at + PAIRS]
            own, old, older, x, y = q[p], row[p], before[p], chars[c], last[p]
            new = np.empty_like(old)
            new[:, 0] = np.minimum(old[:, 0] + 1, most + 2)
            for j in range(1, width + 1):
                t = text[own, j - 1]
                cost = np.minimum(np.minimum(old[:, j], new[:, j - 1]) + 1, old[:, j - 1] + (t != x))
                if j > 1:
                    swap = (x == text[own, j - 2]) & (y == t) & (depth > 0)
                    cost = np.where(swap, np.minimum(cost, older[:, j - 2] + 1), cost)
                new[:, j] = np.minimum(cost, most + 2)
            d = new[np.arange(len(p)), size[own]]
            hit = (ends[c] >= 0) & (d <= most)
            yield from zip(own[hit].tolist(), ends[c[hit]].tolist(), d[hit].tolist(), strict=True)
            inside = np.arange(width + 1) <= size[own][:, None]
            open_ = np.where(inside, np.minimum(new, old), most + 2).min(axis=1) <= most
            todo.append((depth + 1, own[open_], c[open_], new[open_], old[open_], x[open_]))


def within(queries: list[str], most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted tokens: (query, token, distance)."""

    def found(words: list[str]) -> pa.RecordBatch:
        hits = [*near(Tree(words), queries, most)]
        columns = [pa.array([queries[q] for q, _, _ in hits], pa.string()), pa.array([words[w] for _, w, _ in hits], pa.string()), pa.array([d for *_, d in hits], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "token", "distance"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            held += b.column("token").to_pylist()
            while len(held) >= WORDS:
                yield found(held[:WORDS])
                held = held[WORDS:]
        if held and queries:
            yield found(sorted(set(held)))

    return run
