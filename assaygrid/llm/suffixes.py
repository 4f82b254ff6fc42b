"""Deep-shallow sorting of byte strings, and what is shared by strings that agree around a common place."""

from __future__ import annotations

import numpy as np

SHALLOW = 64  # bytes compared by the multikey quicksort; deeper groups go to blind tries
CHUNK = 8  # bytes compared at once


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, known to reach ``start``."""
    end = min(len(a), len(b))
    step = 16
    while start < end:
        if a[start : start + step] != b[start : start + step]:
            if step == 1:
                return start
            step //= 4
        else:
            start += step
    return min(start, end)


class Node:
    """A branching of a blind trie: only its depth and the first bytes of its branches are kept."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.children: dict[int, Node | list[int]] = {}


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> list[int]:
    """The members in order, all of which agree in their first ``depth`` bytes.

    A string goes down by the bytes at the branchings alone; only then is it compared, with the leaf it reached,
    and the length they share says where it branches off. A leaf holds all copies of one string.
    """
    root: Node | list[int] = [members[0]]
    for m in members[1:]:
        s = strings[m]
        at = root
        while isinstance(at, Node):
            at = at.children.get(s[at.depth] if at.depth < len(s) else -1) or next(iter(at.children.values()))
        other = strings[at[0]]
        shared = common(s, other, depth)
        if shared == len(s) == len(other):
            at.append(m)
            continue
        parent, at = None, root
        while isinstance(at, Node) and at.depth < shared:
            parent, branch = at, s[at.depth]
            at = at.children[branch]
        if isinstance(at, Node) and at.depth == shared:
            at.children[s[shared] if shared < len(s) else -1] = [m]
            continue
        node = Node(shared)
        node.children[other[shared] if shared < len(other) else -1] = at
        node.children[s[shared] if shared < len(s) else -1] = [m]
        if parent is None:
            root = node
        else:
            parent.children[branch] = node
    out: list[int] = []
    stack: list[Node | list[int]] = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, Node):
            stack.extend(at.children[b] for b in sorted(at.children, reverse=True))
        else:
            out += at
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort over chunks to ``shallow`` bytes, then blind tries.

    A string that ends comes before those it begins.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_trie(strings, group, depth)
        else:
            pivot = strings[group[len(group) // 2]][depth : depth + CHUNK]
            keys = [strings[m][depth : depth + CHUNK] for m in group]
            less = [m for m, k in zip(group, keys) if k < pivot]
            same = [m for m, k in zip(group, keys) if k == pivot]
            more = [m for m, k in zip(group, keys) if k > pivot]
            stack.append((more, depth))
            if len(pivot) < CHUNK:
                stack.extend(([m], depth) for m in reversed(same))  # all of these end here, alike
            else:
                stack.append((same, depth + CHUNK))
            stack.append((less, depth))
    return out


def lcp(strings: list[bytes], order: list[int]) -> np.ndarray:
    """Shared length of each string in order and the one before it; 0 for the first."""
    return np.array([0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))][: len(order)], np.int64)


def padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of equal length, and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(size.max()) if len(size) else 0
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    return flat.reshape(len(strings), width), size


def reaches(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far around its place each string shares ``length`` bytes or more with another one.

    String i has ``left[i]``, read backwards from the place, and ``right[i]``, from the place on. For every j that
    shares l bytes to the left and r to the right with l + r >= length, all these are covered; returned are the
    largest such l and r of each i (0, 0 if there is no j).

    The right sides are sorted. A depth r with its runs of neighbours that share r bytes or more stands for all pairs
    that branch there; in a run, the best partner to the left is a neighbour in the order of the left sides.
    """
    n = len(right)
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return best_l, best_r
    order = np.array(deep_shallow(right))
    shared = lcp(right, order.tolist())
    rank = np.empty(n, np.int64)
    rank[deep_shallow(left)] = np.arange(n)
    rows, size = padded(left)
    rank, rows, size = rank[order], rows[order], size[order]
    longest = int(size.max())
    found_l, found_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for depth in np.unique(shared):
        if depth + longest < length or depth == 0:
            continue
        run = np.cumsum(shared < depth)
        branching = np.unique(run[shared == depth])
        inside = np.flatnonzero(np.isin(run, branching)) if len(branching) < run[-1] else np.arange(n)
        inside = inside[np.lexsort((rank[inside], run[inside]))]
        a, b = inside[:-1], inside[1:]
        differ = rows[a] != rows[b]
        l = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        l = np.where(run[a] == run[b], np.minimum(l, np.minimum(size[a], size[b])), 0)
        l = np.maximum(np.append(l, 0), np.append(0, l))  # the better of the two neighbours
        ok = l + depth >= length
        np.maximum.at(found_l, inside[ok], l[ok])
        np.maximum.at(found_r, inside[ok], depth)
    best_l[order], best_r[order] = found_l, found_r
    return best_l, best_r
