"""Small single-machine versions of the definitions, to check the Spark jobs against."""

import functools
import math
import operator
import re

import numpy as np


def chunk(text, low, high, overlap):
    overlap = max(0, min(overlap, low))
    groups, lines = [], []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            lines.append(line.strip())
        elif lines:
            groups.append(" ".join(lines))
            lines = []
    pieces = []
    for group in groups:
        if len(group) <= high:
            pieces.append(group)
            continue
        packed = []
        for s in re.split(r"(?<=[.!?。？！])\s+", group):
            if packed and len(packed[-1]) + 1 + len(s) <= high:
                packed[-1] += " " + s
            else:
                packed.append(s)
        pieces += packed
    out = []
    open_chunk = ""
    for piece in pieces:
        if not open_chunk:
            open_chunk = piece
        elif len(open_chunk) + 1 + len(piece) <= high:
            open_chunk += " " + piece
        else:
            out.append(open_chunk)
            if len(open_chunk) < low:
                open_chunk = piece
                continue
            for tail in (overlap, max(0, high - len(piece) - 1)):
                kept = open_chunk[len(open_chunk) - min(tail, len(open_chunk)):]
                joined = f"{kept} {piece}".strip() if kept else piece
                if len(joined) <= high:
                    break
            open_chunk = joined
    return [*out, open_chunk] if open_chunk else out


def lloyd(vectors, max_clusters, rounds=50):
    """Assignments and squared distances to the final centroids, by plain loops."""
    n = len(vectors)
    k = min(max_clusters, max(1, math.ceil(math.sqrt(n))), n)

    def add(values):  # sum() compensates rounding from Python 3.12 on; a loop does not
        return functools.reduce(operator.add, values, 0.0)

    def gap(a, b):
        return add((x - y) ** 2 for x, y in zip(a, b))

    centres, where = [list(v) for v in vectors[:k]], [0] * n
    for _ in range(rounds):
        new = [min(range(k), key=lambda c: gap(v, centres[c])) for v in vectors]
        if new == where:
            break
        where = new
        for c in range(k):
            own = [v for v, w in zip(vectors, where) if w == c]
            centres[c] = [add(col) / len(own) for col in zip(*own)] if own else list(vectors[c % n])
    return where, [gap(v, centres[w]) for v, w in zip(vectors, where)]


def unique_by_greed(clusters, texts):
    """``clusters``: (id, size, ranked indices). First come, first served, larger clusters first."""
    used, kept = set(), {}
    for c, _, ranked in sorted(clusters, key=lambda c: (-c[1], c[0])):
        for i in ranked:
            t = texts[i].strip()
            if t and t not in used:
                used.add(t)
                kept.setdefault(c, []).append(i)
    return kept


def density(points, least, min_samples):
    """Labels and total tree weight, top-down from the published definition."""
    n = len(points)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.array([np.sort(np.delete(row, i))[min(min_samples, n - 1) - 1] for i, row in enumerate(gaps)])
    reach = np.maximum(np.maximum(core[:, None], core[None]), gaps)
    best, source, done, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        edges.append((float(best[j]), int(source[j]), j))
        done[j] = True
        source[reach[j] < best] = j
        best = np.minimum(best, reach[j])

    least_weight = max((w for w, _, _ in edges), default=1.0) * 1e-12 or 1e-12
    total = sum(w for w, _, _ in edges)
    edges = [(max(w, least_weight), a, b) for w, a, b in edges]

    def parts(nodes, links):
        near = {i: [] for i in nodes}
        for _, a, b in links:
            near[a].append(b)
            near[b].append(a)
        left, out = set(nodes), []
        while left:
            stack, group = [left.pop()], []
            while stack:
                at = stack.pop()
                group.append(at)
                fresh = [x for x in near[at] if x in left]
                left.difference_update(fresh)
                stack += fresh
            out.append(sorted(group))
        return out

    def grow(nodes, links, birth):
        everything, stability = list(nodes), 0.0
        while True:
            longest = max(w for w, _, _ in links)
            links = [e for e in links if e[0] < longest]
            large = [g for g in parts(nodes, links) if len(g) >= least]
            level = 1 / longest
            if len(large) == 1:
                stability += (len(nodes) - len(large[0])) * (level - birth)
                nodes = large[0]
                links = [e for e in links if e[1] in nodes]
                continue
            stability += len(nodes) * (level - birth)
            kids = [grow(g, [e for e in links if e[1] in g], level) for g in large]
            return everything, stability, kids

    def choose(node, root=False):
        nodes, stability, kids = node
        below = [choose(k) for k in kids]
        total = sum(worth for worth, _ in below)
        if not root and stability >= total:
            return stability, [nodes]
        return total, [c for _, chosen in below for c in chosen]

    labels = [-1] * n
    if n >= least:
        for label, nodes in enumerate(sorted(choose(grow(list(range(n)), edges, 0.0), True)[1], key=min)):
            for i in nodes:
                labels[i] = label
    return labels, total
