"""Many small graphs at a time in a task: rows of edges, sorted by group, are taken in whole groups through
array steps. Nodes are numbered in the byte order of their names within their group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges after which the groups gathered so far are solved.
CHUNK = 200_000


class Graphs:
    """Graphs of a chunk: `group` and `name` (index in `names`) of each node, edges both ways (`x`, `y`, `w`) sorted by x and then y."""

    def __init__(self, group: np.ndarray, x: pa.Array, row: np.ndarray, y: pa.Array, w: np.ndarray):
        """An edge from `x[row]` to each `y`."""
        if x.type != y.type:
            x, y = x.cast(pa.string()), y.cast(pa.string())
        both = pa.concat_arrays([x, y]).dictionary_encode()
        names, codes = both.dictionary.cast(pa.string()), both.indices.to_numpy()
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.names, s = names.take(pa.array(order)), max(len(order), 1)
        nodes, at = np.unique(np.concatenate([group, group]) * s + rank[np.concatenate([codes[row], codes[len(x) :]])], return_inverse=True)
        self.n, self.group, self.name = len(nodes), nodes // s, nodes % s
        #: The node of each edge's x, as the rows came.
        self.at, other = at[: len(y)], at[len(y) :]
        self.x, self.y, self.w = _summed(np.concatenate([self.at, other]), np.concatenate([other, self.at]), np.concatenate([w, w]), self.n)
        real = (self.x != self.y) & (self.w > 0)
        if not real.all():
            self.x, self.y, self.w = self.x[real], self.y[real], self.w[real]
        self.n_groups = int(self.group[-1]) + 1 if self.n else 0
        self.present = np.bincount(self.x, minlength=self.n) > 0


def _summed(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in order, each once, with the sum of its weights."""
    key = x * n + y
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    key = key[first]
    return key // max(n, 1), key % max(n, 1), np.add.reduceat(w[order], first) if len(first) else np.empty(0)


def _round9(x: np.ndarray) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e9 + 0.5) / 1e9, x)


def _moves(x, y, w, k, present, total, moving: np.ndarray, steps: int) -> np.ndarray:
    """The label of each node after all steps; `total` is that of the node's group, `moving` has the digits of the nodes' hashes."""
    n = len(k)
    label = np.arange(n)
    for step in range(steps):
        now = ((moving >> (4 * (7 - step))) & 15) % 3 == 0
        kc = np.bincount(label, k, n)
        near, own = np.flatnonzero(now[x]), np.flatnonzero(now & present)
        if not len(own):
            continue
        node, to, weight = _summed(np.concatenate([x[near], own]), np.concatenate([label[y[near]], label[own]]), np.concatenate([w[near], np.zeros(len(own))]), n)
        stays = to == label[node]
        gain = _round9(weight - k[node] * (kc[to] - np.where(stays, k[node], 0.0)) / total[node])
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        best = gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(node))))
        mover, lowest = node[first], np.minimum.reduceat(np.where(best, to, n), first)
        label[mover] = np.where(np.logical_or.reduceat(best & stays, first), label[mover], lowest)
    return label


def communities(steps: int, levels: int, degrees: bool = False, lag: int | None = None) -> Callable:
    """For `solver` (SIZES): label, size of the community, communities and nodes of the group, its modularity. With `degrees`
    (DEGREES) of a graph of two sides also the degrees, each less one, of the node's neighbours together, its own degree, the squared
    degrees of the side that isn't listed, and the number of that side's nodes. With `lag` also the mean `pos` of the community's nodes of that age or more (null without any)."""

    def solve(g: Graphs, listed: np.ndarray) -> list[pa.Array | np.ndarray]:
        k, group_total = np.bincount(g.x, g.w, g.n), np.bincount(g.group[g.x], g.w, g.n_groups)
        total = group_total[g.group]
        digits = np.array([int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in g.names.to_pylist()], np.int64)
        moving = digits[g.name]
        found = _moves(g.x, g.y, g.w, k, g.present, total, moving, steps)
        for _ in range(levels - 1):
            lx, ly = found[g.x], found[g.y]
            apart = lx != ly
            there = np.zeros(g.n, bool)
            there[found[g.present]] = True
            found = _moves(*_summed(lx[apart], ly[apart], g.w[apart], g.n), np.bincount(found, k, g.n), there, total, moving, steps)[found]
        size = np.bincount(found[listed], minlength=g.n)
        n_comms, n_nodes = np.bincount(g.group[size > 0], minlength=g.n_groups), np.bincount(g.group[listed], minlength=g.n_groups)
        inside = np.bincount(g.group[g.x], np.where(found[g.x] == found[g.y], g.w, 0.0), g.n_groups)
        kc = np.bincount(found, k, g.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            quality = inside / group_total - np.bincount(g.group, kc * kc, g.n_groups) / (group_total * group_total)
        at = g.group[listed]
        out = [g.names.take(pa.array(g.name[found[listed]])), size[found[listed]], n_comms[at], n_nodes[at], quality[at]]
        if degrees:
            held = np.ones(g.n, bool)
            held[listed] = False
            other = np.flatnonzero(held & g.present)
            shared = np.bincount(g.x, k[g.y] - 1, g.n)
            out += [shared[listed], k[listed], np.bincount(g.group[other], k[other] ** 2, g.n_groups)[at], np.bincount(g.group[other], minlength=g.n_groups)[at].astype(float)]
        if lag is not None:
            label, old = found[listed], g.age >= lag
            with np.errstate(invalid="ignore"):
                out.append((np.bincount(label[old], g.pos[old], g.n) / np.bincount(label[old], minlength=g.n))[label])
        return out

    return solve


def _lowest(g: Graphs) -> np.ndarray:
    low = np.arange(g.n)
    first = np.flatnonzero(np.concatenate([[True], g.x[1:] != g.x[:-1]])) if len(g.x) else np.empty(0, np.int64)
    while len(first):
        new = low.copy()
        new[g.x[first]] = np.minimum(low[g.x[first]], np.minimum.reduceat(low[g.y], first))
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def components(g: Graphs, listed: np.ndarray) -> list[pa.Array]:
    """For `solver`: the lowest node of the component."""
    return [g.names.take(pa.array(g.name[_lowest(g)[listed]]))]


def component_counts(g: Graphs, listed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For `solver` (COUNTS): a row for each group, with its components and its nodes of either side."""
    low = _lowest(g)
    group, root, left = (np.bincount(g.group[n], minlength=g.n_groups) for n in (listed, listed[low[listed] == listed], listed[g.left[listed]]))
    row = listed[np.unique(g.group[listed], return_index=True)[1]]
    at = g.group[row]
    return row, [root[at], left[at], (group - left)[at]]


SIZES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
DEGREES = [pa.float64()] * 4
LOWEST = [pa.string()]
COUNTS = [pa.int64()] * 3


def solver(solve: Callable, kinds: list[pa.DataType], n_group: int, n_carry: int, weighted: bool, side: bool, most: int, widths: tuple[int, ...] = (), at: tuple[int, ...] = (0, 0), lag: int | None = None, now: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of the group's keys, the carried columns, x, y (or an array of them) and w, sorted by the
    keys: the keys, the carried columns and the node with what `solve` gives (of `kinds`), and nulls for x, y, w; rows of groups of
    more than `most` edges come back with x, y and w, and nulls for the rest. With `widths` a group has a graph for each, of the
    rows less than the width before it by the two columns `at`, and what `solve` gives is followed by the width.
    With `lag` only rows of equal columns `at` are given, but `solve` finds the difference and the third column `at` of all listed
    nodes in `age` and `pos`. With `now` only rows of equal columns `at` are given. `solve` may give the nodes to list with what it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        edges, passing = 0, None

        def keys(t: pa.Table, i: int) -> tuple:
            return tuple(t.column(j)[i].as_py() for j in range(n_group))

        def starts(t: pa.Table) -> np.ndarray:
            new = np.zeros(max(t.num_rows - 1, 0), bool)
            for j in range(n_group):
                c = t.column(j).combine_chunks()
                c = c.dictionary_encode().indices if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c
                c = c.to_numpy(zero_copy_only=False)
                new |= c[1:] != c[:-1]
            return np.concatenate([[0], np.flatnonzero(new) + 1])

        def size(t: pa.Table) -> int:
            y = t.column(n_group + n_carry + 1)
            n = (pc.sum(pc.list_value_length(y)).as_py() or 0) if pa.types.is_list(y.type) else t.num_rows
            return n * max(len(widths), 1)

        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            first = starts(t)
            of_row = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
            x, y, w = (t.column(n_group + n_carry + i).combine_chunks() for i in range(3))
            row = np.arange(t.num_rows)
            if pa.types.is_list(y.type):
                row, y = np.repeat(row, pc.list_value_length(y).fill_null(0).to_numpy()), y.flatten()
            if y.null_count:
                there = y.is_valid().to_numpy(zero_copy_only=False)
                row, y = row[there], y.drop_null()
            weights = w.fill_null(0.0).to_numpy()[row] if weighted else np.ones(len(row))
            group, n = of_row[row], max(len(widths), 1)
            if widths:
                look, year = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in at[:2])
                parts = [np.flatnonzero((look - year)[row] < width) for width in widths]
                edge = np.concatenate(parts)
                group = group[edge] * n + np.repeat(np.arange(n), [len(x) for x in parts])
                row, y, weights = row[edge], y.take(pa.array(edge)), weights[edge]
            if not len(row):
                return
            g = Graphs(group, x, row, y, weights)
            source = np.full(g.n, -1)
            source[g.at[::-1]] = row[::-1]
            listed = np.flatnonzero(g.present & (source >= 0) if side else g.present)
            if not len(listed):
                return
            g.left = source >= 0
            if lag is not None or now:
                look, year = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False)[source[listed]] for i in at[:2])
                current = np.flatnonzero(look == year)
                if not len(current):
                    return
            if lag is not None:
                g.age, g.pos = look - year, t.column(at[2]).combine_chunks().to_numpy(zero_copy_only=False)[source[listed]].astype(float)
            made = solve(g, listed)
            if isinstance(made, tuple):
                listed, made = made
            made = [c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in made]
            if lag is not None or now:
                listed, made = listed[current], [c.take(pa.array(current)) for c in made]
            names = g.names.take(pa.array(g.name[listed]))
            rows = pa.array(source[listed] if side else first[g.group[listed] // n])
            columns = [t.column(j).take(rows).combine_chunks() for j in range(n_group + n_carry)] + [names]
            columns += made
            if widths:
                columns.append(pa.array(np.array(widths, np.int32)[g.group[listed] % n]))
            yield from out(columns + [pa.nulls(len(listed), c.type) for c in (t.schema.field(n_group + n_carry + i) for i in range(3))])

        def out(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]).to_batches(max_chunksize=50_000)

        def unsolved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            head = [c.combine_chunks() for c in t.columns[: n_group + n_carry]]
            blank = [pa.nulls(t.num_rows, k) for k in [pa.string(), *kinds, *[pa.int32()] * bool(widths)]]
            yield from out(head + blank + [c.combine_chunks() for c in t.columns[n_group + n_carry :]])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if passing is not None:
                first = starts(t)
                if keys(t, 0) == passing:
                    n = int(first[1]) if len(first) > 1 else t.num_rows
                    yield from unsolved(t.slice(0, n))
                    t = t.slice(n)
                if not t.num_rows:
                    continue
                passing = None
            kept.append(t)
            edges += size(t)
            if edges >= min(CHUNK, most + 1):
                whole = pa.concat_tables(kept).combine_chunks()
                last = int(starts(whole)[-1])
                if last:
                    yield from solved(whole.slice(0, last))
                kept, rest = [whole.slice(last)], whole.slice(last)
                edges = size(rest)
                if edges > most:
                    yield from unsolved(rest)
                    kept, edges, passing = [], 0, keys(rest, 0)
        if kept and edges:
            whole = pa.concat_tables(kept).combine_chunks()
            yield from solved(whole)

    return run
