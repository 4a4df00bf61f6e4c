"""Cuboids that cover a list of workloads: wider marginals that are counted once
and rolled up to the workloads within them.

A cuboid has one cell more than the domain on each axis, for codes that are
missing or outside: a row with such a code in one attribute still counts in the
workloads without that attribute.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np

from .workload import Workload

#: Cells of a cuboid that holds several workloads, at most.
MOST = 1 << 15
#: Workloads up to which cuboids are searched for.
SEARCHED = 4096
#: Passes that are few enough to keep cuboids wide.
FEW = 2


@dataclass(frozen=True)
class Cuboid:
    attrs: tuple[str, ...]
    sizes: tuple[int, ...]
    children: tuple[Workload, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(n + 1 for n in self.sizes)

    @property
    def n_cells(self) -> int:
        return prod(self.shape)

    def cells(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        """Each row's cell, from codes with -1 for missing ones."""
        at = np.zeros(len(next(iter(codes.values()))) if codes else 0, np.int64)
        for a, n in zip(self.attrs, self.sizes):
            own = codes[a]
            at = at * (n + 1) + np.where((own < 0) | (own >= n), n, own)
        return at

    def _axes(self, child: Workload) -> list[int]:
        return [self.attrs.index(a) for a in child.attrs]

    def rolled(self, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query ids, sums) of each workload, from the sums of all cells."""
        whole = table.reshape(self.shape)
        for w in self.children:
            axes = self._axes(w)
            order = sorted(axes)
            part = whole.sum(axis=tuple(k for k in range(len(self.attrs)) if k not in axes))
            part = part.transpose([order.index(k) for k in axes])[tuple(slice(n) for n in w.sizes)].ravel()
            met = np.flatnonzero(part)
            yield met + w.offset, part[met]

    def rolled_some(self, cells: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same from some of the cells."""
        codes = np.unravel_index(cells, self.shape)
        for w in self.children:
            own = [codes[k] for k in self._axes(w)]
            ok = np.logical_and.reduce([c < n for c, n in zip(own, w.sizes)]) if own else np.ones(len(cells), bool)
            at = np.zeros(int(ok.sum()), np.int64)
            for c, n in zip(own, w.sizes):
                at = at * n + c[ok]
            found, place = np.unique(at, return_inverse=True)
            if len(found):
                yield found + w.offset, np.bincount(place, sums[ok], minlength=len(found))


def cover(workloads: Sequence[Workload], most: int = MOST) -> list[Cuboid]:
    """Cuboids of at most ``most`` cells, or of one workload's own, such that each
    workload lies in one.  From the largest workload left, attributes are added
    while that brings further workloads in, the one that brings most first."""
    size = {a: n for w in workloads for a, n in zip(w.attrs, w.sizes)}
    names = sorted(size)
    place, extent = {a: k for k, a in enumerate(names)}, np.array([size[a] + 1 for a in names])
    has = np.zeros((len(workloads), len(names)), np.float32)
    for k, w in enumerate(workloads):
        has[k, [place[a] for a in w.attrs]] = 1
    left = np.array(sorted(range(len(workloads)), key=lambda k: -workloads[k].n_cells), int)
    rest, out = has[left], []
    while len(left):
        own = rest[0] > 0
        lack = rest @ (~own).astype(np.float32)
        cells = int(np.prod(extent[own], dtype=object)) if own.any() else 1
        while len(names):
            gain = np.stack([lack == 1, lack == 2]).astype(np.float32) @ rest
            gain = gain[0] + gain[1] / 100
            gain[own | (extent * cells > most)] = 0
            if gain.max() <= 0:
                break
            best = int(np.lexsort((extent, -gain))[0])
            own[best], cells = True, cells * int(extent[best])
            lack -= rest[:, best]
        inside = lack < 0.5
        used = rest[inside].any(axis=0)
        attrs = tuple(a for a in names if used[place[a]])
        out.append(Cuboid(attrs, tuple(size[a] for a in attrs), tuple(workloads[k] for k in sorted(left[inside]))))
        left, rest = left[~inside], rest[~inside]
    return out


def by_blocks(workloads: Sequence[Workload], most: int = MOST) -> list[Cuboid]:
    """The same for long lists, by one look at each workload: attributes are put
    into blocks of a small product, and workloads that touch the same blocks meet."""
    size = {a: n for w in workloads for a, n in zip(w.attrs, w.sizes)}
    usual = max(1, round(sum(len(w.attrs) for w in workloads) / max(1, len(workloads))))
    room, block, at, cells = most ** (1 / usual), {}, 0, 1
    for a in sorted(size, key=lambda a: (size[a], a)):
        if cells > 1 and cells * (size[a] + 1) > room:
            at, cells = at + 1, 1
        block[a], cells = at, cells * (size[a] + 1)
    met: dict[tuple[int, ...], list[Workload]] = {}
    for w in workloads:
        met.setdefault(tuple(sorted({block[a] for a in w.attrs})), []).append(w)
    out = []
    for own in met.values():
        attrs = tuple(sorted({a for w in own for a in w.attrs}))
        whole = Cuboid(attrs, tuple(size[a] for a in attrs), tuple(own))
        out += [whole] if whole.n_cells <= most else [Cuboid(w.attrs, w.sizes, (w,)) for w in own]
    return out


def passes(cuboids: Sequence[Cuboid], cells: int) -> list[list[Cuboid]]:
    """Cuboids that are counted together, of at most so many cells but for single
    ones: the largest first, each where it still fits."""
    out: list[list[Cuboid]] = []
    room: list[int] = []
    for c in sorted(cuboids, key=lambda c: -c.n_cells):
        k = next((k for k, r in enumerate(room) if r >= c.n_cells), None)
        if k is None:
            out.append([])
            room.append(cells)
            k = len(out) - 1
        out[k].append(c)
        room[k] -= c.n_cells
    return out


def plan(workloads: Sequence[Workload], cells: int, most: int = MOST) -> list[list[Cuboid]]:
    """Passes over cuboids of at most so many cells together.  Wide cuboids save
    work for each row, narrow ones cells, so they are as wide as takes no more
    passes than the workloads by themselves, or than FEW."""
    alone = passes([Cuboid(w.attrs, w.sizes, (w,)) for w in workloads], cells)
    while most >= 64:
        found = passes((cover if len(workloads) <= SEARCHED else by_blocks)(workloads, most), cells)
        if len(found) <= max(FEW, len(alone)):
            return found
        most //= 8
    return alone
