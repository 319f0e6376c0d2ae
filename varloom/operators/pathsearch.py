"""Search of a neighbourhood's variant graph for the path that explains a haplotype best.

Paths are taken in order of how near their size is to the haplotype's, then scored together: one matrix of
size ratios of all taken paths against all partial forms of the haplotype, and k-mer similarities of the
pairs that pass it.
"""

from __future__ import annotations

import heapq
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np

from ..functions.vectors import distances_of, size_ratios
from ..params import GenotypeParams
from .haplotypes import Haplotype

_CELLS = 1 << 20  # sizes compared at once
_PAIRS = 1 << 12  # feature rows compared at once


class Graph:
    """The variants of a neighbourhood in file order, as columns; variant i is node i + 1."""

    def __init__(self, start, end, size, features):
        self.start, self.end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        self.size = np.asarray(size, np.int64)
        self.features = np.asarray(features, np.float32)

    def __len__(self) -> int:
        return len(self.size)

    def after(self) -> list[np.ndarray]:
        """For each node the later ones it does not overlap; the source, node 0, precedes all."""
        out = [np.arange(1, len(self) + 1)]
        for i in range(len(self)):
            meets = np.maximum(self.start[i], self.start[i + 1 :]) < np.minimum(self.end[i], self.end[i + 1 :])
            out.append(np.flatnonzero(~meets) + i + 2)
        return out

    def path_features(self, paths: list[tuple[int, ...]]) -> np.ndarray:
        member = np.zeros((len(paths), len(self)), np.float32)
        for row, path in zip(member, paths, strict=True):
            row[np.array(path, int) - 1] = 1
        return member @ self.features


class Forms:
    """A haplotype without 0, 1, ... up to fnmax of its parts, as columns; whole only if it has pileupmax parts
    or more, or on request. Features are made for the forms asked for, never for all."""

    def __init__(self, hap: Haplotype, p: GenotypeParams, whole_only: bool = False):
        m = len(hap.parts)
        self._whole = np.asarray(hap.kfeat, np.float32)
        self._parts = np.stack([k for _, k in hap.parts]) if m else np.zeros((0, len(self._whole)), np.float32)
        sizes = np.array([s for s, _ in hap.parts], np.int64)
        out_most = 0 if whole_only or m >= p.pileupmax else min(p.fnmax, m - 1)
        self._left = [np.array(list(combinations(range(m), k)), np.int64).reshape(comb(m, k), k) for k in range(out_most + 1)]
        self.missing = np.repeat(np.arange(out_most + 1), [len(x) for x in self._left])
        self.size = np.concatenate([hap.size - sizes[x].sum(axis=1) for x in self._left])
        self.n = hap.n - self.missing
        self._base = np.cumsum([0] + [len(x) for x in self._left])

    def features(self, forms: np.ndarray) -> np.ndarray:
        out = np.repeat(self._whole[None, :], len(forms), axis=0)
        for row, f in zip(out, forms, strict=True):
            k = self.missing[f]
            row -= self._parts[self._left[k][f - self._base[k]]].sum(axis=0, dtype=np.float32)
        return out


class Match(NamedTuple):
    path: tuple[int, ...]
    score: np.float32
    sizesim: np.float32
    seqsim: np.float32
    whole: bool  # matched the haplotype without leaving out a part


def best_match(graph: Graph, paths: list[tuple[int, ...]], forms: Forms, p: GenotypeParams) -> Match | None:
    """The best of paths, of equal scores the later path and the form that leaves out fewest; None if no path
    is alike enough in sign, size and k-mers, or scores above zero."""
    sizes = np.array([graph.size[np.array(x, int) - 1].sum() if x else 0 for x in paths], np.int64)
    best = None
    step = max(1, _CELLS // len(forms.size))
    for at in range(0, len(paths), step):
        mine = sizes[at : at + step, None]
        ratio = size_ratios(mine, forms.size)
        who, form = np.nonzero((np.sign(mine) == np.sign(forms.size)) & (ratio >= np.float32(p.sizesim)))
        for lo in range(0, len(who), _PAIRS):
            i, j = who[lo : lo + _PAIRS], form[lo : lo + _PAIRS]
            u, iu = np.unique(i, return_inverse=True)
            v, jv = np.unique(j, return_inverse=True)
            mine_k, theirs_k = graph.path_features([paths[at + x] for x in u]), forms.features(v)
            seqsim = np.float32(1) - distances_of(mine_k[iu], theirs_k[jv], p.minkfreq)
            length = np.array([len(paths[at + x]) for x in i])
            extra = length - 1 if p.squish else np.abs(forms.n[j] - length)
            sizesim = ratio[i, j]
            score = (seqsim + sizesim) / np.float32(2) - np.float32(p.fpenalty) * forms.missing[j].astype(np.float32) - np.float32(p.gpenalty) * extra.astype(np.float32)
            score[seqsim < np.float32(p.seqsim)] = 0
            top = score.max()
            if top <= 0 or best is not None and top < best.score:
                continue
            late = i[score == top].max()
            k = int(np.flatnonzero((score == top) & (i == late))[0])
            path = paths[at + int(late)]
            if best is None or top > best.score or path != best.path:
                best = Match(path, score[k], sizesim[k], seqsim[k], bool(forms.missing[j[k]] == 0))
    return best


def nearest_paths(graph: Graph, after: list[np.ndarray], size: int, most: int) -> list[tuple[int, ...]]:
    """Up to `most` paths from source to sink, each taken as the nearest in size among the known ones; every node
    leads to the sink. Equal distances go to the shorter, then the smaller path."""
    out: list[tuple[int, ...]] = []
    known: list[tuple[int, int, tuple[int, ...], int]] = [(abs(size), 0, (), 0)]
    while known and len(out) < most:
        _, length, path, total = heapq.heappop(known)
        out.append(path)
        ends = after[path[-1] if path else 0]
        for i, t in zip(ends.tolist(), (total + graph.size[ends - 1]).tolist(), strict=True):
            heapq.heappush(known, (abs(size - t), length + 1, (*path, i), t))
    return out


def paths_of(graph: Graph, haps: list[Haplotype], p: GenotypeParams) -> list[dict]:
    """A path for each haplotype that has one, ordered by haplotype tag: 2, none, 1.

    The whole graph is searched, but for one_to_one and for more than maxnodes variants: then single variants
    are held against whole haplotypes. maxpaths + 1 paths are scored.
    """
    whole_graph = bool(haps) and not p.one_to_one and len(graph) <= p.maxnodes
    after = graph.after() if whole_graph else []
    found = []
    for hap in haps:
        paths = nearest_paths(graph, after, hap.size, p.maxpaths + 1) if whole_graph else [(i + 1,) for i in range(len(graph))]
        match = best_match(graph, paths, Forms(hap, p, whole_only=not whole_graph), p) if paths else None
        if match is None or not whole_graph and match.seqsim <= 0:
            continue
        found.append({
            "score": float(match.score), "sizesim": float(match.sizesim), "seqsim": float(match.seqsim), "path": list(match.path), "full_target": match.whole,
            "coverage": int(hap.coverage), "ps": hap.ps, "hp": hap.hp,
        })
    return sorted(found, key=lambda f: {2: 0, None: 1}.get(f["hp"], 2))
