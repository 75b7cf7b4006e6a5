"""Topological thinning to skeletons or medial surfaces.

Blocks with a halo are thinned in numpy: six border directions in turn, eight parity subfields in each, simple points
re-examined in their subfield. Passes repeat until nothing changes anywhere; only blocks near a change run again.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from stratavox.plans.checkpoints import cut, drop

from .blockstate import State, roomy
from .volume import XYZ, Block, Grid

_PLACES = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
_DIRECTIONS = [(0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0)]


def _mask(keep) -> int:
    return sum(1 << k for k, p in enumerate(_PLACES) if keep(p))


_CENTRE = _mask(lambda p: p == (0, 0, 0))
_FACES = _mask(lambda p: sum(map(abs, p)) == 1)
_NEAREST_18 = _mask(lambda p: 0 < sum(map(abs, p)) <= 2)
_BY_FACE = [_mask(lambda q, p=p: sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1) for p in _PLACES]
_BY_ANY = [_mask(lambda q, p=p: max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1) for p in _PLACES]
_OCTANTS = [(sx, sy, sz) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)]
_OCTANT = [_mask(lambda p, s=s: all(c * d >= 0 for c, d in zip(p, s, strict=True))) for s in _OCTANTS]
#: Flat sheets of four voxels through the centre, by octant: on an axis plane, or on a diagonal plane.
_SHEETS = [
    {_mask(lambda p, s=s, m=m, a=a: m >> _PLACES.index(p) & 1 and p[a] == 0) for a in range(3)} | {_mask(lambda p, s=s, m=m, a=a, b=b: m >> _PLACES.index(p) & 1 and abs(p[a]) == abs(p[b])) for a in range(3) for b in range(a)}
    for s, m in zip(_OCTANTS, _OCTANT, strict=True)
]


def _part(seed: int, within: int, near: list[int]) -> int:
    """All of within that is connected to the seed."""
    part, edge = seed, seed
    while edge:
        k = (edge & -edge).bit_length() - 1
        edge &= edge - 1
        new = near[k] & within & ~part
        part |= new
        edge |= new
    return part


@lru_cache(maxsize=1 << 18)
def is_simple(code: int) -> bool:
    """Whether removing the centre keeps topology: one object part around it, and one background part among the faces within the 18 nearest."""
    around = code & ~_CENTRE
    if not around or _part(around & -around, around, _BY_ANY) != around:
        return False
    empty = ~code & _NEAREST_18
    faces = empty & _FACES
    return bool(faces) and _part(faces & -faces, empty, _BY_FACE) & faces == faces


@lru_cache(maxsize=1 << 18)
def is_end(code: int, surface: bool) -> bool:
    """An end point of a curve has one neighbour; that of a surface has in each octant under four voxels, itself included, or a flat sheet."""
    if not surface:
        return (code & ~_CENTRE).bit_count() == 1
    for octant, sheets in zip(_OCTANT, _SHEETS, strict=True):
        own = (code | _CENTRE) & octant
        if own.bit_count() > 4 or own.bit_count() == 4 and own not in sheets:
            return False
    return True


def _deletable(codes: np.ndarray, surface: bool) -> np.ndarray:
    """Which neighbourhoods let their centre go; each different one is judged once."""
    different, which = np.unique(codes, return_inverse=True)
    return np.array([not is_end(c, surface) and is_simple(c) for c in different.tolist()], bool)[which]


def thin_pass(label: np.ndarray, corner: tuple[int, int, int], surface: bool) -> np.ndarray:
    """One pass over a dense array; labels are thinned apart from each other. Parity counts in the volume's coordinates."""
    out = np.pad(label, 1)
    weights = 1 << np.arange(27)
    for d in _DIRECTIONS:
        inner = out[1:-1, 1:-1, 1:-1]
        ahead = out[tuple(slice(1 + a, n - 1 + a) for a, n in zip(d, out.shape, strict=True))]
        border = np.argwhere((inner != 0) & (ahead != inner))
        parity = ((border + np.array(corner)) % 2) @ [1, 2, 4]
        for field in range(8):
            at = border[parity == field]
            if not len(at):
                continue
            own = inner[tuple(at.T)]
            near = np.stack([out[tuple((at + 1 + p).T)] == own for p in _PLACES], 1)
            # voxels of one subfield aren't neighbours, so all may go at once
            gone = at[_deletable(near @ weights, surface)]
            out[tuple((gone + 1).T)] = 0
    return out[1:-1, 1:-1, 1:-1]


#: A voxel depends on others up to so many places away in one pass: six directions of two parities.
REACH = 12


def thinned(volume: DataFrame, grid: Grid, surface: bool = False) -> State:
    """The blocks after thinning; ``passes`` says how many each pass has run."""

    def kernel(b: Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
        done = thin_pass(b["v"], b.corner, surface)
        return {"v": done}, done != b["v"]

    state = State(volume.where("v > 0").select(*XYZ, "v"), roomy(grid, REACH), {"v": np.int64})
    active = cut(state.all_keys())
    while not active.isEmpty():
        woken = state.run(REACH, kernel, active)
        drop(active)
        active = woken
    return state


def thin(volume: DataFrame, grid: Grid, surface: bool = False) -> DataFrame:
    """The skeleton, or with surface the medial surface, of each object: passes until none changes anything.

    A block runs again only if it changed in the last pass or a neighbour did within its reach. Blocks that are finished, or whose neighbours' near sides are, are neither read as targets nor written.
    """
    return thinned(volume, grid, surface).rows(lambda a: a["v"] > 0, "x long, y long, z long, v long")
