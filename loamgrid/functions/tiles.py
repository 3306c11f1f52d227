"""Covers of polygons by square tiles of several sizes, worked out for whole batches.

Tiles of one level are ``cell * FACTOR ** level`` wide; a tile holds its lower and
left sides and lists the edges that touch it or its right side. A cover begins with
few large tiles and cuts those that an edge passes through, so it grows with the
border of a polygon and not with its area: a tile without an edge is wholly inside,
and listed as such, or wholly outside, and left out.

Whether a point of a tile is inside follows from the tile's own edges: from the
tile's lower right corner, where it is known, a path leads up the right side to the
point's height and then left to the point; each edge that it crosses changes
sides. The path runs a hair above the point and a smaller hair right of the tile,
so it meets no vertex, and every comparison is the sign of one turn: exact for
whole coordinates, and never at odds with itself for others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .geometry import Shapes

#: Tiles of one level along the side of a tile of the next.
FACTOR = 8
#: Tiles of the first level that a polygon's box may hold.
_FIRST = 1024
#: Pairs of edges and corners looked at in one step.
_STEP = 1 << 20


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): whose each place is (0, 0, 2, 2, 2), and the how-manieth there (0, 1, 0, 1, 2)."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _whole(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def edge_tiles(e: np.ndarray, side: float, within: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which edge, column and row of every tile that an edge touches; ``within``: least and greatest column and row for each edge.

    Edges go up (y1 <= y2). Along each row of tiles the edge's x range decides;
    a few last digits more than the range do no harm.
    """
    first, last = _whole(np.floor(e[:, 1] / side)), _whole(np.floor(e[:, 3] / side))
    if within:
        first, last = np.maximum(first, within[2]), np.minimum(last, within[3])
    which, nth = spread(np.maximum(0, last - first + 1))
    iy = first[which] + nth
    x1, y1, x2, y2 = e[which].T
    rate = (x2 - x1) / np.where(y2 > y1, y2 - y1, 1)
    at = lambda y: x1 + (np.clip(y, y1, y2) - y1) * rate
    a, b = np.where(y2 > y1, at(iy * side), x1), np.where(y2 > y1, at((iy + 1) * side), x2)
    more = 8 * np.spacing(np.maximum(np.abs(x1), np.abs(x2)))
    left = np.maximum(np.minimum(a, b) - more, np.minimum(x1, x2))
    right = np.minimum(np.maximum(a, b) + more, np.maximum(x1, x2))
    first, last = _whole(np.ceil(left / side)) - 1, _whole(np.floor(right / side))
    if within:
        first, last = np.maximum(first, within[0][which]), np.minimum(last, within[1][which])
    again, nth = spread(np.maximum(0, last - first + 1))
    return which[again], first[again] + nth, iy[again]


def crossings(e: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, corner: bool = False) -> np.ndarray:
    """Whether the path from above the right side's foot to (x, y) crosses each edge an odd number of times.

    The edges below the foot count too: what is known there has them taken off.
    ``corner``: the point itself lies the smaller hair right of x.
    """
    x1, y1, x2, y2 = e.T
    dx, dy = x2 - x1, y2 - y1
    turn = dx * (y - y1) - (x - x1) * dy
    beyond = (y1 <= y) & (y < y2) & ((turn > 0) | (turn == 0) & (dx > 0) if corner else turn > 0)
    reach, below = below_right(e, right, y)
    return np.where(reach, below ^ (beyond & (below ^ (dx > 0))), beyond & (np.maximum(x1, x2) <= right))


def below_right(e: np.ndarray, right: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each edge crosses the line x = right, and whether it does so at y or lower."""
    x1, y1, x2, y2 = e.T
    reach = (x1 > right) != (x2 > right)
    turn = (x2 - x1) * (y - y1) - (right - x1) * (y2 - y1)
    return reach, reach & np.where(x2 > x1, turn >= 0, turn <= 0)


def on_edge(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = e.T
    flat = (x2 - x1) * (y - y1) == (x - x1) * (y2 - y1)
    return flat & (y1 <= y) & (y <= y2) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2))


def _odd(rows: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows whether an odd number of its flags is set."""
    return np.bincount(rows[flags], minlength=n) % 2 == 1


@dataclass
class Tiles:
    """Tiles of one level: owner, column, row, whether the right side's foot is inside, and (tile, edge) in tile order."""

    owner: np.ndarray
    ix: np.ndarray
    iy: np.ndarray
    foot: np.ndarray
    tile: np.ndarray
    edge: np.ndarray

    def __len__(self) -> int:
        return len(self.owner)

    def pick(self, keep: np.ndarray) -> Tiles:
        place = np.cumsum(keep) - 1
        on = keep[self.tile]
        return Tiles(self.owner[keep], self.ix[keep], self.iy[keep], self.foot[keep], place[self.tile[on]], self.edge[on])


def _grouped(owner, ix, iy, edge) -> Tiles:
    """Incidences gathered to tiles; nothing is known of their feet yet."""
    order = np.lexsort((edge, ix, iy, owner))
    owner, ix, iy, edge = owner[order], ix[order], iy[order], edge[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(ix) != 0) | (np.diff(iy) != 0)
    return Tiles(owner[new], ix[new], iy[new], np.zeros(int(new.sum()), bool), np.cumsum(new) - 1, edge)


def _joined(a: Tiles | None, b: Tiles) -> Tiles:
    if a is None:
        return b
    both = [np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("owner", "ix", "iy", "foot")]
    return Tiles(*both, np.concatenate([a.tile, b.tile + len(a)]), np.concatenate([a.edge, b.edge]))


class Cover:
    """The cover of a batch of shapes, level by level.

    ``inner[level]`` is (owner, ix, iy) of tiles wholly inside; ``border[level]``
    the tiles with edges. Levels above 0 have no border; below 0 are only the
    parts of tiles with more than ``most`` edges, down to ``deepest``.
    """

    def __init__(self, shapes: Shapes, cell: float, most: int = 16, deepest: int = -2):
        e, owner, sign = shapes.edges()
        there = (e[:, :2] != e[:, 2:]).any(1)
        e, owner, sign = e[there], owner[there], -sign[there]  # 1: the inside lies to the left of the way along the edge
        down = e[:, 1] > e[:, 3]
        #: +1 where the inside lies above an edge, -1 below; and +1 where it lies to the left of an upward edge.
        self.above, self.left = sign * np.sign(e[:, 2] - e[:, 0]), sign * np.sign(e[:, 3] - e[:, 1])
        self.edges, self.owner, self.cell = np.where(down[:, None], e[:, [2, 3, 0, 1]], e), owner, float(cell)
        self.inner: dict[int, tuple] = {}
        self.border: dict[int, Tiles] = {}
        start = self._start(len(shapes))
        open_, level = None, int(start.max(initial=0))
        while level >= deepest:
            tiles = open_
            if level >= 0 and (start[self.owner] == level).any():
                tiles = _joined(tiles, self._first(level, np.flatnonzero(start[self.owner] == level)))
            open_ = None
            if tiles is not None and len(tiles):
                dense = np.bincount(tiles.tile, minlength=len(tiles)) > most
                split = np.ones(len(tiles), bool) if level > 0 else dense & (level > deepest)
                if not split.all():
                    self.border[level] = tiles.pick(~split)
                if split.any():
                    open_ = self._children(level, tiles.pick(split))
            level -= 1

    def side(self, level: int) -> float:
        return self.cell * float(FACTOR) ** level

    def _inside(self, level: int, owner, ix, iy) -> None:
        if len(owner):
            old = self.inner.get(level, (np.zeros(0, np.int64),) * 3)
            self.inner[level] = tuple(np.concatenate([a, b]) for a, b in zip(old, (owner, ix, iy)))

    def _start(self, n: int) -> np.ndarray:
        """The level at which each shape's box holds few tiles."""
        low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        for k in (0, 2):
            np.minimum.at(low, self.owner, self.edges[:, k : k + 2])
            np.maximum.at(high, self.owner, self.edges[:, k : k + 2])
        self.boxes = np.hstack([low, high])
        wide = np.where(high >= low, high - low, 0) / self.cell
        level = np.zeros(n, int)
        while (big := ((wide[:, 0] / float(FACTOR) ** level + 2) * (wide[:, 1] / float(FACTOR) ** level + 2) > _FIRST) & (level < 12)).any():
            level[big] += 1
        return level

    def _first(self, level: int, edges: np.ndarray) -> Tiles:
        """Border tiles of whole shapes, their feet by the edges right of them at the same height; tiles between are inside."""
        side, e, owner = self.side(level), self.edges[edges], self.owner[edges]
        which, ix, iy = edge_tiles(e, side)
        tiles = _grouped(owner[which], ix, iy, edges[which])
        # every edge that crosses the foot line of a row of tiles, and the last column whose foot lies left of it
        low, high = _whole(np.ceil(e[:, 1] / side)), _whole(np.ceil(e[:, 3] / side)) - 1
        cut, nth = spread(np.maximum(0, high - low + 1))
        row = low[cut] + nth
        x1, y1, x2, y2 = e[cut].T
        y = row * side
        column = _whole(np.floor((x1 + (y - y1) * (x2 - x1) / (y2 - y1)) / side)) - 1

        def left_of(c):
            turn = (x2 - x1) * (y - y1) - ((c + 1) * side - x1) * (y2 - y1)
            return (turn > 0) | (turn == 0) & (x2 > x1)

        column = np.where(left_of(column + 1), column + 1, np.where(left_of(column), column, column - 1))
        lines, line = np.unique(np.stack([owner[cut], row], 1), axis=0, return_inverse=True)
        line = line.reshape(-1)
        base, room = int(column.min(initial=0)) - 2, int(column.max(initial=0) - column.min(initial=0)) + 4
        marks = np.sort(line * room + column - base)
        # feet of the border tiles: how many edges lie right of them
        of = {tuple(k): i for i, k in enumerate(lines.tolist())}
        own = np.array([of.get(k, -1) for k in zip(tiles.owner.tolist(), tiles.iy.tolist())], np.int64)
        last = np.searchsorted(marks, (own + 1) * room)
        right = last - np.searchsorted(marks, own * room + np.clip(tiles.ix - base, 0, room - 1))
        tiles.foot = (own >= 0) & (right % 2 == 1)
        # between two edges of a row, second and first from the right and so on, lies the inside
        ends = marks.reshape(-1, 2) if len(marks) % 2 == 0 else np.zeros((0, 2), np.int64)
        n = ends[:, 1] - ends[:, 0]
        run, nth = spread(n)
        mark = ends[run, 0] + 1 + nth
        at, c = lines[mark // room], mark % room + base
        edge_keys = {*zip(tiles.owner.tolist(), tiles.ix.tolist(), tiles.iy.tolist())}
        inside = np.array([k not in edge_keys for k in zip(at[:, 0].tolist(), c.tolist(), at[:, 1].tolist())], bool)
        self._inside(level, at[inside, 0], c[inside], at[inside, 1])
        return tiles

    def known(self, tiles: Tiles, side: float) -> np.ndarray:
        """What is known at each tile's foot, with the edges below it taken off."""
        reach, below = below_right(self.edges[tiles.edge], (tiles.ix[tiles.tile] + 1) * side, tiles.iy[tiles.tile] * side)
        return tiles.foot ^ _odd(tiles.tile, below, len(tiles))

    def _children(self, level: int, tiles: Tiles) -> Tiles:
        """The border tiles of the next level within ``tiles``; those without an edge are inside or go."""
        side, small = self.side(level), self.side(level - 1)
        columns, rows = tiles.ix[tiles.tile] * FACTOR, tiles.iy[tiles.tile] * FACTOR
        which, ix, iy = edge_tiles(self.edges[tiles.edge], small, (columns, columns + FACTOR - 1, rows, rows + FACTOR - 1))
        known, n = self.known(tiles, side), FACTOR * FACTOR
        foot = np.zeros((len(tiles), n), bool)
        cx, cy = np.arange(n) % FACTOR, np.arange(n) // FACTOR
        for at in range(0, len(tiles.edge), max(1, _STEP // n)):
            part = slice(at, at + max(1, _STEP // n))
            t = np.repeat(tiles.tile[part], n)
            e = np.repeat(self.edges[tiles.edge[part]], n, axis=0)
            k = np.tile(np.arange(n), len(t) // n)
            odd = crossings(e, (tiles.ix[t] + 1) * side, (tiles.ix[t] * FACTOR + cx[k] + 1) * small, (tiles.iy[t] * FACTOR + cy[k]) * small, True)
            foot ^= (np.bincount((t * n + k)[odd], minlength=foot.size) % 2 == 1).reshape(foot.shape)
        foot ^= known[:, None]
        parent = tiles.tile[which]
        child = parent * n + (iy - tiles.iy[parent] * FACTOR) * FACTOR + ix - tiles.ix[parent] * FACTOR
        order = np.argsort(child, kind="stable")
        kinds, tile = np.unique(child[order], return_inverse=True)
        bare = foot.reshape(-1).copy()
        bare[kinds] = False
        whole = np.flatnonzero(bare)
        place = lambda k: (tiles.owner[k // n], tiles.ix[k // n] * FACTOR + cx[k % n], tiles.iy[k // n] * FACTOR + cy[k % n])
        self._inside(level - 1, *place(whole))
        return Tiles(*place(kinds), foot.reshape(-1)[kinds], tile.reshape(-1), tiles.edge[which][order])

    def pieces(self, tiles: Tiles, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The part of each shape in each tile, as the tile of each piece and rows y0, y1, x at both, sign, from the tile's corner.

        A piece stands for what lies left of it in the tile; added up by sign,
        pieces are the part. They are the edges cut to the tile, and for what
        lies right of the tile stretches of its right side.
        """
        side = self.side(level)
        e, left, above = self.edges[tiles.edge], self.left[tiles.edge], self.above[tiles.edge]
        x0, y0 = tiles.ix[tiles.tile] * side, tiles.iy[tiles.tile] * side
        x1, y1, x2, y2 = e.T
        slant = np.where(x2 != x1, x2 - x1, 1)
        cut = [np.where(x2 != x1, y1 + (x - x1) * (y2 - y1) / slant, lim) for x, lim in ((x0, -np.inf), (x0 + side, np.inf))]
        steep = np.where(x2 == x1, (x1 >= x0) & (x1 <= x0 + side), True)
        low = np.maximum.reduce([y1, y0, np.minimum(*cut)])
        high = np.minimum.reduce([y2, y0 + side, np.maximum(*cut)])
        on = (high > low) & (y2 > y1) & steep
        rate = (x2 - x1) / np.where(y2 > y1, y2 - y1, 1)
        at = lambda y: np.clip(x1 + (y - y1) * rate - x0, 0, side)
        own = np.stack([low - y0, high - y0, at(low), at(high), left], 1)[on]
        reach, below = below_right(e, x0 + side, y0)
        lid = np.flatnonzero(reach & ~below & (cut[1] < y0 + side))
        begin = np.clip(cut[1][lid] - y0[lid], 0, side)
        full = np.full(len(lid), side)
        lids = np.stack([begin, full, full, full, above[lid]], 1)
        foot = np.flatnonzero(tiles.foot)
        feet = np.tile([0, side, side, side, 1.0], (len(foot), 1))
        tile = np.concatenate([tiles.tile[on], tiles.tile[lid], foot])
        order = np.argsort(tile, kind="stable")
        return tile[order], np.concatenate([own, lids, feet])[order]


def inside_tiles(edges: np.ndarray, row: np.ndarray, known: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point lies in its tile's shape; ``edges`` and ``row``: the tile's edges, and whose point they are. Points on an edge do not."""
    out = known.astype(bool)
    for at in range(0, len(row), _STEP):
        r, e = row[at : at + _STEP], edges[at : at + _STEP]
        out ^= _odd(r, crossings(e, right[r], x[r], y[r]), len(out))
    for at in range(0, len(row), _STEP):
        r = row[at : at + _STEP]
        out[r[on_edge(edges[at : at + _STEP], x[r], y[r])]] = False
    return out
