"""Batched array helpers used inside Arrow tasks.

Every helper works on a batch of orientations at once and keeps that batch on the last axis, so each
numpy call runs over contiguous memory.  Spark decides which orientations form a batch.
"""

from __future__ import annotations

import numpy as np

# Most cells of a table of sums per residue pair.
LARGEST_TABLE = 1 << 17


def symmetric_key_matrices(cov: np.ndarray) -> np.ndarray:
    """4x4 quaternion matrices of 3x3 covariances ``cov[..., r, c] = sum a_r * b_c`` (both centred)."""
    key = np.empty(cov.shape[:-2] + (4, 4))
    xx, xy, xz = cov[..., 0, 0], cov[..., 0, 1], cov[..., 0, 2]
    yx, yy, yz = cov[..., 1, 0], cov[..., 1, 1], cov[..., 1, 2]
    zx, zy, zz = cov[..., 2, 0], cov[..., 2, 1], cov[..., 2, 2]
    key[..., 0, 0] = xx + yy + zz
    key[..., 0, 1] = key[..., 1, 0] = zy - yz
    key[..., 0, 2] = key[..., 2, 0] = xz - zx
    key[..., 0, 3] = key[..., 3, 0] = yx - xy
    key[..., 1, 1] = xx - yy - zz
    key[..., 1, 2] = key[..., 2, 1] = xy + yx
    key[..., 1, 3] = key[..., 3, 1] = zx + xz
    key[..., 2, 2] = -xx + yy - zz
    key[..., 2, 3] = key[..., 3, 2] = yz + zy
    key[..., 3, 3] = -xx - yy + zz
    return key


def best_rotations(cov: np.ndarray) -> np.ndarray:
    """Proper rotations R (moving b onto a) that maximise the overlap of each covariance."""
    _, vectors = np.linalg.eigh(symmetric_key_matrices(cov))
    w, x, y, z = (vectors[..., k, 3] for k in range(4))
    rot = np.empty(cov.shape)
    rot[..., 0, 0] = w * w + x * x - y * y - z * z
    rot[..., 0, 1] = 2 * (x * y - w * z)
    rot[..., 0, 2] = 2 * (x * z + w * y)
    rot[..., 1, 0] = 2 * (x * y + w * z)
    rot[..., 1, 1] = w * w - x * x + y * y - z * z
    rot[..., 1, 2] = 2 * (y * z - w * x)
    rot[..., 2, 0] = 2 * (x * z - w * y)
    rot[..., 2, 1] = 2 * (y * z + w * x)
    rot[..., 2, 2] = w * w - x * x - y * y + z * z
    return rot


def best_overlap(cov: np.ndarray) -> np.ndarray:
    """Largest eigenvalue of the key matrix of each covariance, without eigenvectors.

    Trigonometric estimate of the largest singular value, then Newton steps on the quartic.
    """
    gram = np.matmul(np.swapaxes(cov, -1, -2), cov)
    trace = np.trace(gram, axis1=-2, axis2=-1)
    square = (gram * gram).sum(axis=(-2, -1))
    det = np.linalg.det(cov)
    mean = trace / 3
    dev = np.sqrt(np.maximum((square - trace * trace / 3) / 6, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        shifted = det * det - mean * (trace * trace - square) / 2 + mean * mean * trace - mean**3
        ratio = np.where(dev > 0, shifted / (2 * dev**3), 1.0)
        angle = np.arccos(np.clip(ratio, -1.0, 1.0)) / 3
        first = np.sqrt(np.maximum(mean + 2 * dev * np.cos(angle), 0.0))
        rest = np.where(first > 0, trace - first * first + 2 * det / first, 0.0)
        root = first + np.sqrt(np.maximum(rest, 0.0))
        for _ in range(4):
            value = ((root * root - 2 * trace) * root - 8 * det) * root + 2 * square - trace * trace
            slope = 4 * (root * root - trace) * root - 8 * det
            root = np.where(np.abs(slope) > 1e-6 * root**3, root - value / slope, root)
    return root


def transforms_of(cov: np.ndarray, mean_a: np.ndarray, mean_b: np.ndarray) -> np.ndarray:
    """Row-major 3x4 matrices ``[R | mean_a - R mean_b]``, flattened to 12 numbers."""
    rot = best_rotations(cov)
    shift = mean_a - np.einsum("...rc,...c->...r", rot, mean_b)
    return np.concatenate([rot, shift[..., None]], axis=-1).reshape(cov.shape[:-2] + (12,))


def moved(points: np.ndarray, transforms: np.ndarray) -> np.ndarray:
    """Apply K transforms (K,12) to points (n,Q,3); result (n,Q,3,K)."""
    mats = transforms.reshape(-1, 3, 4)
    turned = np.einsum("krc,nqc->nqrk", mats[:, :, :3], points)
    return turned + mats[:, :, 3].T[None, None]


def pair_costs(a: np.ndarray, b_moved: np.ndarray, max_dist: float | None) -> np.ndarray:
    """Squared distances summed over the atoms of a residue, (m,n,K); over the limit = infinity."""
    cost = np.zeros((a.shape[0], b_moved.shape[0], b_moved.shape[3]))
    for q in range(a.shape[1]):
        for axis in range(3):
            cost += (a[:, q, axis][:, None, None] - b_moved[None, :, q, axis, :]) ** 2
    if max_dist is not None:
        cost[cost > max_dist * max_dist * a.shape[1]] = np.inf
    return cost


def running_minimum(table: np.ndarray) -> np.ndarray:
    """In-place two-dimensional prefix minimum over the first two axes."""
    for r in range(1, table.shape[0]):
        np.minimum(table[r], table[r - 1], out=table[r])
    for c in range(1, table.shape[1]):
        np.minimum(table[:, c], table[:, c - 1], out=table[:, c])
    return table


def layered_solve(cost: np.ndarray, n_max: int, keep_moves: bool):
    """Least total cost of exactly n order-preserving pairs, for n = 1..n_max.

    A layer is the prefix minimum of the previous layer, one step back on both chains, plus the cost
    of the pair itself.  Returns totals (n_max,K) and, on request, a move code per cell: 0 = pair,
    1 = leave out the residue of b, 2 = leave out the residue of a (leaving out wins ties, b first).
    """
    m, n, k = cost.shape
    totals = np.full((n_max, k), np.inf)
    moves = np.zeros((n_max, m, n, k), dtype=np.uint8) if keep_moves else None
    layer = None
    for depth in range(n_max):
        pairs = cost[depth:, depth:]
        layer = running_minimum(pairs.copy() if layer is None else pairs + layer[:-1, :-1])
        totals[depth] = layer[-1, -1]
        if keep_moves:
            view = moves[depth, depth:, depth:]
            np.multiply(layer[1:] == layer[:-1], np.uint8(2), out=view[1:])
            np.copyto(view[:, 1:], 1, where=layer[:, 1:] == layer[:, :-1])
        if not np.isfinite(totals[depth]).any():
            break
    return totals, moves


def trace_layers(moves: np.ndarray, depths: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Follow the move codes back for several (layer count, orientation) solutions at once.

    ``depths`` are match counts, ``columns`` the orientation of each solution.  Returns the matched
    cells i * n + j of every solution in increasing order, (solutions, max depth), -1 past its count.
    """
    _, m, n, k = moves.shape
    codes = moves.reshape(-1)
    cells = np.full((len(depths), int(depths.max()) if len(depths) else 0), -1, dtype=np.int64)
    left = depths.astype(np.int64) - 1
    at = ((left * m + m - 1) * n + n - 1) * k + columns
    back = np.array([m * n * k + n * k + k, k, n * k])  # steps of the codes in the flat table
    live = np.arange(len(depths))
    while live.size:
        code = codes[at]
        paired = code == 0
        rows = live[paired]
        cells[rows, left[rows]] = at[paired]
        left[rows] -= 1
        at -= back[code]
        more = left[live] >= 0
        if not more.all():
            live, at = live[more], at[more]
    return np.where(cells < 0, -1, cells // k % (m * n))


class Layers:
    """The layered recurrence over a batch of orientations, some layers at a time, orientations dropped in between.

    Layer d holds for every cell (i, j) the least cost of d ordered pairs among the first i + 1 and j + 1 residues.  Only
    cells that leave room for ``least`` pairs in all are kept, so totals below that count mean nothing but "none" if
    infinite.  Ties are decided as in :func:`layered_solve`.
    """

    def __init__(self, cost: np.ndarray, least: int = 1):
        self.cost, self.least = cost, least
        self.rows, self.cols, count = cost.shape
        self.columns = np.arange(count)  # which orientations are left
        self.depth, self.layer, self.merged = 0, None, None
        # per call of advance: first layer, move codes (layers, rows, cols, orientations), their columns in the call before
        self.runs: list[tuple[int, np.ndarray, np.ndarray | None]] = []

    def next_layer(self) -> np.ndarray:
        spare = max(self.least - self.depth - 1, 0)
        layer = self.cost[self.depth : self.rows - spare, self.depth : self.cols - spare].copy()
        if self.layer is not None:
            layer += self.layer if self.depth < self.least else self.layer[:-1, :-1]
        return running_minimum(layer)

    def advance(self, count: int) -> np.ndarray:
        """Totals of the next ``count`` layers, (count, orientations left)."""
        moves = np.zeros((count, self.rows, self.cols, len(self.columns)), dtype=np.uint8)
        self.runs.append((self.depth, moves, self.merged))
        self.merged, totals = None, []
        for step in range(count):
            layer = self.layer = self.next_layer()
            view = moves[step, self.depth : self.depth + len(layer), self.depth : self.depth + layer.shape[1]]
            np.multiply(layer[1:] == layer[:-1], np.uint8(2), out=view[1:])
            np.copyto(view[:, 1:], 1, where=layer[:, 1:] == layer[:, :-1])
            self.depth += 1
            totals.append(layer[-1, -1].copy())  # not a view, which would keep the layer
        return np.stack(totals)

    def keep(self, wanted: np.ndarray) -> None:
        """Go on with some of the orientations left (a mask)."""
        if wanted.all():
            return
        chosen = np.flatnonzero(wanted)
        self.cost, self.columns = self.cost[..., chosen], self.columns[chosen]
        if self.layer is not None:
            self.layer = self.layer[..., chosen]
        self.merged = chosen

    def trace(self, depths: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Matched cells i * n + j of solutions, (solutions, most pairs), -1 past their count.

        Counts and columns are those of the last call of ``advance``.
        """
        cells = np.full((len(depths), int(depths.max()) if len(depths) else 0), -1, dtype=np.int64)
        flat, rows = cells.reshape(-1), np.arange(len(depths)) * cells.shape[1]
        left, end = depths.astype(np.int64) - 1, np.full(len(depths), self.rows * self.cols - 1)
        for start, moves, merged in reversed(self.runs):
            _, m, n, k = moves.shape
            codes = moves.reshape(-1)
            back = np.array([m * n * k + n * k + k, k, n * k])  # steps of the codes in the flat table
            at = ((left - start) * m * n + end) * k + columns
            place, first = rows + left, rows + start
            while len(at):
                code = codes[at]
                flat[place] = at  # until a step finds the pair, the next one writes to the same place
                place = place - (code == 0)
                at = at - back[code]
                more = place >= first
                if not more.all():
                    place, first, at = place[more], first[more], at[more]
            left = np.full(len(depths), start - 1)
            here = cells[:, start : start + len(moves)]
            np.copyto(here, here // k % (m * n), where=here >= 0)
            # what is left of a path ends before the first pair found in these layers
            end = here[:, 0] - n - 1
            columns = columns if merged is None else merged[columns]
        return cells


class LayersInSegments(Layers):
    """The same for one orientation of long chains: values are kept for some layers only.

    A traceback goes through the layers from the last to the first for all counts at once.  It makes the layers of a segment
    again from the values before it and keeps two bits per cell of them.
    """

    def __init__(self, cost: np.ndarray, least: int, most: int):
        super().__init__(cost, least)
        if cost.shape[2] != 1:
            raise ValueError("one orientation at a time")
        # values take 64 bits per cell and segment, moves 2 bits per cell and layer of a segment
        self.every = max(1, int(round((32 * most) ** 0.5)))
        self.before: list[np.ndarray | None] = []

    def advance(self, count: int) -> np.ndarray:
        totals = []
        for _ in range(count):
            if self.depth % self.every == 0:
                self.before.append(self.layer)
            self.layer = self.next_layer()
            self.depth += 1
            totals.append(self.layer[-1, -1].copy())
        return np.stack(totals)

    def keep(self, wanted: np.ndarray) -> None:
        self.columns = self.columns[wanted]

    def trace(self, depths: np.ndarray, columns: np.ndarray) -> np.ndarray:
        cells = np.full((len(depths), int(depths.max()) if len(depths) else 0), -1, dtype=np.int64)
        i, j = np.full(len(depths), self.rows - 1), np.full(len(depths), self.cols - 1)
        held = self.depth, self.layer
        for start in range((int(depths.max(initial=1)) - 1) // self.every * self.every, -1, -self.every):
            self.depth, self.layer = start, self.before[start // self.every]
            packed = []
            for _ in range(start, min(start + self.every, int(depths.max()))):
                self.layer = self.next_layer()[..., 0]
                packed.append((np.packbits(self.layer[:, 1:] == self.layer[:, :-1], axis=1),
                               np.packbits(self.layer[1:] == self.layer[:-1], axis=1)))
                self.layer = self.layer[..., None]
                self.depth += 1
            while packed:
                d, (skip_b, skip_a) = start + len(packed) - 1, packed.pop()
                rows = np.flatnonzero(depths > d)
                at, to = i[rows] - d, j[rows] - d
                # a pair ends a run of residues of b left out, then one of a
                for bits, down in ((skip_b, "b"), (skip_a, "a")):
                    going = np.arange(len(rows))
                    while going.size:
                        r, c = (at[going], to[going] - 1) if down == "b" else (at[going] - 1, to[going])
                        inside = (r >= 0) & (c >= 0)
                        going, r, c = going[inside], r[inside], c[inside]
                        going = going[(bits[r, c >> 3] >> (7 - (c & 7))) & 1 == 1]
                        if down == "b":
                            to[going] -= 1
                        else:
                            at[going] -= 1
                cells[rows, d] = (at + d) * self.cols + to + d
                i[rows], j[rows] = at + d - 1, to + d - 1
        self.depth, self.layer = held
        return cells


def fragment_sums(a: np.ndarray, b: np.ndarray, i0: np.ndarray, j0: np.ndarray, length: int):
    """Covariance, means and spread of the fragment pairs that start at (i0, j0), all atoms of their residues."""
    span = np.arange(length)
    pa = a[i0[:, None] + span].reshape(len(i0), -1, 3)
    pb = b[j0[:, None] + span].reshape(len(j0), -1, 3)
    mean_a, mean_b = pa.mean(axis=1), pb.mean(axis=1)
    ca, cb = pa - mean_a[:, None], pb - mean_b[:, None]
    return np.einsum("kpr,kpc->krc", ca, cb), mean_a, mean_b, (ca * ca).sum(axis=(1, 2)) + (cb * cb).sum(axis=(1, 2))


def cell_positions(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Residue numbers on both chains of matched cells, -1 where there is none."""
    none = cells < 0
    return np.where(none, -1, cells // n), np.where(none, -1, cells % n)


def matched_moments(a: np.ndarray, b: np.ndarray, cells: np.ndarray):
    """Covariance, means and spread of the matched atoms of each solution (a row of ``cells``).

    The sums of every residue pair are tabulated once and added up along the matches.
    """
    mean_a, mean_b = a.mean(axis=(0, 1)), b.mean(axis=(0, 1))
    ca, cb = a - mean_a, b - mean_b
    m, n, atoms = len(a), len(b), a.shape[1]
    used = cells >= 0
    counts = used.sum(axis=1)
    if m * n <= LARGEST_TABLE:
        table = np.empty((m, n, 16))
        table[..., 0:3] = ca.sum(axis=1)[:, None]
        table[..., 3:6] = cb.sum(axis=1)[None]
        table[..., 6:15] = np.einsum("iqr,jqc->ijrc", ca, cb).reshape(m, n, 9)
        table[..., 15] = (ca * ca).sum(axis=(1, 2))[:, None] + (cb * cb).sum(axis=(1, 2))[None]
        sums = _sums_along(table.reshape(m * n, 16), cells, counts)
    else:  # a table would be larger than the matches of one solution
        sums = np.empty((len(cells), 16))
        for row, (line, there) in enumerate(zip(cells, used)):
            pa, pb = ca[line[there] // n].reshape(-1, 3), cb[line[there] % n].reshape(-1, 3)
            sums[row] = np.concatenate([pa.sum(axis=0), pb.sum(axis=0), (pa.T @ pb).reshape(-1), [(pa * pa).sum() + (pb * pb).sum()]])
    size = (counts * atoms)[:, None].astype(float)
    mid_a, mid_b = sums[:, 0:3] / size, sums[:, 3:6] / size
    cov = sums[:, 6:15].reshape(-1, 3, 3) - sums[:, 0:3, None] * mid_b[:, None, :]
    spread = sums[:, 15] - ((mid_a * mid_a + mid_b * mid_b) * size).sum(axis=1)
    return cov, mid_a + mean_a, mid_b + mean_b, spread


def matched_moments_among(a: list[np.ndarray], b: list[np.ndarray], owner: np.ndarray, cells: np.ndarray):
    """:func:`matched_moments` of solutions of several pairs of equally long chains; ``owner`` numbers the pair of each.

    The tables of as many pairs are made together as have room in one of the largest size.
    """
    several = LARGEST_TABLE // (len(a[0]) * len(b[0]))
    outs, places = [], []
    for start in range(0, len(a), max(several, 1)):
        rows = np.flatnonzero((owner >= start) & (owner < start + max(several, 1)))
        if not len(rows):
            continue
        places.append(rows)
        if several < 2:
            outs.append(matched_moments(a[start], b[start], cells[rows]))
            continue
        pa, pb = np.stack(a[start : start + several]), np.stack(b[start : start + several])
        mean_a, mean_b = pa.mean(axis=(1, 2)), pb.mean(axis=(1, 2))
        ca, cb = pa - mean_a[:, None, None], pb - mean_b[:, None, None]
        count, m, atoms, _ = ca.shape
        n = cb.shape[1]
        table = np.empty((count, m, n, 16))
        table[..., 0:3] = ca.sum(axis=2)[:, :, None]
        table[..., 3:6] = cb.sum(axis=2)[:, None]
        table[..., 6:15] = np.einsum("kiqr,kjqc->kijrc", ca, cb).reshape(count, m, n, 9)
        table[..., 15] = (ca * ca).sum(axis=(2, 3))[:, :, None] + (cb * cb).sum(axis=(2, 3))[:, None]
        outs.append(_moments_of_tables(table, owner[rows] - start, cells[rows], mean_a, mean_b, atoms))
    order = np.argsort(np.concatenate(places), kind="stable")
    return tuple(np.concatenate(parts)[order] for parts in zip(*outs))


def _sums_along(table: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of table rows over the first ``counts`` cells of every solution, cell after cell for all solutions at once."""
    order = np.argsort(counts, kind="stable")
    cells, counts = cells[order], counts[order]
    sums = table[cells[:, 0]]
    for k in range(1, cells.shape[1]):
        first = int(np.searchsorted(counts, k, side="right"))
        sums[first:] += table[cells[first:, k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _moments_of_tables(table, whose, cells, mean_a, mean_b, atoms):
    counts = (cells >= 0).sum(axis=1)
    sums = _sums_along(table.reshape(-1, 16), cells + (whose * (table.shape[1] * table.shape[2]))[:, None], counts)
    size = (counts * atoms)[:, None].astype(float)
    mid_a, mid_b = sums[:, 0:3] / size, sums[:, 3:6] / size
    cov = sums[:, 6:15].reshape(-1, 3, 3) - sums[:, 0:3, None] * mid_b[:, None, :]
    spread = sums[:, 15] - ((mid_a * mid_a + mid_b * mid_b) * size).sum(axis=1)
    return cov, mid_a + mean_a[whose], mid_b + mean_b[whose], spread


def longest_ordered_matching(allowed: np.ndarray) -> np.ndarray:
    """Most order-preserving pairs among the allowed cells (m,n,K) of each orientation."""
    m, n, k = allowed.shape
    best = np.zeros((n + 1, k), dtype=np.int32)
    for i in range(m):
        row = best.copy()
        np.maximum(row[1:], best[:-1] + allowed[i], out=row[1:])
        np.maximum.accumulate(row, axis=0, out=row)
        best = row
    return best[-1]


def gap_solve(cost: np.ndarray, gap: np.ndarray):
    """Cheapest global alignment with a fixed price per unmatched residue, per orientation.

    Returns totals (K,) and move codes (m+1,n+1,K): 0 = pair, 1 = leave out the residue of b,
    2 = leave out the residue of a (leaving out wins ties, a first).  Totals are kept relative to
    "everything unmatched", which turns each row into a running minimum.
    """
    m, n, k = cost.shape
    table = np.zeros((m + 1, n + 1, k))
    moves = np.zeros((m + 1, n + 1, k), dtype=np.uint8)
    moves[0, 1:] = 1
    moves[1:, 0] = 2
    gain = cost - 2.0 * gap
    for i in range(1, m + 1):
        row = table[i]
        np.minimum(table[i - 1, 1:], table[i - 1, :-1] + gain[i - 1], out=row[1:])
        np.minimum.accumulate(row, axis=0, out=row)
        view = moves[i, 1:]
        view[row[1:] == row[:-1]] = 1
        view[row[1:] == table[i - 1, 1:]] = 2
    return table[m, n] + (m + n) * gap, moves


def trace_gaps(moves: np.ndarray):
    """Matched positions (K, min(m,n)) behind :func:`gap_solve`, -1 past the match count."""
    rows, cols, k = moves.shape
    width = min(rows, cols) - 1
    back_a = np.full((k, width), -1, dtype=np.int32)
    back_b = np.full((k, width), -1, dtype=np.int32)
    found = np.zeros(k, dtype=np.int64)
    i = np.full(k, rows - 1)
    j = np.full(k, cols - 1)
    live = np.arange(k)
    while live.size:
        code = moves[i[live], j[live], live]
        paired = live[code == 0]
        back_a[paired, found[paired]] = i[paired] - 1
        back_b[paired, found[paired]] = j[paired] - 1
        found[paired] += 1
        i[live] -= code != 1
        j[live] -= code != 2
        live = live[(i[live] > 0) | (j[live] > 0)]
    order = found[:, None] - 1 - np.arange(width)[None]
    inside = order >= 0
    take = np.maximum(order, 0)
    pos_a = np.where(inside, np.take_along_axis(back_a, take, 1), -1)
    pos_b = np.where(inside, np.take_along_axis(back_b, take, 1), -1)
    return pos_a, pos_b, found
