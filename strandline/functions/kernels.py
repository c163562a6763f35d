"""Numpy kernels over one raster; no Spark here."""

from __future__ import annotations

import numpy as np


def disk(radius: int) -> np.ndarray:
    at = np.arange(-radius, radius + 1)
    return at[:, None] ** 2 + at**2 <= radius**2


def dilated(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """Pixels that the footprint covers when its centre (the later one of even sizes) lies on a pixel of the mask."""
    (h, w), (a, b) = footprint.shape, (footprint.shape[0] // 2, footprint.shape[1] // 2)
    padded = np.pad(mask.astype(bool), ((h - 1 - a, a), (w - 1 - b, b)))
    out = np.zeros(mask.shape, bool)
    for i, j in zip(*np.nonzero(footprint[::-1, ::-1]), strict=True):
        out |= padded[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out


def eroded(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """Pixels on which the footprint lies within the mask; what is beyond the image counts as masked."""
    (h, w), (a, b) = footprint.shape, (footprint.shape[0] // 2, footprint.shape[1] // 2)
    padded = np.pad(mask.astype(bool), ((a, h - 1 - a), (b, w - 1 - b)), constant_values=True)
    out = np.ones(mask.shape, bool)
    for i, j in zip(*np.nonzero(footprint), strict=True):
        out &= padded[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out


def opened(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    return dilated(eroded(mask, footprint), footprint)


def joined_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest number reachable from each of 0..size-1 over links (a, b), by hooking and pointer jumping."""
    low = np.arange(size)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not (low[low] == low).all():
            low = low[low]


def labelled(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Numbers of connected parts from 1, 0 outside."""
    mask = mask.astype(bool)
    number = np.arange(mask.size).reshape(mask.shape)
    links = []
    for dr, dc in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []):
        a = number[: mask.shape[0] - dr, max(0, -dc) : mask.shape[1] - max(0, dc)].ravel()
        b = number[dr:, max(0, dc) : mask.shape[1] + min(0, dc)].ravel()
        both = mask.ravel()[a] & mask.ravel()[b]
        links.append((a[both], b[both]))
    low = joined_labels(*(np.concatenate(side) for side in zip(*links, strict=True)), mask.size)
    out = np.zeros(mask.size, int)
    inside = mask.ravel()
    out[inside] = np.unique(low[inside], return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def chained(segment: np.ndarray, row0: np.ndarray, col0: np.ndarray, row1: np.ndarray, col1: np.ndarray, tile: int) -> dict[str, np.ndarray]:
    """Stretches of lines from a tile's segments in ascending order, by pointer doubling; ends on multiples of `tile`, where segments of other
    tiles may meet, stay open. Where several segments end and begin in one point, the first to end goes on as the first to begin."""
    size = len(segment)
    enter, leave = (((r % tile) == 0) | ((c % tile) == 0) for r, c in ((row0, col0), (row1, col1)))
    begins, ends = np.flatnonzero(~enter), np.flatnonzero(~leave)
    spot = np.unique(np.concatenate([row0[begins] + 1j * col0[begins], row1[ends] + 1j * col1[ends]]), return_inverse=True)[1]

    def keys(at: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        return at * (size + 1) + rank

    _, x, y = np.intersect1d(keys(spot[len(begins) :]), keys(spot[: len(begins)]), assume_unique=True, return_indices=True)
    own = np.arange(size)
    before = np.full(size, -1)
    before[begins[y]] = ends[x]
    steps, last = (before >= 0).astype(np.int64), np.where(before >= 0, before, own)
    low, back = own.copy(), np.zeros(size, np.int64)
    for _ in range(size.bit_length() + 1):
        at = np.flatnonzero(before >= 0)
        if not len(at):
            break
        to = before[at]
        lower = low[to] < low[at]
        back[at], low[at] = np.where(lower, steps[at] + back[to], back[at]), np.where(lower, low[to], low[at])
        steps[at], last[at], before[at] = steps[at] + steps[to], last[to], before[to]
    closed = before >= 0
    head, place = np.where(closed, low, last), np.where(closed, back, steps)
    n = np.bincount(head, minlength=size)[head]
    lowest = np.full(size, size)
    np.minimum.at(lowest, head, own)
    lowest = lowest[head]
    final = place == n - 1
    tail = np.zeros(size, np.int64)
    tail[head[final]] = own[final]
    whole = closed | ~(enter[head] | leave[tail[head]])
    return {"chain": segment[head], "place": place, "n": n, "low": segment[lowest], "at": place[lowest], "whole": whole, "enter": enter & (place == 0), "leave": leave & final}


def without_small(mask: np.ndarray, least: int, diagonal: bool = False) -> np.ndarray:
    parts = labelled(mask, diagonal)
    return (parts > 0) & (np.bincount(parts.ravel(), minlength=1)[parts] >= least)


def flooded(image: np.ndarray, seed: tuple[int, int], tolerance: float) -> np.ndarray:
    """The connected part around the seed (diagonals count) of values within tolerance of its value."""
    near = np.abs(image - image[seed]) <= tolerance
    parts = labelled(near, True)
    return parts == parts[seed]


def local_std(image: np.ndarray) -> np.ndarray:
    """Deviation over 3 x 3 with reflected edges, NaN skipped, NaN centres kept."""
    p = np.pad(image, 1, mode="reflect")
    views = np.stack([p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)])
    n = (~np.isnan(views)).sum(0)
    with np.errstate(all="ignore"):
        mean, square = np.nansum(views, 0) / n, np.nansum(views**2, 0) / n
        return np.where(np.isnan(image), np.nan, np.sqrt(np.maximum(square - mean**2, 0)))


def features(bands: np.ndarray) -> np.ndarray:
    """20 features of pixels from bands B, G, R, NIR, SWIR on the last axis: bands, five indices and the deviations of both."""
    b, g, r, nir, swir = np.moveaxis(bands, -1, 0)
    with np.errstate(all="ignore"):
        indices = [(p - q) / (p + q) for p, q in ((nir, g), (swir, g), (nir, r), (swir, nir), (b, r))]
    own = [b, g, r, nir, swir, *indices]
    return np.stack([*own, *(local_std(x) for x in own)], -1)


def envelopes(at: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line (a row of `at` and `cost`) the parabolas (x - at)^2 + cost that lie lowest somewhere: their places in the line, the x
    from which each does, and how many there are. Places ascend in a line; an infinite cost is no parabola. All lines go ahead together."""
    lines, size = at.shape
    which, begins, top = np.zeros((lines, size), int), np.full((lines, size + 1), np.inf), np.full(lines, -1)
    for q in range(size):
        new = np.flatnonzero(np.isfinite(cost[:, q]))
        cross = np.full(lines, -np.inf)
        left = new[top[new] >= 0]
        while len(left):
            v = which[left, top[left]]
            a, b = at[left, q], at[left, v]
            cross[left] = (cost[left, q] + a * a - cost[left, v] - b * b) / (2 * (a - b))
            left = left[cross[left] <= begins[left, top[left]]]
            top[left] -= 1
            cross[left[top[left] < 0]] = -np.inf
            left = left[top[left] >= 0]
        top[new] += 1
        which[new, top[new]], begins[new, top[new]] = q, cross[new]
    return which, begins, top + 1


def lowest(envelope: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, cost: np.ndarray, line: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The lowest parabola's value at x on each line asked (lines ascend); infinite where a line has no parabola."""
    which, begins, count = envelope
    out = np.full(len(x), np.inf)
    cuts = np.flatnonzero(np.diff(line, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(line)], strict=True):
        k, n = line[a], count[line[a]]
        if n:
            v = which[k, np.searchsorted(begins[k, :n], x[a:b], "right") - 1]
            out[a:b] = (x[a:b] - at[k, v]) ** 2 + cost[k, v]
    return out


def histogram_matched(source: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Each value of source as the template's value at the same share of its distribution, linear in between, ends held."""
    _, at, counts = np.unique(source, return_inverse=True, return_counts=True)
    values, template_counts = np.unique(template, return_counts=True)
    return np.interp(np.cumsum(counts) / source.size, np.cumsum(template_counts) / template.size, values)[at]


def pansharpened(bands: np.ndarray, pan: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Three bands with their first principal component replaced by the pan band matched to it. The component's sign is the one in
    which its largest loading is positive; more than 95 % masked pixels leave the bands as they are."""
    good = ~mask
    if mask.mean() > 0.95:
        return bands
    x = bands[good]
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T))
    vectors = vectors[:, ::-1] * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(3)])[::-1]
    scores = (x - mean) @ vectors
    scores[:, 0] = histogram_matched(pan[good], scores[:, 0])
    out = bands.copy()
    out[good] = scores @ vectors.T + mean
    return out


#: Values of quality bands that mean cloud or cirrus (fixed values): Sentinel-2, collection 1 of L8 and L9, and of older Landsats.
CLOUD_VALUES = {"S2": (1024, 2048), "L8": (2800, 2804, 2808, 2812, 6896, 6900, 6904, 6908), "L5": (752, 756, 760, 764)}


def cloud_values(qa: np.ndarray, satname: str, collection: str) -> np.ndarray:
    """The values of a quality band that mean cloud; of collection 2 those with bit 1, 2 or 3."""
    found = np.unique(qa)
    if satname != "S2" and collection == "C02":
        return found[found & 0b1110 != 0]
    return np.intersect1d(found, CLOUD_VALUES["S2" if satname == "S2" else "L8" if satname in ("L8", "L9") else "L5"])


def cloud_mask(qa: np.ndarray, satname: str, collection: str = "C02", issue: bool = False) -> np.ndarray:
    """Cloud pixels without parts of fewer than 40. Where sand is taken for cloud (`issue`), each value's pixels are opened by a square
    of 6 and its parts of fewer than 100 dropped instead."""
    values = cloud_values(qa, satname, collection)
    if issue:
        out = np.zeros(qa.shape, bool)
        for value in values:
            out |= without_small(opened(qa == value, np.ones((6, 6), bool)), 100)
        return out
    mask = np.isin(qa, values)
    return without_small(mask, 40) if mask.any() and not mask.all() else mask


def without_padding(band: np.ndarray) -> np.ndarray:
    """False on the all-zero rows and columns at the edges of a band."""
    inside = np.zeros(band.shape, bool)
    rows, cols = (np.flatnonzero((band != 0).any(k)) for k in (1, 0))
    if len(rows):
        inside[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] = True
    return inside


def in_polygon(height: int, width: int, ring: np.ndarray) -> np.ndarray:
    """Pixels whose centre (column, row) lies inside a ring, by crossings of a ray."""
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    inside = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside
