"""Numpy work on bounded blocks of clusters, run inside tasks.

A cluster is known by the smallest key of its leaves. Distances are computed pair by
pair with the same few operations, so they do not depend on the block a pair meets in.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Workers get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLUSTER = ["key", "node", "size", "leaves", "sums", "height", "level"]
#: Bounds are lowered by this share, more than the rounding of a distance.
_SLACK = 1e-9
_ROWS = 128


def ward_distances(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Increase of the sum of squares for every pair; exact up to one rounding while the products are small integers."""
    total = np.zeros((len(sa), len(sb)))
    for at in range(0, len(sa), _ROWS):  # a strip at a time: beside the result little memory is needed
        part, strip, w = total[at : at + _ROWS], sa[at : at + _ROWS], wa[at : at + _ROWS, None]
        for k in range(sa.shape[1]):
            gap = strip[:, k, None] * wb - sb[None, :, k] * w
            gap *= gap
            part += gap
        part /= w * wb * (w + wb)
    return total


def _arrays(clusters: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(clusters["sums"]).astype(float), clusters["size"].to_numpy(float)


def box(clusters: pd.DataFrame) -> pd.DataFrame:
    """`block, least, low, high`: the smallest size, and the bounds of the centres."""
    sums, size = _arrays(clusters)
    centre = sums / size[:, None]
    return pd.DataFrame({"block": clusters["block"].iloc[:1], "least": size.min(), "low": [centre.min(0)], "high": [centre.max(0)]})


def nearest_within(clusters: pd.DataFrame) -> pd.DataFrame:
    """For each cluster of a block the nearest other one there; ties to the smallest key."""
    return _nearest(clusters, clusters, same=True)


def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each cluster of one block the nearest one of another: `block, key, other, d2`."""
    return _nearest(left, right, same=False)


def _nearest(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    none = pd.DataFrame({"block": [], "key": [], "other": [], "d2": []}).astype({"block": "int32", "key": str, "other": str})
    if left.empty or right.empty or same and len(right) < 2:
        return none
    right = right.sort_values("key")
    left = right if same else left
    d2 = ward_distances(*_arrays(left), *_arrays(right))
    if same:
        np.fill_diagonal(d2, np.inf)
    keys = right["key"].to_numpy()
    return pd.DataFrame({"block": left["block"].to_numpy(), "key": left["key"].to_numpy(), "other": keys[d2.argmin(1)], "d2": d2.min(1)})


def merge_within(clusters: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
    """All merges of a block that nothing outside can interfere with.

    Two clusters are joined when each is the other's nearest in the block and nearer than
    anything outside can be: the centres of other blocks stay inside their boxes and the
    sizes never fall, whatever is merged there meanwhile. `outside` holds the nearest boxes and, as `cap`, a bound for all
    further ones. Returns the clusters left (`alive`) and every merge (`left` is set).
    """
    clusters = clusters.sort_values("key").reset_index(drop=True)
    names = clusters["node"].tolist()
    keys = clusters["key"].tolist()
    sums, size = _arrays(clusters)
    leaves, height, level = (clusters[c].to_numpy().copy() for c in ("leaves", "height", "level"))
    boxes = outside["boxes"].iloc[0] if len(outside) else []
    cap = float(outside["cap"].iloc[0]) if len(outside) else np.inf
    low = np.array([b["low"] for b in boxes]).reshape(len(boxes), sums.shape[1])
    high = np.array([b["high"] for b in boxes]).reshape(len(boxes), sums.shape[1])
    least = np.array([b["least"] for b in boxes])

    def bound(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """No cluster outside is nearer than this."""
        out = np.full(len(size), cap)
        centre = sums / size[:, None]
        for k in range(len(least)):
            gap = np.maximum(0, np.maximum(low[k] - centre, centre - high[k]))
            out = np.minimum(out, (gap * gap).sum(1) * size * least[k] / (size + least[k]))
        return out * (1 - _SLACK)

    limit = bound(sums, size)
    d2 = ward_distances(sums, size, sums, size)
    np.fill_diagonal(d2, np.inf)
    merges: list[tuple] = []
    made = [None] * len(names)  # the merge that made each cluster, as its place in the list
    while len(names) > 1:
        near = d2.argmin(1)  # rows are in order of keys: ties go to the smallest
        here = np.arange(len(near))
        at = d2[here, near]
        first = np.flatnonzero((near[near] == here) & (here < near) & (at < limit) & (at < limit[near]))
        if not len(first):
            break
        second = near[first]
        for i, j in zip(first.tolist(), second.tolist(), strict=True):
            left, right, node = names[i], names[j], f"m:{keys[j]}"
            sums[i] += sums[j]
            size[i] += size[j]
            leaves[i] += leaves[j]
            height[i] = max(height[i], height[j], d2[i, j])
            level[i] = max(level[i], level[j]) + 1
            made[i], names[i] = len(merges), node
            merges.append((keys[i], node, size[i], leaves[i], sums[i].copy(), height[i], level[i], left, right, keys[j], False))
        fresh = ward_distances(sums[first], size[first], sums, size)
        d2[first], d2[:, first] = fresh, fresh.T
        d2[first, first] = np.inf
        limit[first] = bound(sums[first], size[first])
        stay = np.delete(here, second)
        d2 = d2[np.ix_(stay, stay)]
        sums, size, leaves, height, level, limit = (x[stay] for x in (sums, size, leaves, height, level, limit))
        names, keys, made = ([x[k] for k in stay] for x in (names, keys, made))
    for k, place in enumerate(made):
        row = (keys[k], names[k], size[k], leaves[k], sums[k], height[k], level[k])
        if place is None:
            merges.append((*row, None, None, None, True))
        else:
            merges[place] = (*row, *merges[place][7:10], True)
    return pd.DataFrame(merges, columns=[*CLUSTER, "left", "right", "right_key", "alive"])
