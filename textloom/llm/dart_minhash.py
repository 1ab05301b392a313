"""DartMinHash: signatures of sparse weighted sets, whose coordinates agree with probability equal to weighted Jaccard.

Every element owns the strip of the plane above its name: weight to one side, rank to the other. Hashed darts fall on it
with density 1, the same for every set that has the element. A set catches the darts below its weight there and
below the rank ``theta``, so with theta = (k ln k + 2k) / total weight it catches about k ln k + 2k whatever its size. Each
dart also names one of k coordinates, which keeps its earliest (lowest-ranked) dart; if one has none, theta doubles
for that set. Strips are cut into cells of area 1, whose weight sides double ([0,1), [1,2), [2,4) ...) while their rank
sides halve: a set looks at few cells that hold nothing for it, however large a weight. All sets of a chunk are
handled by the same array operations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash

SHINGLE_WORDS = 5
K = 128
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def shingles(texts: list[str | None], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the different shingles of each text, ordered by text and hash. Words are what ASCII white
    space separates; a text of fewer words than ``width`` has one shingle of them all, one without words none."""
    lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    words = [w for x in lists for w in x]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    code, names = pd.factorize(np.array(words, dtype=object))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), _U, len(names))[code]
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, width)[text]
    h = size.astype(_U)
    for j in range(width):
        inside = size > j
        h = np.where(inside, mix(h ^ word[np.where(inside, at + j, 0)] + _U(j)), h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.nonzero(new)[0]
    return text[start], h[start], np.diff(np.append(start, len(h)))


def _earliest(sets: np.ndarray, element: np.ndarray, weight: np.ndarray, theta: np.ndarray, k: int, n: int) -> np.ndarray:
    """[n, k] ids of the earliest darts, 0 where there is none. sets: 0..n-1, of each element."""
    who, ranks, ids = [], [], []
    level = 0
    while True:
        low = 0.0 if level == 0 else 2.0 ** (level - 1)
        has = np.nonzero(weight > low)[0] if level else np.arange(len(weight))
        if not len(has):
            break
        side = max(1.0, low)  # of the cell along weight; along rank it is 1 / side
        cells = np.ceil(theta[sets[has]] * side).astype(np.int64)
        e = np.repeat(has, cells)
        b = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
        with np.errstate(over="ignore"):
            key = mix(element[e] ^ mix(b.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(level + 1)))
        darts = np.searchsorted(_POISSON, _unit(key), side="right")
        c = np.repeat(np.arange(len(e)), darts)
        d = np.arange(len(c)) - np.repeat(np.cumsum(darts) - darts, darts)
        with np.errstate(over="ignore"):
            dart = mix(key[c] + (d + 1).astype(_U) * _U(0xD1B54A32D192ED03))
        rank = (b[c] + _unit(mix(dart ^ _U(0xA0761D6478BD642F)))) / side
        own = e[c]
        caught = (low + _unit(mix(dart ^ _U(0xE7037ED1A0B428DB))) * side < weight[own]) & (rank < theta[sets[own]])
        who.append(sets[own][caught] * k + (dart[caught] >> _U(32)).astype(np.int64) % k)
        ranks.append(rank[caught])
        ids.append(dart[caught])
        level += 1
    out = np.zeros(n * k, _U)
    slot, rank, dart = np.concatenate(who), np.concatenate(ranks), np.concatenate(ids)
    # sorted by slot, then rank: latest first, so that the earliest is written last
    order = np.lexsort((-rank, slot))
    out[slot[order]] = dart[order]
    return out.reshape(n, k)


def signatures(sets: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """[n, k] dart ids of sets 0..n-1; a set without elements has zeros. Elements are given in order of their sets."""
    out = np.zeros((n, k), _U)
    weight = weight.astype(np.float64)
    total = np.bincount(sets, weights=weight, minlength=n) if len(sets) else np.zeros(n)
    theta = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = np.nonzero(total > 0)[0]
    while len(todo):
        new = np.full(n, -1)
        new[todo] = np.arange(len(todo))
        own = new[sets] >= 0
        out[todo] = _earliest(new[sets[own]], element[own], weight[own], theta[todo], k, len(todo))
        todo = todo[(out[todo] == 0).any(axis=1)]
        theta[todo] *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """[n, k / rows] hashes of each band's coordinates and number."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    h = np.broadcast_to(np.arange(k // rows, dtype=_U) + _U(1), (n, k // rows)).copy()
    for j in range(rows):
        h = mix(h ^ parts[:, :, j])
    return h


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two sets given as ascending hashes and weights; 0 if both are empty."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    every = wa.sum() + wb.sum() - both
    return float(both / every) if every else 0.0
