"""Signatures of sets by partition of their universe, for similarity joins without loss.

Sizes fall into bands. In a band, every linked pair differs in at most ``most`` elements; elements
are hashed into segments, and a linked pair agrees in a segment, or differs there in one element,
because all segments together can't hold more differences than that. A segment is indexed whole
(worth one unit) or whole and with each single element deleted (worth two units). How many segments
of either kind a band has is chosen by cost: rows to index, and pairs that agree by chance because
their segments are small.

Segments that are too empty to tell sets apart are not indexed. A band has ``slack`` units to spare for
them; a set that loses more than the slack is indexed again with another hash, and after ROUNDS of
those under its band alone. A pair missed in one round has lost more than the slack on both sides, so
both are in the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tidewater.llm.kernels import mix

ROUNDS = 6
#: Cost of a pair that agrees by chance, in rows.
CHANCE = 50.0
#: Share of a band's sets that may lose more units than its slack.
LOST = 1e-3


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    most: int  # differences of a linked pair
    whole: int  # segments indexed whole
    deleted: int  # segments indexed with deletions
    slack: int


def _tail(mean: float, k: int) -> float:
    term, total = math.exp(-mean), 0.0
    for i in range(k + 1):
        total += term
        term *= mean / (i + 1)
    return 1 - total


def _lost(whole: int, deleted: int, n: float) -> float:
    return whole * math.exp(-n) + 2 * deleted * math.exp(-n) * (1 + n)


def _slack(most: int, deleted: int, size: float) -> int:
    slack = 0
    while True:
        whole = most + 1 + slack - 2 * deleted
        if slack > most + 40 or (whole >= 0 and _tail(_lost(whole, deleted, size / (whole + deleted)), slack) <= LOST):
            return slack
        slack += 1


@lru_cache(8)
def bands(p: int, q: int, largest: int) -> tuple[Band, ...]:
    """Bands up to a size for the threshold p / q."""
    found: list[Band] = []
    low = 1
    while low <= largest:
        high = max(low, low * q // p)
        total = high + high * q // p
        most = total * (q - p) // (q + p)
        best = None
        size = (low + high) / 2
        tries = range((most + 1) // 2 + 1) if most < 64 else range(0, (most + 1) // 2 + 1, max(1, most // 32))
        for deleted in tries:
            slack = _slack(most, deleted, size)
            whole = most + 1 + slack - 2 * deleted
            if whole < 0:
                continue
            n = size / (whole + deleted)
            cost = whole + deleted * (n + 1) + CHANCE * (whole * math.exp(-n) + deleted * (n + 1) * math.exp(1 - n))
            if best is None or cost < best[0]:
                best = (cost, whole, deleted, slack)
        found.append(Band(len(found), low, high, most, best[1], best[2], best[3]))
        low = high + 1
    return tuple(found)


def band_of(size: int, p: int, q: int) -> tuple[Band, ...]:
    """The bands under which a set of this size is indexed: its own and those of its smaller partners."""
    largest = 64
    while largest < size:
        largest *= 2
    all_bands = bands(p, q, largest)
    least = -(-size * p // q)
    own = next(b for b in all_bands[_first(all_bands, size) :] if b.low <= size <= b.high)
    found = [own]
    while found[-1].number and found[-1].low > least:
        found.append(all_bands[found[-1].number - 1])
    return tuple(found)


def _first(all_bands: tuple[Band, ...], size: int) -> int:
    a, b = 0, len(all_bands)
    while a < b:
        mid = (a + b) // 2
        if all_bands[mid].high < size:
            a = mid + 1
        else:
            b = mid
    return a


def _indexed(g: np.ndarray, v: np.ndarray, band: Band, turn: int) -> tuple[np.ndarray, int]:
    """Keys of a set under one band and hash, and the units it has lost."""
    m = band.whole + band.deleted
    segment = ((g >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(segment, minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, v)
    tag = (np.arange(m, dtype=np.uint64) + np.uint64(band.number * ROUNDS + turn << 32)) * np.uint64(0x9E3779B97F4A7C15)
    full = count > 0
    keys = [total[full] + tag[full]]
    lost = int((~full[band.deleted :]).sum())
    if band.deleted:
        lost += 2 * int((count[: band.deleted] <= 1).sum())
        at = np.flatnonzero((segment < band.deleted) & (count[segment] > 1))
        keys.append(total[segment[at]] - v[at] + tag[segment[at]])
    return mix(np.concatenate(keys)), lost


def set_keys(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """All keys of a set of 64-bit tokens; two linked sets that differ share one at least."""
    out = []
    v = mix(tokens)
    for band in band_of(len(tokens), p, q):
        if not band.most:
            continue  # only equal sets are linked
        for turn in range(ROUNDS + 1):
            if turn == ROUNDS:
                out.append(mix(np.array([0xABCDEF0000000000 + band.number], np.uint64)))
                break
            keys, lost = _indexed(mix(v ^ np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), v, band, turn)
            out.append(keys)
            if lost <= band.slack:
                break
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    """Whether two sorted sets have q * |a and b| >= p * |a or b|."""
    x, y = len(a), len(b)
    if not x or not y or min(x, y) * q < max(x, y) * p:
        return False
    common = x + y - len(np.unique(np.concatenate([a, b])))
    return q * common >= p * (x + y - common)
