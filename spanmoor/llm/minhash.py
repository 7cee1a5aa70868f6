"""SuperMinHash signatures and their bands.

Each element of a set draws a random permutation of the slots and offers the
value j + r, with a fraction r of its own, to the j-th slot of it. A slot keeps
its least offer. Offers are made in rounds of j for all elements at once; when
every slot of a set holds an offer, later rounds only bring greater ones, and
the set is done.
"""

from __future__ import annotations

import math

import numpy as np

from .common import _MUL, mix64

#: A pair of sets of similarity 0.85 shares none of 28 bands of 5 slots with
#: probability (1 - 0.85**5)**28 < 1e-7.
BANDS, ROWS = 28, 5
PERCENT = 85
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FRACTION = np.uint64((1 << 40) - 1)


def bands_for(percent: int) -> int:
    """The bands, BANDS at least, that miss a pair of this similarity as rarely as
    BANDS miss one of PERCENT: 42 at 80."""
    missed = BANDS * math.log1p(-((PERCENT / 100) ** ROWS))
    return max(BANDS, math.ceil(missed / math.log1p(-((percent / 100) ** ROWS)))) if percent < PERCENT else BANDS


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """(sets, slots) least offers; ``owner`` numbers each element's set. Empty
    sets keep the greatest value everywhere."""
    out = np.full(sets * slots, _NONE, np.uint64)
    perm = None
    for j in range(slots):
        r = mix64(elements + np.uint64((2 * j + 1) * int(_MUL) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            at = k
            first = k
        else:
            if perm is None:  # most sets are done after a few rounds; only then is the permutation spelled out
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
                lane = np.arange(len(elements))
                perm[lane, first] = 0
                perm[:, 0] = first
            at = perm[lane, k].astype(np.int64)
            perm[lane, k] = perm[:, j]
            perm[:, j] = at
        value = np.uint64(j) << np.uint64(40) | (r & _FRACTION)
        np.minimum.at(out, owner * slots + at, value)
        open_ = (out.reshape(sets, slots) == _NONE).any(1)
        going = open_[owner]
        if not going.any():
            break
        if not going.all():
            elements, owner = elements[going], owner[going]
            if perm is not None:
                perm = perm[going]
                lane = np.arange(len(elements))
            else:
                first = first[going]
    return out.reshape(sets, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) hashes of the bands, each salted with its number."""
    parts = signature.reshape(len(signature), bands, -1)
    h = np.tile(np.arange(bands, dtype=np.uint64) * _MUL, (len(signature), 1))
    for i in range(parts.shape[2]):
        h = mix64(h + parts[:, :, i] + _MUL)
    return h


def distinct_elements(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of each set, sorted within it; ``owner`` ascends."""
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    return e[new], o[new]
