"""SuperMinHash signatures for many sets at once.

Each element draws a random permutation of the slots, one position after another, and
offers slot p(j) the value j + r_j; a slot keeps the least value offered. As the elements'
slots are drawn without replacement the slots are negatively correlated, which lowers the
variance of the estimate on small sets. Step j can't lower a slot that holds less than j,
so a set is done as soon as all its slots do: a set much larger than the signature takes
one step an element.
"""

from __future__ import annotations

import numpy as np

from cairnkit.llm._util import GOLDEN, mix

_EMPTY = np.uint64(2**64 - 1)


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """uint32 signatures, a row a set; elements of set i are elements[starts[i]:starts[i+1]].

    Repeated elements change nothing. An empty set has all slots at 2**32 - 1.
    """
    sets = len(starts) - 1
    table = np.full((sets, slots), _EMPTY, dtype=np.uint64)
    flat = table.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(starts))
    live, perm = elements, None
    for step in range(slots):
        if len(live) == 0:
            break
        x = mix(live + np.uint64((step + 1) * int(GOLDEN) % 2**64))
        pick = step + ((x & np.uint64(0xFFFF)) * np.uint64(slots - step) >> np.uint64(16)).astype(np.int64)
        value = (x >> np.uint64(16)) | (np.uint64(step) << np.uint64(48))
        if step == 0:
            slot = pick
        else:
            line = np.arange(len(live))
            slot = perm[line, pick].astype(np.int64)
            perm[line, pick] = perm[line, step]
        np.minimum.at(flat, owner * slots + slot, value)
        mine = np.unique(owner)
        open_sets = np.zeros(sets, dtype=bool)
        open_sets[mine] = table[mine].max(axis=1) >= (np.uint64(step + 1) << np.uint64(48))
        keep = open_sets[owner]
        if step == 0:
            live, owner, pick = live[keep], owner[keep], pick[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(live), 1))
            perm[np.arange(len(live)), pick] = 0
        elif not keep.all():
            live, owner, perm = live[keep], owner[keep], perm[keep]
    out = (mix(table.copy()) >> np.uint64(32)).astype(np.uint32)
    out[np.diff(starts) == 0] = 0xFFFFFFFF
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """int64 keys, a row a set and a column a band, of equal runs of the slots."""
    sets, slots = sig.shape
    width = slots // bands
    keys = np.empty((sets, bands), dtype=np.uint64)
    for b in range(bands):
        total = np.full(sets, (b + 1) * int(GOLDEN) % 2**64, dtype=np.uint64)
        for k in range(b * width, (b + 1) * width):
            total = mix(total * np.uint64(0xD1342543DE82EF95) + sig[:, k].astype(np.uint64))
        keys[:, b] = total
    return keys.view(np.int64)
