"""SuperMinHash signatures (Ertl 2017) of many multisets at once.

Every element has a random permutation of the signature's slots, made step by step by swaps. At step j the element
offers j + r, r in [0, 1), to the slot that its permutation has at j; a slot keeps the least offer. The ranks within an
element are thus all different, which gives the estimate of similarity a lower variance than independent minima. Once
all slots of a record hold offers of steps up to j, no later step can change them: the record is done (early stop,
with the same result). Steps run over all elements of a batch; permutations are made once per distinct element.
"""

from __future__ import annotations

import numpy as np

from loomtext.llm.words import mix

_STEP = 0xD1B54A32D192ED03
_FRACTION = 22


def multiset_elements(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, owner): hashes of (word, how many-th occurrence in the record), ordered by record."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    order = np.lexsort((hashes, owner)) if len(counts) >= 1 << 24 else np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)), kind="stable")
    h = hashes[order]
    n = len(h)
    if not n:
        return h, owner
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(n)
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(h + nth.astype(np.uint64) * np.uint64(_STEP)), owner


def signatures(elements: np.ndarray, owner: np.ndarray, records: int, slots: int) -> np.ndarray:
    """records x slots of uint32; two records agree in a slot with the probability of their Jaccard similarity. A
    record without elements has the greatest value everywhere."""
    sig = np.full(records * slots, 0xFFFFFFFF, np.uint32)
    values, which = np.unique(elements, return_inverse=True)
    perm = np.tile(np.arange(slots, dtype=np.int16), (len(values), 1))
    rows = np.arange(len(values))
    base = owner * slots
    for j in range(slots):
        rnd = mix(values + np.uint64((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & np.uint64(0xFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
        here, there = perm[:, j].copy(), perm[rows, k]
        perm[rows, k] = here
        perm[:, j] = there
        offer = (np.uint32(j << _FRACTION) | (rnd >> np.uint64(64 - _FRACTION)).astype(np.uint32)).astype(np.uint32)
        np.minimum.at(sig, base + there[which], offer[which])
        if j % 4 == 3 or j == slots - 1:
            open_ = sig.reshape(records, slots).max(axis=1) >= (j + 1) << _FRACTION
            keep = open_[owner]
            if not keep.all():
                owner, which, base = owner[keep], which[keep], base[keep]
                if not len(owner):
                    break
                if len(owner) < len(rows):
                    left, which = np.unique(which, return_inverse=True)
                    values, perm = values[left], perm[left]
                    rows = np.arange(len(values))
    return sig.reshape(records, slots)


def bands(sig: np.ndarray, count: int, width: int) -> np.ndarray:
    """records x count keys (int64 of 48 bits): 40 bits of a hash of the ``width`` slots of a band, then 8 of the band. Bands
    that need more slots than there are take them in further orders."""
    if count > 256:
        raise ValueError("at most 256 bands")
    rng, slots, each = np.random.default_rng(5), np.arange(sig.shape[1]), sig.shape[1] // width
    rounds = [slots if i == 0 else rng.permutation(slots) for i in range(-(-count // each))]
    taken = np.concatenate([x[: each * width].reshape(each, width) for x in rounds])[:count]
    key = np.zeros((len(sig), count), np.uint64)
    for i in range(width):
        key = mix(key + sig[:, taken[:, i]].astype(np.uint64) + np.uint64(1))
    key = (key >> np.uint64(24) << np.uint64(8)) | np.arange(count, dtype=np.uint64)
    return key.view(np.int64)
