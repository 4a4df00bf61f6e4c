"""Context-tree weighting over bytes, as numpy kernels on tables of grams.

A gram is ``depth`` context bytes followed by one symbol byte.  The symbol is
coded as eight binary decisions, most significant bit first; each of the 255
bit nodes owns one binary context tree over the preceding bytes.  A tree node
holds Krichevsky-Trofimov counts (a zeros, b ones) and

    P_w(node) = 1/2 P_KT(a, b) + 1/2 prod P_w(children)     (P_KT at the deepest)

so one pass over counts gives the exact mixture over all tree shapes; the order
in which bytes were seen does not matter to a KT estimate.  Prediction mixes
the KT estimates along the context path, deepest first:

    p_d = w_d KT_d + (1 - w_d) p_{d+1},   w_d = 1/2 P_KT / P_w

Keys put the nearest context byte first, so that cutting bytes off the end of
the context moves to the parent and everything below one nearest byte can be
solved apart from the rest.
"""

from __future__ import annotations

import numpy as np

LN_HALF = float(np.log(0.5))


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after a shift by ten."""
    z = x + 10.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi)
    series += 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    for k in range(10):
        series -= np.log(x + k)
    return series


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any sequence with a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


def _grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, the place of each row's key among them, weights summed by key."""
    own, place = np.unique(keys, return_inverse=True)
    return own, place, [np.bincount(place, w, minlength=len(own)) for w in weights]


def solve(codes: np.ndarray, counts: np.ndarray, depth: int, top: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Predictions for every gram, mixed over the depths ``top``..``depth``.

    codes: uint64 grams, nearest context byte in the highest place, symbol in
    the lowest byte.  counts: training occurrences, 0 for grams that only the
    scored texts have.  Returns (p, ln_pw): p[i, l] is the mixed probability of
    bit l of gram i, ln_pw[i, l] the ln P_w of gram i's node at depth ``top``.
    """
    n, counts = len(codes), counts.astype(np.float64)
    symbols = (codes & np.uint64(255)).astype(np.int64)
    contexts = codes >> np.uint64(8)
    p, out_pw = np.empty((n, 8)), np.empty((n, 8))
    for level in range(8):
        prefix = (symbols >> (8 - level)) | (1 << level)  # 1..255 names the bit node
        bit = (symbols >> (7 - level)) & 1
        ones = counts * bit
        mixed, ln_children, below = None, None, None
        for d in range(depth, top - 1, -1):
            keys = ((contexts >> np.uint64(8 * (depth - d))) << np.uint64(8)) | prefix.astype(np.uint64)
            own, place, (total, b) = _grouped(keys, counts, ones)
            a = total - b
            ln_pe = ln_kt(a, b)
            if ln_children is None:
                ln_pw, w = ln_pe, np.ones(len(own))
            else:
                parent = np.searchsorted(own, ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255)))
                down = LN_HALF + np.bincount(parent, ln_children, minlength=len(own))
                ln_pw = np.logaddexp(LN_HALF + ln_pe, down)
                w = np.exp(LN_HALF + ln_pe - ln_pw)
            kt = np.where(bit == 1, b[place] + 0.5, a[place] + 0.5) / (total[place] + 1.0)
            mixed = kt if mixed is None else w[place] * kt + (1 - w[place]) * mixed
            ln_children, below = ln_pw, own
        p[:, level], out_pw[:, level] = mixed, ln_pw[place]
    return p, out_pw


def _packed(data: np.ndarray, depth: int, alphabet: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """The gram of each byte after the first ``depth``, its bytes numbered by their
    place in the alphabet, and the bits of such a number.  Nearest context byte
    first, ..., farthest, then the symbol."""
    n, width = len(data) - depth, np.uint64(max(1, (len(alphabet) - 1).bit_length()))
    table = np.zeros(256, np.uint64)
    table[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    dense = table[data]
    keys = dense[depth - 1 : depth - 1 + n].copy()
    for o in [*range(depth - 2, -1, -1), depth]:
        keys <<= width
        keys |= dense[o : o + n]
    return keys, width


def _codes(keys: np.ndarray, width: np.uint64, alphabet: np.ndarray, depth: int) -> np.ndarray:
    """The grams that are packed in keys, which are lost."""
    wide, low = alphabet.astype(np.uint64), (np.uint64(1) << width) - np.uint64(1)
    codes = wide[keys & low]
    for k in range(1, depth + 1):
        keys >>= width
        codes |= wide[keys & low] << np.uint64(8 * k)
    return codes


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from the one before."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


def block_grams(data: np.ndarray, depth: int, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, place): the distinct grams of a byte block that has ``depth``
    lead bytes, and for each later byte (of those that are real) the place of
    its gram in codes.

    Grams and their positions are sorted as one number where they fit in 64
    bits, which is so for depth 5 and a megabyte of at most 128 different bytes."""
    if len(data) <= depth:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(data, minlength=256))
    keys, width = _packed(data, depth, alphabet)
    keys = keys if real is None else keys[real]
    n = len(keys)
    here = np.uint64(n.bit_length())
    if int(width) * (depth + 1) + int(here) > 64:
        own, place = np.unique(keys, return_inverse=True)
        return _codes(own, width, alphabet, depth), place.astype(np.int32)
    keys <<= here
    keys |= np.arange(n, dtype=np.uint64)
    keys.sort()
    at = (keys & ((np.uint64(1) << here) - np.uint64(1))).view(np.int64)
    keys >>= here
    new = _firsts(keys)
    place, ids = np.empty(n, np.int32), np.cumsum(new, dtype=np.int32)
    ids -= np.int32(1)
    place[at] = ids
    return _codes(keys[new], width, alphabet, depth), place


def count_grams(data: np.ndarray, depth: int, kinds: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, n) for each kind, a mask of the bytes after the lead bytes: the
    distinct grams of these bytes and how often they come."""
    alphabet = np.flatnonzero(np.bincount(data, minlength=256))
    keys, width = _packed(data, depth, alphabet)
    found = []
    for kind in kinds:
        own = keys[kind]
        own.sort()
        first = np.flatnonzero(_firsts(own))
        found.append((_codes(own[first], width, alphabet, depth), np.diff(first, append=len(own))))
    return found
