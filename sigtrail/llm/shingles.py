"""Word shingles of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once (a longer text is taken alone), and bytes of words hashed at once.
SLICE_BYTES, HASH_BYTES = 1 << 20, 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, HASH_BYTES + 1), base, _U)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from sums over the bytes up to its start and its end."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(b - a + 1, _U)
        np.cumsum((raw[a:b].astype(_U) + _U(1)) * _power("inverse", _INVERSE, b - a), out=sums[1:])
        at, to = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[to] - sums[at]) * _power("base", _BASE, b - a + 1)[to] + (to - at).astype(_U))
        i = j
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the column: index of the first text, bounds of the texts' sets, and hashes, sorted and distinct per text.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer words than width has its whole sequence as its
    shingle; one without words has an empty set. Nulls count as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    factors = mix(np.arange(1, width + 1, dtype=_U) * _U(_BASE)) | _U(1)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        own = offsets[first : last + 1] - a
        raw = _LOWER[data[a:b]]
        inside = ~_SEPARATOR[raw]
        bound = np.zeros(b - a + 1, bool)
        bound[own] = True
        starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | bound[:-1])) if b > a else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | bound[1:])) + 1 if b > a else starts
        words = _word_hashes(raw, starts, ends)
        text_of = np.searchsorted(own, starts, "right") - 1
        n_words = np.bincount(text_of, minlength=last - first)
        whole = len(words) - width + 1
        hashes, owner = np.zeros(0, _U), np.zeros(0, np.int64)
        if whole > 0:
            full = text_of[:whole] == text_of[width - 1 :]
            sums = np.zeros(whole, _U)
            for k in range(width):
                sums += words[k : whole + k] * factors[k]
            hashes, owner = mix(sums[full]), text_of[:whole][full]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            begins = np.concatenate(([0], np.cumsum(n_words)))
            extra = [mix(np.sum(words[begins[t] : begins[t + 1]] * factors[: n_words[t]], keepdims=True) + _U(n_words[t])) for t in short]
            hashes, owner = np.concatenate([hashes, *extra]), np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
            hashes, owner = hashes[new], owner[new]
        yield first, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=last - first)))), hashes
        first = last


def set_id(hashes: np.ndarray) -> int:
    """Identity of a set of shingles: 64 signed bits that depend on all its hashes and its size."""
    if not len(hashes):
        return 0
    total = np.sum(mix(hashes ^ _U(_BASE)), dtype=_U, keepdims=True) ^ (np.bitwise_xor.reduce(mix(hashes * _U(_BASE)), keepdims=True) * _U(3))
    return int(mix(total + _U(len(hashes))).view(np.int64)[0])


def set_check(hashes: np.ndarray) -> int:
    """Another 64 signed bits of a set, by sums of other bijections than set_id's: sets that agree in both are taken as equal."""
    if not len(hashes):
        return 0
    turned = mix(hashes + _U(0xD1B54A32D192ED03))
    total = np.sum(mix(turned ^ (turned << _U(1))), dtype=_U, keepdims=True) + np.bitwise_xor.reduce(mix(turned * _U(_INVERSE)), keepdims=True) * _U(5)
    return int(mix(total ^ _U(len(hashes))).view(np.int64)[0])
