"""Vectorised text helpers that run inside Arrow tasks.

Words are runs of bytes outside ASCII white space with A-Z lower-cased. A batch
of texts is laid end to end and hashed with numpy in slices of half a MB, so the
memory a task needs follows the longest single text, not the batch.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 19
SHINGLE = 5

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        a = np.full(max(n, SLICE + 4096), base, _U)
        a[0] = 1
        _powers[name] = np.multiply.accumulate(a)
    return _powers[name][:n]


def _slices(blob: bytes):
    """Pieces of about SLICE bytes, cut at white space only."""
    at, n = 0, len(blob)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not _SPACE[blob[end]]:
            end += 1
        yield blob[at:end]
        at = end


def _hash_words(blob: bytes, fold: bool):
    """Hash, start and end of each word in one slice."""
    raw = np.frombuffer(blob, np.uint8)
    word = np.empty(len(raw) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(_SPACE[raw], out=word[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(word))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER if fold else _BYTE)[raw] * _power(_PRIME, "up", len(raw)), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, "down", len(raw) + 1)[start]
    return mix(h + (end - start).astype(_U)), start, end


def word_hashes(texts, fold: bool = True):
    """Yield (index of the first text, words of each text, hashes) for runs of whole texts.

    A null text counts as one without words.
    """
    first, held, size = 0, [], 0

    def flush():
        joined = b" ".join(held) + b" "
        offsets = np.cumsum([0] + [len(b) + 1 for b in held])
        h, start, _ = _hash_words(joined, fold)
        return first, np.diff(np.searchsorted(start, offsets)), h

    for i, text in enumerate(texts):
        blob = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(blob) > SLICE:
            yield flush()
            first, held, size = i, [], 0
        if len(blob) > SLICE:
            h = np.concatenate([_hash_words(p, fold)[0] for p in _slices(blob)])
            yield i, np.array([len(h)]), h
            first = i + 1
            continue
        held.append(blob)
        size += len(blob) + 1
    if held:
        yield flush()


def windows(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words, in order."""
    k = SHINGLE
    if len(words) < k:
        return np.empty(0, _U)
    lanes = mix(np.arange(11, 11 + k, dtype=_U)) | _U(1)
    n = len(words) - k + 1
    run = np.zeros(n, _U)
    for j in range(k):
        run += words[j : n + j] * lanes[j]
    return mix(run)


def shingles(counts: np.ndarray, words: np.ndarray):
    """Yield for each text the sorted distinct hashes of its runs of five words.

    A text of one to four words has its whole sequence as one shingle; one
    without words has none.
    """
    k = SHINGLE
    lanes = mix(np.arange(11, 11 + k, dtype=_U)) | _U(1)
    run = windows(words)
    at = 0
    for c in counts.tolist():
        if c >= k:
            yield np.unique(run[at : at + c - k + 1])
        elif c:
            short = (words[at : at + c] * lanes[:c]).sum(dtype=_U) + _U(c)
            yield mix(mix(np.array([short], _U)) ^ _U(c))
        else:
            yield np.empty(0, _U)
        at += c
