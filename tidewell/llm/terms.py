"""Words and word k-mers as 64-bit hashes, alike in every process."""

from __future__ import annotations

import numpy as np
import pandas as pd

_U = np.uint64
_STEP, _MIX = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit values, one to one."""
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's lower-cased words between white space."""
    words = [t.lower().split() for t in texts]
    every = np.array([w for each in words for w in each], dtype=object)
    hashed = pd.util.hash_array(every, categorize=False) if len(every) else np.zeros(0, _U)
    return np.split(hashed, np.cumsum([len(w) for w in words])[:-1]) if words else []


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; of all words where there are fewer; none of none."""
    k = min(k, len(words))
    if not k:
        return words[:0]
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = mixed(out * _STEP + words[j : len(words) - k + 1 + j])
    return mixed(out + _U(k))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many times each value has come before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return out


def stretches(texts: list[str] | list[int], most: int = 1_000_000):
    """(from, to) of stretches of about so many characters, one text at least; of texts or their lengths."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < most):
            size += texts[upto] if isinstance(texts[upto], int) else len(texts[upto])
            upto += 1
        yield at, upto
        at = upto
