"""Word shingles of whole texts, hashed with array operations."""

from __future__ import annotations

import functools

import numpy as np

from tessera.llm.pretokens import LETTER, NUMBER, class_table

#: A text of fewer words is one shingle of all its words.
WORDS = 5
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit hashes."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    n = 1 << bits
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        powers = np.full(n, np.uint64(base))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word: a run of letters and digits in lower case."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join([*lowered, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = class_table()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    up, down = _powers(max(16, int(len(points)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) * up[: len(points)])])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.searchsorted(bounds, first, "right")


def shingle_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and hash: text number, hash, how often it stands there."""
    words, owner = word_hashes(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        shingles += words[j : j + len(shingles)] * np.uint64(2 * j + 1) * np.uint64(0xA24BAED4963EE407) + (words[j : j + len(shingles)] >> np.uint64(17 + j))
    whole = owner[: len(shingles)] == owner[WORDS - 1 :]
    hashes, owners = shingles[whole], owner[: len(shingles)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        ends = np.cumsum(sizes)
        extra = [int(sum(int(words[ends[d] - 1 - j]) * (2 * j + 3) for j in range(sizes[d])) & (1 << 64) - 1) for d in short]
        hashes, owners = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owners, short])
    hashes = mix(hashes)
    order = np.argsort(hashes)
    order = order[np.argsort(owners[order].astype(np.int32), kind="stable")]
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(new)
    return owners[at], hashes[at], np.diff(at, append=len(hashes))
