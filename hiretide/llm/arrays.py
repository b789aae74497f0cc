"""Word and character arrays for the Arrow functions of this subpackage.

Texts become flat numpy arrays in blocks of bounded size, so the cost per
character is a few vector instructions and memory does not follow the largest
batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = re.compile(r"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans(sizes: list[int], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _pieces(text: str, limit: int = BLOCK) -> Iterator[str]:
    """Cuts a very long text between words."""
    at = 0
    while len(text) - at > limit:
        cut = WHITE.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def _hash_block(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the given texts, and words per text.

    A word's hash is a polynomial in its bytes: differences of one running sum,
    scaled back by the inverse power at the word's start.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in block]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    rising = powers(BASE, len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * rising)))
    falling = powers(BASE_INVERSE, len(data))
    hashes = mix((total[last] - total[first]) * falling[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(first, np.concatenate(([0], ends))))


def word_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: index of the first, hashes of all words, word counts.
    Words are runs of characters other than ASCII white space."""
    for a, b in spans([len(t) for t in texts]):
        if b == a + 1:
            parts = [_hash_block([p])[0] for p in _pieces(texts[a])]
            joined = np.concatenate(parts)
            yield a, joined, np.array([len(joined)])
        else:
            hashes, counts = _hash_block(texts[a:b])
            yield a, hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their number per text.  A text with
    fewer words, but at least one, has one shingle of all its words."""
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(len(words), dtype=np.uint64)
    for j in range(width):
        step = np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out[: max(0, len(words) - j)] += (words[j:] ^ np.uint64(j)) * step
    out = mix(out)
    keep = np.ones(len(words), dtype=bool)
    for j in range(1, width):
        keep[ends[counts >= j] - j] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        run = words[starts[i]:ends[i]]
        factors = powers(BASE, len(run) + 1)[1:]
        out[starts[i]] = mix(np.array([np.sum(run * factors) + np.uint64(len(run))], dtype=np.uint64))[0]
        keep[starts[i]] = True
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    return out[keep], sizes


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and their number per text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype="<u4"), np.array([len(r) // 4 for r in raw], dtype=np.int64)


# Multiplier of the nth character of an n-gram.
RISING_CHARS = powers(BASE, 16)

# Which code points of a page of 256 are letters, filled in as pages turn up.
_LETTER_PAGES: dict[int, np.ndarray] = {}


def is_letter(chars: np.ndarray) -> np.ndarray:
    """Unicode letters, looked up by pages of 256 code points."""
    out = np.zeros(len(chars), dtype=bool)
    pages = chars >> 8
    for page in np.unique(pages):
        if page not in _LETTER_PAGES:
            _LETTER_PAGES[page] = np.array([chr(int(page) * 256 + i).isalpha() for i in range(256)])
        at = pages == page
        out[at] = _LETTER_PAGES[page][chars[at] & 255]
    return out
