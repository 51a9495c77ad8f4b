"""Sets of hashed word shingles of whole texts, in arrays."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_ODD = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Fixed random words: a value for each byte, the base of a word's polynomial, a factor for each place.
_BYTE = _ODD(256)
_BASE = _ODD(1)[0]
_PLACE = _ODD(64)
_SHORT = _ODD(64)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text that are hashed at once.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a lower-cased buffer and where they begin."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    white = _WHITE[data]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    starts = np.flatnonzero(~white & before)
    if not starts.size:
        return np.empty(0, np.uint64), starts
    spans = np.diff(np.concatenate([[0], starts, [len(data)]]))
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), spans)
    powers = np.full(int(place.max()) + 1, _BASE)
    powers[0] = 1
    values = _BYTE[data] * np.multiply.accumulate(powers)[place]
    values[white] = 0
    return mix(np.add.reduceat(values, starts)), starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    hashes, counts = [], []
    batch, held = [], 0

    def flush() -> None:
        nonlocal batch, held
        if batch:
            h, starts = _word_hashes((b"\n".join(batch) + b"\n").translate(_LOWER))
            ends = np.cumsum([len(x) + 1 for x in batch])
            counts.extend(np.diff(np.concatenate([[0], np.searchsorted(starts, ends)])).tolist())
            hashes.append(h)
        batch, held = [], 0

    for text in texts:
        if len(text) > STEP:  # hashed in parts that end between words
            flush()
            n, at = 0, 0
            while at < len(text):
                end = at + STEP
                while end < len(text) and not _WHITE[text[end]]:
                    end += 1
                h, _ = _word_hashes((text[at:end] + b"\n").translate(_LOWER))
                hashes.append(h)
                n, at = n + len(h), end
            counts.append(n)
            continue
        if held + len(text) > STEP:
            flush()
        batch.append(text)
        held += len(text) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.array(counts, dtype=np.int64)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of fewer words, of all of
    them as one; none without words."""
    w, n = words([(x or "").encode("utf-8", "surrogatepass") for x in texts])
    ends = np.cumsum(n)
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, dtype=np.uint64)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * _PLACE[j]
        h = mix(h)
    out = []
    for end, size in zip(ends.tolist(), n.tolist(), strict=True):
        if size >= k:
            x = np.sort(h[end - size : end - k + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif size:
            out.append(mix((w[end - size : end] * _SHORT[:size]).sum(keepdims=True) + _SHORT[size + 8 : size + 9]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
