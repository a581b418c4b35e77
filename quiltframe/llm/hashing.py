"""Vectorised hashes of words and byte windows, used inside tasks."""

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_tables = {"size": 0, "power": None, "inverse": None}


def _powers(size: int):
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if _tables["size"] < size:
        size = max(size, 1 << 16, 2 * _tables["size"])
        for name, base in (("power", MULTIPLIER), ("inverse", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        _tables["size"] = size
    return _tables["power"], _tables["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] stands for data[:i]; see `span_hashes`."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]: equal contents have equal hashes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, with A-Z lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    step = np.diff(inside)
    return span_hashes(prefix_sums(data), np.flatnonzero(step == 1), np.flatnonzero(step == -1))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words.

    A text of fewer words has its whole sequence as one shingle, one of no words none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    factors = mix(np.arange(1, max(width, 2) + 1, dtype=np.uint64)) | np.uint64(1)
    if len(words) < width:
        whole = (words * factors[:len(words)]).sum(dtype=np.uint64)
        return mix(np.array([whole + np.uint64(len(words))], dtype=np.uint64) ^ np.uint64(MULTIPLIER))
    count = len(words) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        total += words[i:i + count] * factors[i]
    return np.unique(mix(total))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values (two running minima per block)."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    top = np.iinfo(values.dtype).max
    blocks = np.full(-(-len(values) // width) * width, top, dtype=values.dtype)
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1:width - 1 + count])
