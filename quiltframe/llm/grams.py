"""Hashed character n-grams of texts and linear models over them."""

import numpy as np

DIMENSIONS = 4096
_letters = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
_SPACE = np.uint32(32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _letters[codes]


def gram_vector(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Root shares of the hashed 1-, 2- and 3-grams; length 1, or 0 for no code points."""
    x = codes.astype(np.uint64) + np.uint64(1)
    seed = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    shift = np.uint64(64 - int(dimensions).bit_length() + 1)
    counts = np.zeros(dimensions)
    value = x * seed[0]
    for i in range(3):
        if i:
            value = (value[:-1] ^ (value[:-1] >> np.uint64(29))) * seed[i] + x[i:] * seed[0]
        if not len(value):
            break
        hashed = (value ^ (value >> np.uint64(32))) * seed[2]
        counts += np.bincount((hashed >> shift).astype(np.int64), minlength=dimensions)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def _accelerated(gradient, size: int, smooth: float, steps: int) -> np.ndarray:
    """Nesterov's method for a function with `smooth`-Lipschitz gradient."""
    w, ahead, t = np.zeros(size), np.zeros(size), 1.0
    for _ in range(steps):
        new = ahead - gradient(ahead) / smooth
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - w)
        w = new
    return w


def train_svm(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, steps: int = 200) -> np.ndarray:
    """Weights and offset of a linear support vector machine (squared hinge, classes balanced)."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))

    def gradient(w):
        slack = np.maximum(0, 1 - y * (x @ w.astype(x.dtype)))
        return w - 2 * cost * (x.T @ (share * slack * y).astype(x.dtype))

    return _accelerated(gradient, x.shape[1], 1 + 4 * cost, steps)


def train_logistic(x: np.ndarray, target: np.ndarray, cost: float = 5000.0, steps: int = 500) -> np.ndarray:
    """Weights and offset of a logistic model for targets in [0, 1]."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])

    def gradient(w):
        p = 1 / (1 + np.exp(-(x @ w.astype(x.dtype))))
        return w + cost * (x.T @ ((p - target) / len(x)).astype(x.dtype))

    return _accelerated(gradient, x.shape[1], 1 + cost / 2, steps)
