"""Two public tokenizers whose texts can be cut where neither joins anything across the cut.

A cut is a single space between two characters that are no white space. The
byte-level pattern of A starts a new piece there, and no piece of B has a space
mark behind another character (checked on loading), so the tokens of a text are
the tokens of its cut units in order. Words repeat; each distinct unit is
encoded once per task.
"""

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 300_000
# Fixed value: how the byte-level scheme of A cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The characters byte-level vocabularies write for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _digits(count: int) -> np.ndarray:
    """Row i: the decimal digits of i, zero bytes behind, and a place for a separator."""
    width = len(str(max(count - 1, 0)))
    return np.array([str(i).encode() for i in range(count)], dtype=f"S{width + 1}").view(
        np.uint8).reshape(count, width + 1)


class Ragged:
    """Lists of integers, appended and fetched by number."""

    def __init__(self):
        self.values, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.sizes, self.count, self.used = np.zeros(1 << 12, np.int32), 0, 0

    def extend(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        for name, need in (("values", self.used + len(flat)), ("starts", self.count + len(lists)),
                           ("sizes", self.count + len(lists))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, len(have)), have.dtype)]))
        self.values[self.used:self.used + len(flat)] = flat
        here = slice(self.count, self.count + len(lists))
        self.sizes[here] = sizes
        self.starts[here] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.count, self.used = self.count + len(lists), self.used + len(flat)

    def fetch(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of the given numbers, one behind the other."""
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(self.starts[numbers] - before, sizes)
        return self.values[at]


class _Numbers(dict):
    """unit -> number; a unit not met before is queued for encoding."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Encoders:
    def __init__(self, folder: str):
        import sentencepiece

        self.bytes_a, self.encode_a = _byte_level(os.path.join(folder, BYTE_LEVEL))
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of the second tokenizer crosses spaces: texts cannot be cut there")
        if len(self.bytes_a) * len(pieces) >= 1 << 32:
            raise ValueError("too many id pairs for 32 bits")
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids_a, self.ids_b = _Numbers(), Ragged(), Ragged()
        self.sound, self.odd = np.zeros(0, bool), np.zeros(0, bool)

    def _learn(self) -> None:
        """Encode the queued units."""
        units, self.numbers.fresh = self.numbers.fresh, []
        ids_a = [self.encode_a(" " + u) for u in units]
        ids_b = self.b.encode(units, num_threads=1)
        whole = [b" " + u.encode() for u in units]
        parts_a = [b"".join(map(self.bytes_a.__getitem__, ids)) for ids in ids_a]
        parts_b = [b"".join(map(self.bytes_b.__getitem__, ids)) for ids in ids_b]
        sound = np.array([a == w == b for a, w, b in zip(parts_a, whole, parts_b)], bool)
        self.ids_a.extend(ids_a)
        self.ids_b.extend(ids_b)
        self.sound = np.concatenate([self.sound, sound])
        self.odd = np.concatenate([self.odd, np.array(
            [not u or u[0].isspace() or u[-1].isspace() for u in units], bool)])

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the units of " " + text, for each text."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        known = self.numbers.__getitem__
        found = [np.fromiter(map(known, parts), np.int64, len(parts)) for parts in (t.split(" ") for t in texts)]
        if self.numbers.fresh:
            self._learn()
        for i, numbers in enumerate(found):
            if self.odd[numbers].any():
                parts = joined(texts[i].split(" "))
                found[i] = np.fromiter(map(known, parts), np.int64, len(parts))
        if self.numbers.fresh:
            self._learn()
        return found


def joined(parts: list[str]) -> list[str]:
    """Parts between spaces, those put together again between which no cut is allowed."""
    out, now = [], [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if before and part and not before[-1].isspace() and not part[0].isspace():
            out.append(" ".join(now))
            now = []
        now.append(part)
    out.append(" ".join(now))
    return out


def _byte_level(path: str):
    """The bytes of every id of A, and a function encoding a text without special tokens.

    The merges of such a file are listed in the order of the ids they make; a table of
    ranks then holds all of it, and the faster of the two public libraries can read it.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    symbols, special = _byte_symbols(), set()
    names = [""] * (1 + max(model["vocab"].values()))
    for name, number in model["vocab"].items():
        names[number] = name
        if not all(c in symbols for c in name):
            special.add(number)
    whole = Tokenizer.from_file(path)
    special |= set(whole.get_added_tokens_decoder())
    names += [""] * (whole.get_vocab_size() - len(names))
    spelled = [b"" if i in special else bytes(symbols[c] for c in name) for i, name in enumerate(names)]
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    ranks = {x: i for i, x in enumerate(spelled) if x}
    if made == sorted(made) and len(ranks) == 256 + len(made) and all(ranks.get(bytes([b]), made[0]) < made[0] for b in range(256)):
        import tiktoken

        core = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return spelled, core.encode_ordinary
    whole.encode_special_tokens = True
    return spelled, lambda text: whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def load(folder: str) -> Encoders:
    """The encoders of this task's process."""
    return Encoders(folder)
