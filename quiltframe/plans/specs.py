"""Declarative column specs: what a made column looks like, not how to loop over rows."""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltframe import constants as K
from quiltframe.functions import draws as D


@dataclass(frozen=True)
class Pick:
    """One of a list of values, equally likely or by weight."""
    values: tuple
    weights: tuple | None = None

    def build(self, d: D.Draws, ctx) -> Column:
        if self.weights:
            return D.weighted(d.next(), list(self.values), list(self.weights))
        return D.pick(d.next(), list(self.values))


@dataclass(frozen=True)
class Whole:
    """Integer of [low, high)."""
    low: int
    high: int

    def build(self, d, ctx):
        return D.whole(d.next(), self.low, self.high)


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    places: int

    def build(self, d, ctx):
        return D.real(d.next(), self.low, self.high, self.places)


@dataclass(frozen=True)
class Uniform:
    """A number between low and high, not rounded."""
    low: float
    high: float

    def build(self, d, ctx):
        return F.lit(float(self.low)) + d.next() * F.lit(float(self.high) - float(self.low))


@dataclass(frozen=True)
class Flag:
    """True with probability p."""
    p: float

    def build(self, d, ctx):
        return d.next() < F.lit(self.p)


@dataclass(frozen=True)
class Gauss:
    mean: float
    deviation: float

    def build(self, d, ctx):
        return F.lit(self.mean) + F.lit(self.deviation) * d.next_normal()


@dataclass(frozen=True)
class Coded:
    """Prefix and an integer of [low, high), zero-padded to a width."""
    prefix: str
    low: int
    high: int
    width: int = 1

    def build(self, d, ctx):
        if self.high - self.low > 10 ** 8:
            # Two draws: one 32-bit word is too coarse for this many outcomes.
            step = 10 ** 6
            wide = D.whole(d.next(), self.low // step, self.high // step) * F.lit(step)
            number = wide + D.whole(d.next(), 0, step)
        else:
            number = D.whole(d.next(), self.low, self.high)
        shown = number.cast("string")
        if self.width > 1:
            # lpad() would cut longer numbers, which the range rules out.
            assert len(str(self.high - 1)) <= self.width
            shown = F.lpad(shown, self.width, "0")
        return F.concat(F.lit(self.prefix), shown) if self.prefix else shown


@dataclass(frozen=True)
class Uuid:
    length: int = 36

    def build(self, d, ctx):
        text = D.uuid_text(d.next_hex())
        return text if self.length == 36 else F.substring(text, 1, self.length)


@dataclass(frozen=True)
class Ago:
    """Timestamp up to so many seconds before the reference time."""
    seconds: int

    def build(self, d, ctx):
        back = D.whole(d.next(), 0, self.seconds)
        return F.timestamp_add("SECOND", -back, F.lit(ctx.as_of).cast("timestamp_ntz"))


@dataclass(frozen=True)
class DaysAgo:
    """Date [low, high) days before the reference time."""
    low: int
    high: int

    def build(self, d, ctx):
        back = D.whole(d.next(), self.low, self.high).cast("int")
        return F.date_sub(F.to_date(F.lit(ctx.as_of).cast("timestamp_ntz")), back)


@dataclass(frozen=True)
class Word:
    """An entry of one of our own vocabularies."""
    vocabulary: str

    def build(self, d, ctx):
        return D.pick(d.next(), getattr(K, self.vocabulary))


@dataclass(frozen=True)
class Sentence:
    words: int = 6

    def build(self, d, ctx):
        picks = [D.pick(d.next(), K.WORDS) for _ in range(self.words)]
        text = F.concat_ws(" ", *picks)
        return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


@dataclass(frozen=True)
class Maybe:
    """A spec with probability p, NULL otherwise."""
    spec: Any
    p: float

    def build(self, d, ctx):
        chance = d.next()
        return F.when(chance < F.lit(self.p), self.spec.build(d, ctx))


@dataclass(frozen=True)
class Derived:
    """A SQL expression over columns of the same row (made before this one) and row_id.

    {n} stands for the number of rows, {as_of} for the reference time.
    """
    sql: str

    def build(self, d, ctx):
        return F.expr(self.sql.format(n=ctx.n, as_of=ctx.as_of))


@dataclass(frozen=True)
class Context:
    as_of: str
    n: int
