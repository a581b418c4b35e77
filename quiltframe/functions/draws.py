"""Random draws as pure functions of (seed, stream, row id).

A row's draws do not depend on partitioning, task retries or the number of
rows, so a lost executor recomputes the very same values.  One md5 digest
yields four 32-bit draws; digests are materialised as helper columns once per
row and the draws cut from them by position.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 2.0 ** 32


@dataclass
class Draws:
    """Hands out draw columns for one stream of one seed."""

    seed: int
    stream: str
    key: str = "row_id"
    taken: int = 0
    whole: int = 0
    digests: list[str] = field(default_factory=list)

    def _digest(self, label: str) -> str:
        name = f"_draw_{self.stream}_{label}"
        if name not in self.digests:
            self.digests.append(name)
        return name

    def slot(self, n: int) -> Column:
        """Draw number n of this stream, in (0, 1)."""
        name = self._digest(str(n // 4))
        word = F.conv(F.substring(F.col(name), 8 * (n % 4) + 1, 8), 16, 10).cast("bigint")
        return (word + F.lit(0.5)) / F.lit(WORD)

    def next(self) -> Column:
        self.taken += 1
        return self.slot(self.taken - 1)

    def next_normal(self) -> Column:
        return normal(self.next(), self.next())

    def next_hex(self) -> Column:
        """A whole 32-digit digest of its own."""
        self.whole += 1
        return F.col(self._digest(f"h{self.whole - 1}"))

    def next_fine(self) -> Column:
        """A draw of 52 bits, for choices among more outcomes than 32 bits can tell apart."""
        word = F.conv(F.substring(self.next_hex(), 1, 13), 16, 10).cast("bigint")
        return (word + F.lit(0.5)) / F.lit(2.0 ** 52)

    def attach(self, rows: DataFrame) -> DataFrame:
        """Add the digest columns every draw handed out so far reads."""
        prefix = len(f"_draw_{self.stream}_")
        return rows.withColumns({
            name: F.md5(F.concat_ws("|", F.col(self.key).cast("string"), F.lit(self.stream),
                                    F.lit(name[prefix:]), F.lit(str(self.seed))))
            for name in self.digests
        })


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal by Box and Muller, rounded so that engines agree."""
    return F.round(F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2), 6)


def index(u: Column, size: int) -> Column:
    return F.floor(u * F.lit(float(size))).cast("int")


def pick(u: Column, values: list) -> Column:
    """One of a short list of literals, each equally likely."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index(u, len(values)) + 1)


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """One of a short list of literals by weight, as a chain of thresholds."""
    total, chain = 0.0, None
    for value, weight in list(zip(values, weights))[:-1]:
        total = round(total + weight, 9)
        test, chosen = u < F.lit(total), F.lit(value)
        chain = F.when(test, chosen) if chain is None else chain.when(test, chosen)
    return F.lit(values[-1]) if chain is None else chain.otherwise(F.lit(values[-1]))


def whole(u: Column, low: int, high: int) -> Column:
    """An integer of [low, high)."""
    return F.lit(int(low)).cast("bigint") + F.floor(u * F.lit(float(high - low))).cast("bigint")


def real(u: Column, low: float, high: float, places: int) -> Column:
    return F.bround(F.lit(float(low)) + u * F.lit(float(high) - float(low)), places)


def uuid_text(digest: Column) -> Column:
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"),
        F.substring(digest, 14, 3), F.lit("-a"), F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
