"""DuckDB text for random draws and column specs, written apart from the Spark code."""

from quiltframe import constants as K
from quiltframe.plans import specs as S

WORD, TAU = "4294967296e0", "6.283185307179586e0"
SPACE = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}]")


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lit(x) -> str:
    if isinstance(x, str):
        return text(x)
    return num(x) if isinstance(x, float) else str(x)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


class SqlDraws:
    """Draw expressions in the slot order of a stream."""

    def __init__(self, stream: str, seed: int = 42, key: str = "row_id"):
        self.stream, self.seed, self.key = stream, seed, key
        self.taken = self.whole = 0

    def digest(self, label: str) -> str:
        return (f"md5(concat_ws('|', CAST({self.key} AS VARCHAR), {text(self.stream)}, "
                f"'{label}', '{self.seed}'))")

    def slot(self, n: int) -> str:
        return (f"((('0x' || substr({self.digest(str(n // 4))}, {8 * (n % 4) + 1}, 8))::UBIGINT"
                f"::DOUBLE + 5e-1) / {WORD})")

    def next(self) -> str:
        self.taken += 1
        return self.slot(self.taken - 1)

    def next_normal(self) -> str:
        return normal(self.next(), self.next())

    def next_hex(self) -> str:
        self.whole += 1
        return self.digest(f"h{self.whole - 1}")

    def next_fine(self) -> str:
        return (f"((('0x' || substr({self.next_hex()}, 1, 13))::UBIGINT::DOUBLE + 5e-1)"
                " / 4503599627370496e0)")


def normal(u1: str, u2: str) -> str:
    return f"(round(sqrt(-2e0 * ln({u1})) * cos({TAU} * {u2}), 6) + 0e0)"


def pick(u: str, values) -> str:
    items = ", ".join(lit(v) for v in values)
    return f"([{items}])[1 + CAST(floor({u} * {num(len(values))}) AS INTEGER)]"


def weighted(u: str, values, weights) -> str:
    total, parts = 0.0, []
    for value, weight in list(zip(values, weights))[:-1]:
        total = round(total + weight, 9)
        parts.append(f"WHEN {u} < {num(total)} THEN {lit(value)}")
    return f"CASE {' '.join(parts)} ELSE {lit(values[-1])} END"


def whole(u: str, low: int, high: int) -> str:
    return f"({low} + CAST(floor({u} * {num(high - low)}) AS BIGINT))"


def uuid(digest: str) -> str:
    return (f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-4' || "
            f"substr({digest}, 14, 3) || '-a' || substr({digest}, 18, 3) || '-' || "
            f"substr({digest}, 21, 12))")


def spec_sql(spec, d: SqlDraws, as_of: str, n: str) -> str:
    """One drawn column as SQL."""
    match spec:
        case S.Pick(values, weights):
            return weighted(d.next(), values, weights) if weights else pick(d.next(), values)
        case S.Whole(low, high):
            return whole(d.next(), low, high)
        case S.Real(low, high, places):
            return (f"(round_even({num(low)} + {d.next()} * {num(float(high) - float(low))}, "
                    f"{places}) + 0e0)")
        case S.Uniform(low, high):
            return f"({num(low)} + {d.next()} * {num(float(high) - float(low))})"
        case S.Flag(p):
            return f"({d.next()} < {num(p)})"
        case S.Gauss(mean, deviation):
            return f"({num(mean)} + {num(deviation)} * {d.next_normal()})"
        case S.Coded(prefix, low, high, width):
            if high - low > 10 ** 8:
                step = 10 ** 6
                number = (f"({whole(d.next(), low // step, high // step)} * {step} + "
                          f"{whole(d.next(), 0, step)})")
            else:
                number = whole(d.next(), low, high)
            return f"({text(prefix)} || lpad(CAST({number} AS VARCHAR), greatest({width}, " \
                   f"length(CAST({number} AS VARCHAR)))::INTEGER, '0'))"
        case S.Uuid(length):
            return f"substr({uuid(d.next_hex())}, 1, {length})"
        case S.Ago(seconds):
            return f"(CAST('{as_of}' AS TIMESTAMP) - to_seconds({whole(d.next(), 0, seconds)}))"
        case S.DaysAgo(low, high):
            return f"(CAST('{as_of[:10]}' AS DATE) - CAST({whole(d.next(), low, high)} AS INTEGER))"
        case S.Word(vocabulary):
            return pick(d.next(), getattr(K, vocabulary))
        case S.Sentence(words):
            body = f"concat_ws(' ', {', '.join(pick(d.next(), K.WORDS) for _ in range(words))})"
            return f"(upper(substr({body}, 1, 1)) || substr({body}, 2) || '.')"
        case S.Maybe(inner, p):
            chance = d.next()
            return f"CASE WHEN {chance} < {num(p)} THEN {spec_sql(inner, d, as_of, n)} END"
    raise TypeError(spec)


def template_sql(template: str, specs: dict, source: str, as_of: str, n: str = "0",
                 overrides: dict | None = None) -> str:
    """WITH-less SELECT giving all columns (helpers too) of a template over `source`."""
    d, drawn, derived = SqlDraws(template), [], []
    for name, spec in specs.items():
        if isinstance(spec, S.Derived):
            sql = (overrides or {}).get(name, spec.sql).format(n=n, as_of=as_of)
            derived.append((name, sql))
        else:
            drawn.append(f'{spec_sql(spec, d, as_of, n)} AS "{name}"')
    out = f"SELECT row_id, {', '.join(drawn) or '0 AS _none'} FROM ({source})"
    for name, sql in derived:
        out = f'SELECT *, {sql} AS "{name}" FROM ({out})'
    return out
