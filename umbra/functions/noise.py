"""Keyed noise: a pure function of a secret, a release, a purpose and the row key.

``rand(seed)`` depends on physical partitioning and is drawn anew on a task retry, which would leak by
averaging. Here a recomputation of one release gives the same noise, and every other release gives
independent noise: the digest covers the release id and the purpose, and a purpose names the mechanism,
the column and the scale. So the noise of two releases of one value never cancels.

The parts are written with their lengths before them, so different parts never give the same text. A
null row key is an error: its rows would share one draw.

The secret enters a plan as a scalar subquery over a one-row frame, not as a literal: plan texts, event logs
and ``explain()`` name the subquery only.

Continuous draws round floating-point numbers. ``discrete_laplace`` and ``discrete_gaussian`` compare keyed
integers of ``DIGIT_BITS`` bits with integer thresholds, so the draw itself has no floating point: a
discrete Laplace is the difference of two geometric numbers, whose binary digits are independent; a discrete
Gaussian is found in the table of its distribution. Thresholds are exact up to 2^-60 each.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWO_48 = float(2 ** 48)
DIGIT_BITS = 60                 # of a keyed integer: 15 hex digits, four of them a digest
LARGEST_TABLE = 200_000         # entries of a discrete Gaussian's table; a wider one needs a coarser grid

_hidden_frames: dict[tuple[int, str], DataFrame] = {}


def _hidden(text: str) -> Column:
    """``text`` as a column whose plan does not show it."""
    spark = SparkSession.active()
    at = (id(spark), text)
    if at not in _hidden_frames:
        _hidden_frames[at] = spark.createDataFrame([(text,)], "k string")
    return _hidden_frames[at].scalar()


@dataclasses.dataclass(frozen=True)
class NoiseKey:
    """What the noise of one release depends on besides the rows. The secret must stay secret, and a
    release id must not be used for two releases (``ledger.refuse_reuse``)."""

    secret: str
    release_id: str

    def __post_init__(self):
        if not self.secret or not self.release_id:
            raise ValueError("noise needs a secret and a release id")

    def release(self, release_id: str) -> "NoiseKey":
        return dataclasses.replace(self, release_id=release_id)

    def uniform(self, purpose: str, *keys: Column | str) -> Column:
        """Uniform in (0, 1) from 48 bits of the SHA-256 of all parts."""
        return (F.conv(F.substring(self._digest(purpose, keys), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_48)

    def _digest(self, purpose: str, keys) -> Column:
        parts = [_hidden(f"{len(self.secret)}:{self.secret}"), F.lit("".join(f"{len(p)}:{p}" for p in (self.release_id, purpose)))]
        for k in keys:
            text = (F.col(k) if isinstance(k, str) else k).cast("string")
            parts += [F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.raise_error(F.lit("a noise key is null")))]
        return F.sha2(F.concat(*parts), 256)

    def integers(self, count: int, purpose: str, *keys: Column | str) -> list[Column]:
        """``count`` independent uniform integers below 2^60, four from each digest."""
        digests = [self._digest(f"{purpose}/digits/{j}", keys) for j in range(-(-count // 4))]
        return [F.conv(F.substring(digests[j // 4], 15 * (j % 4) + 1, 15), 16, 10).cast("long") for j in range(count)]

    def integers_sql(self, count: int, purpose: str, *keys: str) -> list[str]:
        """The same in DuckDB SQL."""
        digests = [self._digest_sql(f"{purpose}/digits/{j}", keys) for j in range(-(-count // 4))]
        return [f"CAST(('0x' || substr({digests[j // 4]}, {15 * (j % 4) + 1}, 15)) AS BIGINT)" for j in range(count)]

    def integers_of(self, count: int, purpose: str, *keys) -> list[int]:
        """The same in plain Python, for one row."""
        parts = [self.secret, self.release_id, None, *map(str, keys)]
        digest = lambda j: hashlib.sha256("".join(f"{len(p)}:{p}" for p in (parts[:2] + [f"{purpose}/digits/{j}"] + parts[3:])).encode()).hexdigest()
        return [int(digest(j // 4)[15 * (j % 4):15 * (j % 4) + 15], 16) for j in range(count)]

    def uniform_sql(self, purpose: str, *keys: str) -> str:
        """The same in DuckDB SQL."""
        return f"((CAST(('0x' || substr({self._digest_sql(purpose, keys)}, 1, 12)) AS BIGINT) + 0.5) / {TWO_48})"

    def _digest_sql(self, purpose: str, keys) -> str:
        head = "".join(f"{len(p)}:{p}" for p in (self.secret, self.release_id, purpose)).replace("'", "''")
        text = [f"length(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR)" for k in keys]
        return f"sha256({' || '.join([f"'{head}'", *text])})"


def laplace(u: Column, scale: Column | float) -> Column:
    """Inverse-CDF Laplace(0, scale) from one uniform."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    c = u - F.lit(0.5)
    return -b * F.signum(c) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(c))


def gaussian(u1: Column, u2: Column, sigma: Column | float) -> Column:
    """Box-Muller N(0, sigma^2) from two uniforms."""
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return s * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gumbel(u: Column) -> Column:
    """Standard Gumbel from one uniform (for Gumbel-max selection)."""
    return -F.log(-F.log(u))


# ---- exact discrete noise ----------------------------------------------------------------------

def digit_thresholds(scale: Fraction) -> list[int]:
    """For each binary digit of a geometric number with ratio exp(-1/scale), its probability times 2^60, rounded down.

    The digits of such a number are independent: digit j is 1 with probability r/(1+r), r = exp(-2^j/scale)."""
    if scale <= 0:
        raise ValueError("the scale of noise is above 0")
    out = []
    with localcontext() as ctx:
        ctx.prec = 60
        for j in range(4096):
            r = (-Decimal(2 ** j) * scale.denominator / scale.numerator).exp()
            t = int((r / (1 + r)) * (1 << DIGIT_BITS))
            if not t:
                return out
            out.append(t)
    raise ValueError("the scale is too large")


def gaussian_thresholds(sigma: Fraction) -> list[int]:
    """Distribution function times 2^60, rounded down, of the discrete Gaussian at -R, ..., R - 1, where what lies beyond R
    is below 2^-60."""
    radius = math.ceil(9.3 * float(sigma)) + 1
    if sigma <= 0 or 2 * radius > LARGEST_TABLE:
        raise ValueError(f"a discrete Gaussian of sigma {float(sigma)} needs a coarser grid")
    with localcontext() as ctx:
        ctx.prec = 60
        two = Decimal(2) * sigma.numerator ** 2 / sigma.denominator ** 2
        half = [(-Decimal(x * x) / two).exp() for x in range(radius + 1)]
        total, run, out = sum(half) * 2 - half[0], Decimal(0), []
        for x in range(-radius, radius):
            run += half[abs(x)]
            out.append(int(run / total * (1 << DIGIT_BITS)))
    return out


def laplace_label(purpose: str, scale: Fraction) -> str:
    return f"discrete laplace/{purpose}/{scale}"


def gaussian_label(purpose: str, sigma: Fraction) -> str:
    return f"discrete gaussian/{purpose}/{sigma}"


def discrete_laplace(noise: NoiseKey, purpose: str, scale: Fraction, *keys: Column | str) -> Column:
    """D1 exactly: an integer x with probability in proportion to exp(-|x|/scale)."""
    t = digit_thresholds(scale)
    bits = noise.integers(2 * len(t), laplace_label(purpose, scale), *keys)
    out = F.lit(0).cast("long")
    for j, limit in enumerate(t):
        out = out + ((bits[2 * j] < limit).cast("long") - (bits[2 * j + 1] < limit).cast("long")) * F.lit(2 ** j)
    return out


def discrete_laplace_sql(noise: NoiseKey, purpose: str, scale: Fraction, *keys: str) -> str:
    t = digit_thresholds(scale)
    bits = noise.integers_sql(2 * len(t), laplace_label(purpose, scale), *keys)
    return "(" + " + ".join(f"(CAST({bits[2 * j]} < {x} AS BIGINT) - CAST({bits[2 * j + 1]} < {x} AS BIGINT)) * {2 ** j}" for j, x in enumerate(t)) + ")"


def discrete_laplace_of(noise: NoiseKey, purpose: str, scale: Fraction, *keys) -> int:
    t = digit_thresholds(scale)
    bits = noise.integers_of(2 * len(t), laplace_label(purpose, scale), *keys)
    return sum(((bits[2 * j] < x) - (bits[2 * j + 1] < x)) * 2 ** j for j, x in enumerate(t))


def gaussian_digits(noise: NoiseKey, purpose: str, sigma: Fraction, *keys: Column | str) -> Column:
    """The keyed integer that ``discrete_gaussian`` looks up."""
    return noise.integers(1, gaussian_label(purpose, sigma), *keys)[0]


def discrete_gaussian(digits: str, sigma: Fraction) -> Column:
    """D2 exactly: an integer x with probability in proportion to exp(-x^2/(2 sigma^2)), by binary search in its table.

    ``digits``: the name of a column with ``gaussian_digits`` (a search is a higher-order function, which may hold no subquery)."""
    t = gaussian_thresholds(sigma)
    table = F.split(F.lit(",".join(map(str, t))), ",").cast("array<bigint>")          # folded to one constant
    steps, u = [1 << b for b in range(len(t).bit_length() - 1, -1, -1)], F.col(digits)
    # u stands in it twice, so that the optimizer keeps it as a column
    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= u, step).otherwise(0))
    return F.when(u.isNotNull(), (found - F.lit(len(t) // 2)).cast("long"))


def discrete_gaussian_sql(noise: NoiseKey, purpose: str, sigma: Fraction, *keys: str) -> str:
    t = gaussian_thresholds(sigma)
    u = noise.integers_sql(1, gaussian_label(purpose, sigma), *keys)[0]
    return f"(len([t for t in [{', '.join(map(str, t))}] if t <= {u}]) - {len(t) // 2})"


def discrete_gaussian_of(noise: NoiseKey, purpose: str, sigma: Fraction, *keys) -> int:
    t = gaussian_thresholds(sigma)
    u = noise.integers_of(1, gaussian_label(purpose, sigma), *keys)[0]
    return sum(x <= u for x in t) - len(t) // 2


# ---- DuckDB twins (oracle SQL) ----------------------------------------------------------------

def laplace_sql(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5)))"


def gaussian_sql(u1: str, u2: str, sigma: str) -> str:
    return f"(({sigma}) * sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi} * {u2}))"


def gumbel_sql(u: str) -> str:
    return f"(-ln(-ln({u})))"
