"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0


def finite(x: Column) -> Column:
    """True for numbers, false for NaN, infinities and null."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def finite_or_zero(x: Column) -> Column:
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """``round(x, digits) + 0.0``: halves away from 0, no negative zero. Only numbers near a half, or large, go through
    decimals; of others the nearest integer to the scaled number, divided, is the same double, and costs far less."""
    scaled = x * 10.0**digits
    nearest = F.rint(scaled)
    # Below 2^33, scaling and the decimals that stand for a double are within 2e-6.
    plain = (F.abs(scaled) < 2.0**33) & (F.abs(F.abs(scaled - nearest) - 0.5) > 1e-5)
    return F.when(plain, nearest / 10.0**digits).otherwise(F.round(x, digits)) + 0.0


def days(ts: Column) -> Column:
    """A timestamp without zone as days since 1970, in double."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / F.lit(SECONDS_PER_DAY * 1e6)


def to_seconds(d: Column) -> Column:
    return d * F.lit(SECONDS_PER_DAY)


def to_days(s: Column) -> Column:
    return s / F.lit(SECONDS_PER_DAY)


def noise_weight(noise: Column | None) -> Column:
    """1 / noise^2 where the noise is finite and positive, else 0; 1 where there is no noise column."""
    if noise is None:
        return F.lit(1.0)
    return F.when(finite(noise) & (noise > 0), 1.0 / (noise * noise)).otherwise(F.lit(0.0))


def logged_at() -> Column:
    """The time of the query as text of ISO 8601 with its zone, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def band_label(band: Column) -> Column:
    """``spw00`` and so on."""
    return F.format_string("spw%02d", band.cast("int"))


def to_text(raw: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes replacement characters."""
    return F.decode(raw, "UTF-8")


def number_text(x: Column) -> Column:
    """A number under 10 million in size as the shortest text that gives it back: decimals from 0.0001 on (``0.00012``),
    below that an exponent of two digits or more (``3.1e-05``). A cast writes ``1.2E-4`` and ``3.1E-5``."""
    text = x.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    plain = F.regexp_replace(text, r"^(-?)(\d)\.(?:0|(\d+))E-4$", "$10.000$2$3")
    return F.when(~text.contains("E-"), text).when(F.abs(x) >= 1e-4, plain).otherwise(F.lower(digits))


def head(text: Column, n: int = 600) -> Column:
    return F.substring(text, 1, n)


def key_subset(m: Column, keys: list[str]) -> Column:
    """The entries of a string map whose keys are listed; a null map gives an empty one."""
    return F.map_filter(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k.isin(keys))


#: A baseline's code holds both antennas, and a pair's code both baselines, each number with 100 added.
ANTENNA_BASE, ANTENNA_OFFSET = 1000, 100


def series_code(key: Column, kind: str) -> Column:
    """The integer code of a series key: the key itself where ``kind`` (its type) is an integer one, else
    made from a struct of two structs of two antennas, whatever their field names."""
    from pyspark.sql import types as T

    spec = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    if not isinstance(spec, T.StructType):
        return key.cast("long")
    halves = []
    for half in spec.fields:
        a, b = (key.getField(half.name).getField(f.name).cast("long") + ANTENNA_OFFSET for f in half.dataType.fields)
        halves.append(a * ANTENNA_BASE + b)
    return halves[0] * ANTENNA_BASE**2 + halves[1]
