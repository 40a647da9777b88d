"""Expressions on payload bytes (array<int> columns), all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rest(d: Column, skip: int) -> Column:
    """All but the first ``skip`` bytes."""
    return F.slice(d, skip + 1, F.greatest(F.size(d) - skip, F.lit(0)))


def _front(d: Column, skip: int) -> Column:
    """All but the last ``skip`` bytes."""
    return F.slice(d, 1, F.greatest(F.size(d) - skip, F.lit(0)))


def hex_to_bytes(h: C) -> Column:
    """Hex text to bytes; spaces and a leading 0x are skipped, an odd last digit dropped, null for other signs."""
    h = F.regexp_replace(F.regexp_replace(_c(h), r"^0[xX]", ""), r"\s", "")
    n = F.floor(F.length(h) / 2).cast("int")
    byte = lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(h.rlike("^[0-9A-Fa-f]*$"), F.when(n < 1, F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), byte)))


def bytes_to_hex(d: C, separator: str = " ") -> Column:
    return F.array_join(F.transform(_c(d), lambda x: F.lpad(F.hex(x), 2, "0")), separator)


def byte_columns(d: C, prefix: str = "data_byte_") -> list[Column]:
    """Eight columns, 0 where the payload is shorter."""
    return [F.coalesce(F.try_element_at(_c(d), F.lit(i + 1)), F.lit(0)).alias(f"{prefix}{i}") for i in range(8)]


def padded(d: C) -> Column:
    return F.array(*byte_columns(d))


def entropy(d: C) -> Column:
    """Shannon entropy of the bytes in bits; 0 if there are none."""
    d = _c(d)
    n = F.size(d)

    def add(total: Column, x: Column) -> Column:
        p = F.size(F.filter(d, lambda y: y == x)) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(d), F.lit(0.0), add)


def entropy_fast(d: C) -> Column:
    """Distinct bytes of the padded payload / 8 * 2.5."""
    return F.size(F.array_distinct(padded(d))) / 8 * 2.5


def stats(d: C) -> Column:
    """struct(mean, median, std (sample), min, max, range, sum, zeros, ones), all 0 if there are no bytes."""
    d = _c(d)
    n = F.size(d)
    total = F.aggregate(d, F.lit(0), lambda a, x: a + x)
    mean = total / n
    square = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    ordered = F.array_sort(d)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    some = lambda c: F.when(n > 0, c.cast("double")).otherwise(0.0)
    return F.struct(
        some(mean).alias("mean"), some(median).alias("median"), F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0).alias("std"),
        some(F.array_min(d)).alias("min"), some(F.array_max(d)).alias("max"), some(F.array_max(d) - F.array_min(d)).alias("range"), some(total).alias("sum"),
        some(F.size(F.filter(d, lambda x: x == 0))).alias("zeros"), some(F.size(F.filter(d, lambda x: x == 255))).alias("ones"),
    )


def patterns(d: C) -> Column:
    """struct(pattern_repetition, sequential_pattern, alternating_pattern, ascending_bytes, descending_bytes)."""
    d = _c(d)
    n = F.size(d)
    steps = F.zip_with(_front(d, 1), _rest(d, 1), lambda a, b: b - a)
    share = lambda test: F.when(n > 1, F.size(F.filter(steps, test)) / (n - 1)).otherwise(0.0)
    twos = F.zip_with(_front(d, 2), _rest(d, 2), lambda a, b: a == b)
    pairs = F.zip_with(_front(twos, 1), _rest(twos, 1), lambda a, b: a & b)
    alternating = F.when(n >= 4, F.size(F.filter(pairs, lambda x: x)) / (n - 3)).otherwise(0.0)
    monotone = (n > 1) & (F.forall(steps, lambda s: s >= 0) | F.forall(steps, lambda s: s <= 0))
    return F.struct(
        share(lambda s: s == 0).alias("pattern_repetition"), monotone.cast("double").alias("sequential_pattern"), alternating.alias("alternating_pattern"),
        share(lambda s: s == 1).alias("ascending_bytes"), share(lambda s: s == -1).alias("descending_bytes"),
    )


def is_all_zeros(d: C) -> Column:
    return F.forall(_c(d), lambda x: x == 0)


def is_all_ones(d: C) -> Column:
    return F.forall(_c(d), lambda x: x == 255)


def is_sequential(d: C) -> Column:
    """Each byte is its place more than the first, modulo 256."""
    d = _c(d)
    return F.forall(F.transform(d, lambda x, i: x == (F.try_element_at(d, F.lit(1)) + i) % 256), lambda ok: ok)


def hamming(a: C, b: C) -> Column:
    """Different bits; the shorter payload is filled up with 0."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0))))), F.lit(0), lambda t, x: t + x)


def xor_checksum_ok(d: C, offset: C | None = None) -> Column:
    """Whether the byte at ``offset`` (the last by default) is the XOR of all others; false with under two bytes or outside."""
    d = _c(d)
    n = F.size(d)
    at = F.coalesce(_c(offset), n - 1) if offset is not None else n - 1
    xor = F.aggregate(d, F.lit(0), lambda t, x: t.bitwiseXOR(x))
    return F.coalesce((n >= 2) & (at >= 0) & (at < n) & (xor == 0), F.lit(False))


def steering_angle(d: C) -> Column:
    """Signed 16-bit little-endian tenths of a degree; null with under two bytes."""
    raw = F.try_element_at(_c(d), F.lit(1)) + F.try_element_at(_c(d), F.lit(2)) * 256
    return F.when(raw >= 32768, raw - 65536).otherwise(raw) * 0.1


def matches_pattern(d: C, pattern: C) -> Column:
    """Hex byte prefix, ``*`` or ``**`` for any byte; a pattern longer than the payload doesn't match."""
    want = F.filter(F.split(F.trim(_c(pattern)), r"\s+"), lambda p: p != "")
    ok = F.zip_with(want, F.slice(_c(d), 1, F.size(want)), lambda p, x: p.startswith("*") | F.coalesce(F.conv(p, 16, 10).cast("int") == x, F.lit(False)))
    return (F.size(want) <= F.size(_c(d))) & F.forall(ok, lambda x: x)


def contains_any(d: C, needles: C) -> Column:
    """Whether the spaced upper-case hex of the payload contains any of the given hex texts."""
    text = bytes_to_hex(d)
    return F.exists(_c(needles), lambda p: F.contains(text, F.upper(p)))
