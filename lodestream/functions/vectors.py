"""Vector scalars over array columns. Elements are cast to double before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a side has no length."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x - y)


def slice_of(a: Column, start: int, end: int) -> Column:
    """Elements [start, end); an empty or negative range is an error."""
    if not 0 <= start < end:
        raise ValueError("slice needs 0 <= start < end")
    return F.slice(a, start + 1, end - start)


def slice_bits(words: Column, start: int, end: int) -> Column:
    """Bits [start, end) of a packed vector as packed words; both must be multiples of 8."""
    if not 0 <= start < end or start % 8 or end % 8:
        raise ValueError("bit slices need 0 <= start < end in multiples of 8")
    bit = lambda i: F.call_function("shiftrightunsigned", F.get(words, F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1))
    return _packed(F.transform(F.sequence(F.lit(start), F.lit(end - 1)), bit), end - start)


def _packed(bits: Column, n: int) -> Column:
    """0/1 numbers as 64-bit words, the first in the lowest bit."""
    word = lambda w: F.aggregate(F.transform(F.slice(bits, w * 64 + 1, 64), lambda x, i: F.call_function("shiftleft", x.cast("bigint"), i)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 64)), word)


def from_text(text: Column) -> Column:
    """vec_f32 of a JSON list; null if it isn't one of numbers."""
    parsed = F.from_json(text, "array<float>")
    return F.when(F.forall(parsed, lambda x: x.isNotNull()), parsed)


def to_text(a: Column) -> Column:
    return F.to_json(a)


def int8(a: Column) -> Column:
    """vec_int8: whole numbers from -128 to 127; null if one doesn't fit."""
    return F.when(F.forall(a, lambda x: x.between(-128, 127)), a.cast("array<tinyint>"))


def bits(code: Column) -> Column:
    """vec_bit: a vector of bits from hex text, the first bit lowest in its byte, as a number for each byte."""
    return F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int"))


def kind(a: Column, element: str) -> Column:
    """vec_type by the element type: float32, int8 or bit."""
    return F.when(a.isNull(), F.lit(None).cast("string")).otherwise({"float": "float32", "double": "float32", "tinyint": "int8"}.get(element, "bit"))


def half(a: Column) -> Column:
    """float16's rounding in float arithmetic: 11 significant bits, ties to even, values under 2**-24 / 2 to 0; finite numbers up to 65504."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))) - 10), F.lit(2.0**-24))
        return F.when(size == 0, 0.0).otherwise(F.rint(x / step) * step)

    return F.transform(a.cast(DOUBLES), one)


def normalize(a: Column) -> Column:
    """To unit length; vectors with a squared length under 1e-12 stay as they are."""
    size = norm(a)
    return F.when(size * size < 1e-12, a.cast(DOUBLES)).otherwise(F.transform(a.cast(DOUBLES), lambda x: x / size))


def quantize_int8(a: Column) -> Column:
    """[-1, 1] to -128..127, truncated toward zero and clamped; NaN becomes 127."""

    def one(x: Column) -> Column:
        step = F.least(F.greatest(((x + 1.0) / (2.0 / 255.0)) - 128.0, F.lit(-128.0)), F.lit(127.0))
        return F.when(F.isnan(x), F.lit(127)).otherwise(step.cast("int"))

    return F.transform(a.cast(DOUBLES), one)


def quantize_binary(a: Column) -> Column:
    """One bit per element (1 if positive), the first element in the lowest bit, as 64-bit words."""
    bits = F.transform(a.cast(DOUBLES), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    def word(w: Column) -> Column:
        part = F.slice(bits, (w * 64 + 1).cast("int"), F.lit(64))
        return F.aggregate(F.transform(part, lambda x, i: F.call_function("shiftleft", x, i)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed bit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
