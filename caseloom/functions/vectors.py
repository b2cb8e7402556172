"""Vector and hashing functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for nulls or unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(total, F.lit(0.0))).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, kind: str = "strict") -> Column:
    """Cosine similarity: `smooth` adds 1e-9 to the norms' product, `strict` is 0 for tiny norms, `clamped` is cut to [0, 1]."""
    product = norm(a) * norm(b)
    if kind == "smooth":
        return dot(a, b) / (product + 1e-9)
    plain = F.when(product <= 1e-9, F.lit(0.0)).otherwise(dot(a, b) / product)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), plain)) if kind == "clamped" else plain


def slot(token: Column, dimension: int) -> Column:
    """Dimension of a token: the first 32 bits of its SHA-256, modulo."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimension).cast("int")


def sign(token: Column) -> Column:
    """+1 or -1 by the parity of the fifth byte of the SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def unit_hash(text: Column) -> Column:
    """Uniform number in [0, 1): the first 52 bits of the SHA-256, exact in a double."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    def shares(scaled: Column) -> Column:
        powers = bind(F.array_max(scaled), lambda top: F.transform(scaled, lambda x: F.exp(x - top)))
        return bind(powers, lambda e: bind(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))

    return bind(F.transform(logits, lambda x: x / temperature), shares)


def nll(logits: Column, label: Column, temperature: float | Column = 1.0) -> Column:
    """Negative log likelihood of a label index, by the log-sum-exp of the tempered logits."""
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    total = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(total) + top - F.element_at(scaled, label + 1)


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius 6371."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(a)) * 6371


def masked_mean(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is not 0, as a unit vector; zeros where the mask leaves none."""
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: x * 0.0)
    added = F.aggregate(F.arrays_zip(tokens.alias("v"), mask.alias("m")), zero, lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b * t["m"]))
    count = F.greatest(F.aggregate(mask, F.lit(0), lambda s, m: s + m).cast("double"), F.lit(1e-9))
    return bind(F.transform(added, lambda x: x / count), lambda v: bind(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))
