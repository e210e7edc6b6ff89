"""Probabilities, vectors and lenient numbers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EMBEDDING_DIM, LABELS
from .text import let, tokens


def number(c: Column, default: float = 0.0) -> Column:
    """The value as a double; the default where it is none."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(number(c), F.lit(0.0)), F.lit(1.0))


def softmax(logits: Sequence[Column], temperature: Column | float = 1.0) -> Column:
    """array of probabilities, stable for large logits."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.greatest(*logits)
    e = F.array(*[F.exp((x - top) / t) for x in logits])
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax_label(values: Sequence[Column], labels: Sequence[str] = LABELS) -> Column:
    """The label of the greatest value, the first of equals."""
    top = F.greatest(*values)
    return F.coalesce(*[F.when(v == top, F.lit(name)) for v, name in zip(values, labels, strict=True)])


def margin(values: Sequence[Column]) -> Column:
    """Greatest less second greatest value."""
    s = F.sort_array(F.array(*values), asc=False)
    return s[0] - s[1]


def entropy(values: Sequence[Column]) -> Column:
    """Entropy over the logarithm of the number of values; 0 for a single value."""
    n = len(values)
    h = sum((F.when(v > 0, -v * F.ln(v)).otherwise(0.0) for v in values), F.lit(0.0))
    return h / F.ln(F.lit(float(n))) if n > 1 else F.lit(0.0)


def row_entropy(given: Column, values: Sequence[Column]) -> Column:
    """The given entropy within 0..1; without one that of the values made to sum to 1, 0 where none is positive."""
    own = [F.greatest(number(v), F.lit(0.0)) for v in values]
    total = sum(own[1:], own[0])
    return F.when(given.isNotNull(), clamp01(given)).when(total > 0, entropy([v / total for v in own])).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of unlike length or without length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def md5_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Signed bag of words of `dim` places, of length 1, rounded to 6 digits; places and signs come from md5."""
    # twice the place, and one more for a negative sign
    signed = F.transform(
        tokens(F.coalesce(text, F.lit(""))),
        lambda t: ((F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim) * 2 + F.conv(F.substring(F.md5(t), 9, 2), 16, 10).cast("int") % 2).cast("int"),
    )

    def counted(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.size(F.filter(own, lambda x: x == k * 2)) - F.size(F.filter(own, lambda x: x == k * 2 + 1))).cast("double"))

    def scaled(raw: Column) -> Column:
        return let(F.sqrt(dot(raw, raw)), lambda norm: F.when(norm > 0, F.transform(raw, lambda x: F.round(x / norm, 6))).otherwise(raw))

    return let(let(signed, counted), scaled)


def hash_embedding(dim: int = EMBEDDING_DIM):
    """The same by BLAKE2b of 8 bytes, as an Arrow UDF: array<double>."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t, dim))

    return embed


def hashed_vector(text: str | None, dim: int = EMBEDDING_DIM) -> list[float]:
    import hashlib
    import math
    import re

    from ..config import TOKEN

    v = [0.0] * dim
    for token in re.findall(TOKEN, (text or "").lower()):
        d = hashlib.blake2b(token.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "little") % dim] += -1.0 if d[4] & 1 else 1.0
    norm = math.sqrt(math.fsum(x * x for x in v))
    return [round(x / norm, 6) for x in v] if norm else v


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin from 0; both ends take what lies beyond."""
    return F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
