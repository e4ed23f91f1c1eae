"""Vector expressions and point identifiers."""

from pyspark.sql import functions as F

from vectormart.fixed_values import FEATURES


def vector_raw(t=F.col):
    return F.array(*[t(f) for f in FEATURES])


def valid_vector(vector, dim):
    """True for a vector of the right length whose elements are all finite numbers."""
    infinite = F.lit(float("inf"))
    return F.coalesce(
        (F.size(vector) == dim)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)),
        F.lit(False),
    )


def has_dim(vector, dim):
    return F.coalesce(F.size(vector) == dim, F.lit(False))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b):
    """Cosine of two vectors; zero when either has no length."""
    product = dot(a, b)
    return F.coalesce(product / F.nullif(norm(a) * norm(b), F.lit(0.0)), product)


def score(a, b, metric="cosine"):
    return cosine(a, b) if metric == "cosine" else dot(a, b)


def point_id(key):
    """Unsigned 64-bit identifier from the first 16 hex digits of a key.

    A key that does not start with hex digits is hashed as a whole.
    """
    head = F.substring(key, 1, 16)
    hexed = F.conv(head, 16, 10).cast("decimal(20,0)")
    hashed = F.conv(F.hex(F.xxhash64(key)), 16, 10).cast("decimal(20,0)")
    return F.when(F.rlike(head, F.lit("^[0-9a-fA-F]+$")), hexed).when(key.isNotNull(), hashed)


def frozen_z(value, mean, std):
    """Standard score from stored statistics; no spread divides by one."""
    return (value - mean) / F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))


def live_z(value, mean, std):
    """Standard score inside the mart; no spread gives NULL."""
    return (value - mean) / F.nullif(std, F.lit(0.0))
