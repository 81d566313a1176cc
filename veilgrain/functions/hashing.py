"""Stable hash functions of columns: batch buckets and counter-based uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(text: Column, buckets: Column) -> Column:
    """SHA-256 of ``text`` as a 256-bit number modulo ``buckets`` (below 2**31), folded over eight 32-bit words."""
    modulus = buckets.cast("long")

    def fold(digest: Column) -> Column:
        words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: (acc * 4294967296 + w) % modulus)

    # Bound by a lambda, so that the text is hashed once and not for each word of the digest.
    return F.element_at(F.transform(F.array(F.sha2(text, 256)), fold), 1)


def bucket_key(label: Column, text: Column) -> Column:
    """What a bucket is drawn from: label and text, so equal texts of two labels part."""
    return F.concat(label.cast("string"), F.lit("\n"), text)


def uniform(*parts: Column | str | int) -> Column:
    """A reproducible uniform in [0, 1) from its counters (52 bits of a SHA-256).

    Anyone who knows the counters knows the draw: use ``secure_uniform`` where
    the noise must protect somebody.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def secure_uniform() -> Column:
    """A uniform from Spark's generator seeded by the operating system for each query."""
    import secrets

    return F.rand(secrets.randbits(63))


def laplace(u: Column, scale: Column | float) -> Column:
    """Inverse-CDF Laplace noise; u = 0 counts as the least positive draw."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    centred = F.greatest(u, F.lit(2.0**-53)) - 0.5
    return -b * F.signum(centred) * F.ln(1 - 2 * F.abs(centred))
