"""Label expressions (TXT-07..11) and seeded hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names and their integer codes, in label order.
LABELS = ["negative", "neutral", "positive"]
LABEL_CODE = {"negative": 0, "neutral": 1, "positive": 2}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_map_literal() -> Column:
    return F.create_map(*[x for k, v in LABEL_CODE.items() for x in (F.lit(k), F.lit(v))])


def encode_label(c) -> Column:
    """TXT-07 strict: unknown label -> null (callers reject or assert)."""
    return F.element_at(label_map_literal(), _col(c))


def encode_label_lenient(c) -> Column:
    """SRC-02: trimmed, lower-cased; unknown -> neutral (1)."""
    return F.coalesce(F.element_at(label_map_literal(), F.lower(F.trim(_col(c)))), F.lit(1))


def decode_label(c) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), _col(c) + 1)


def collapse5_stars(c) -> Column:
    """TXT-08: 0 -> 0, 4 -> 2, else 1."""
    c = _col(c)
    return F.when(c == 0, 0).when(c == 4, 2).otherwise(1)


def collapse5_polarity(c) -> Column:
    """TXT-09: 0,1 -> 0; 2 -> 1; else 2."""
    c = _col(c)
    return F.when(c.isin(0, 1), 0).when(c == 2, 1).otherwise(2)


def argmax(c) -> Column:
    """TXT-10: 0-based index of the first maximum."""
    c = _col(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("long")


def polarity_norm(c) -> Column:
    """TXT-11: contains POS -> positive, NEG -> negative, else neutral."""
    u = F.upper(_col(c))
    return (F.when(u.contains("POS"), "positive")
            .when(u.contains("NEG"), "negative").otherwise("neutral"))


def seeded_hex(seed, key, salt: str | None = None) -> Column:
    """md5(seed ':' key [':' salt]) as lower-case hex. Portable: DuckDB's md5
    gives the same string, so seeded shuffles are reproducible across engines."""
    parts = [F.lit(str(seed)), F.lit(":"), _col(key).cast("string")]
    if salt is not None:
        parts += [F.lit(":"), F.lit(str(salt))]
    return F.md5(F.concat(*parts))


def hex_prefix_int(hex_col, nchars: int) -> Column:
    """First ``nchars`` hex digits as a non-negative integer."""
    return F.conv(F.substring(_col(hex_col), 1, nchars), 16, 10).cast("long")
