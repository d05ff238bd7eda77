"""Text expressions: the missing-text rule, lengths, token estimates, previews, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Found at the first character that isn't white space, so long texts cost nothing.
_SOMETHING = r"(?U)\S"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_value(c: Column | str) -> Column:
    """The text verbatim; null where it is null or only white space."""
    c = _col(c).cast("string")
    return F.when(c.rlike(_SOMETHING), c)


def number_text(c: Column | str) -> Column:
    """A double as text; null where it is null, NaN or infinite."""
    c = _col(c)
    return F.when(finite(c).isNotNull(), c.cast("string"))


def finite(c: Column | str) -> Column:
    """The number; null where it is NaN or infinite."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def word_count(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != ""))


def approx_tokens(c: Column | str, chars_per_token: float = 4.0) -> Column:
    """Characters over a ratio, rounded up."""
    return F.ceil(F.char_length(_col(c)) / chars_per_token)


def preview(c: Column | str, size: int = 60) -> Column:
    """Head, middle and tail of a long text; a text of up to 3 * size characters whole."""
    c = _col(c)
    n = F.char_length(c)
    head, tail = F.substring(c, 1, size), F.right(c, F.lit(size))
    middle = c.substr((F.floor((n - size) / 2) + 1).cast("int"), F.lit(size))
    return F.when(n <= 3 * size, c).otherwise(F.concat(head, F.lit(" ... "), middle, F.lit(" ... "), tail))


def lenient_number(c: Column | str) -> Column:
    """A number from text without commas, dollar and percent signs and white space; null if it doesn't parse."""
    return F.regexp_replace(_col(c), r"[,$%\s]", "").try_cast("double")


def kind_of(c: Column | str) -> Column:
    """The kind of a column's values: i for whole numbers, d for floating ones, s for strings, else the type's name."""
    kind = F.typeof(_col(c))
    return F.when(kind.isin("tinyint", "smallint", "int", "bigint"), "i").when(kind.isin("float", "double"), "d").when(kind == "string", "s").otherwise(kind)


def spelt(text: Column, kind: Column) -> Column:
    """A text with its kind and length before it, so that texts spelt one after the other read back in one way only; n; for null."""
    return F.when(text.isNull(), F.lit("n;")).otherwise(F.concat(kind, F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts with their kinds and lengths, so ("a", "bc") and ("ab", "c") differ and so do 1 and "1"."""
    return F.sha2(F.concat(*[spelt(_col(part).cast("string"), kind_of(part)) for part in parts]), 256)


def canonical_map_json(c: Column | str) -> Column:
    """JSON of a string map with sorted keys and without white space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(c)))))


def epoch_seconds(c: Column | str, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """Seconds since 1970 in UTC of an ISO date or time; null if it doesn't parse."""
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])).cast("double")


def field_type(distinct: Column, nonempty: Column, numeric: Column, no_space: Column, median_length: Column) -> Column:
    """The kind of a text field from its counts: the first rule that holds."""
    share = lambda n: n / F.nullif(nonempty, F.lit(0))
    return (
        F.when(nonempty == 0, "empty")
        .when(share(numeric) >= 0.9, "numeric_text")
        .when((distinct <= 50) & (share(distinct) <= 0.05), "categorical")
        .when((share(no_space) >= 0.9) & (median_length <= 16), "identifier_or_code")
        .when(median_length <= 60, "short_text")
        .otherwise("long_text")
    )
