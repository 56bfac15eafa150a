"""Text functions: masking of personal data, validity of names, size literals, content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


#: What every masked run has; texts without it, nearly all, are looked through once.
_DIGITS = "[0-9]{4}[-\\t\\n\\f\\r ]?[0-9]{4}"


def mask_pii(c: Column) -> Column:
    """15 and 18 digits, mobile numbers and cards of 16 digits (groups parted by - or a space): first and last two stay."""
    return F.when(c.rlike(_DIGITS), _masked(c)).otherwise(c)


def _masked(c: Column) -> Column:
    for n in (15, 18):
        c = F.regexp_replace(c, f"{_EDGE}([0-9]{{2}})[0-9]{{{n - 4}}}([0-9]{{2}}){_END}", "$1" + "*" * (n - 4) + "$2")
    c = F.regexp_replace(c, f"{_EDGE}(1[3-9])[0-9]{{7}}([0-9]{{2}}){_END}", "$1*******$2")
    for a in ("", "[-\\t\\n\\f\\r ]"):
        for b in ("", "[-\\t\\n\\f\\r ]"):
            for d in ("", "[-\\t\\n\\f\\r ]"):
                n = 12 + sum(map(bool, (a, b, d)))
                c = F.regexp_replace(c, f"{_EDGE}([0-9]{{2}})[0-9]{{2}}{a}[0-9]{{4}}{b}[0-9]{{4}}{d}[0-9]{{2}}([0-9]{{2}}){_END}", "$1" + "*" * n + "$2")
    return c


def is_text(content_type: Column) -> Column:
    return content_type.rlike(r"^(text/|application/(json|xml|javascript|x-yaml|markdown))|\+(json|xml|yaml)")


def valid_bucket(name: Column) -> Column:
    return name.rlike("^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$") & ~name.startswith("xn--") & ~name.endswith("-s3alias")


def valid_key(key: Column) -> Column:
    """At most 1,024 bytes, no control characters, no .. segment and no percent-encoded one."""
    return (F.octet_length(key) <= 1024) & ~key.rlike(r"(^|/)\.\.(/|$)") & ~key.rlike("[\\x00-\\x1f]") & ~key.rlike(r"(?i)%2e%2e|%2e\.|\.\.%2e")


def parse_size(s: Column) -> Column:
    """KB, MB, GB, TB (by 1024) or bytes; null if it is none, and if it is more than 64 bits hold."""
    number, unit = F.regexp_extract(F.upper(F.trim(s)), r"^(\d+)\s*(KB|MB|GB|TB|B)?$", 1), F.regexp_extract(F.upper(F.trim(s)), r"^(\d+)\s*(KB|MB|GB|TB|B)?$", 2)
    scale = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).when(unit == "TB", 1 << 40).otherwise(1)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), scale.cast("long")))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """Key up to the first delimiter behind the prefix, or null if there is none."""
    rest = F.substring(key, len(prefix) + 1, 1 << 20)
    at = F.locate(delimiter, rest)
    return F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1)))


def glob(pattern: Column) -> Column:
    """A regular expression that matches what a pattern of * and ? matches."""
    escaped = F.regexp_replace(pattern, r"([\\\[\](){}.+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\?", "."), F.lit("$"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end) of a range header, or null where it can't be satisfied."""
    a, z = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    a, z = a.try_cast("long"), z.try_cast("long")
    start = F.when(a.isNull(), F.greatest(F.lit(0), size - z)).otherwise(a)
    end = F.when(a.isNull() | z.isNull(), size - 1).otherwise(F.least(z, size - 1))
    return F.when((a.isNotNull() | z.isNotNull()) & (start <= end) & (start < size), F.struct(start.alias("start"), end.alias("end")))


def glob_match(pattern: Column, text: Column) -> Column:
    """Whether a pattern of * (any text) and ? (one character) matches the whole text; all else stands for itself."""
    return F.rlike(text, glob(pattern))


def directory(key: Column) -> Column:
    """A key up to its last slash, empty without one."""
    return F.regexp_extract(key, "^(.*/)", 1)


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def strip_prefix(text: Column, prefix: str) -> Column:
    """The text without a prefix, whatever its case."""
    return F.when(F.lower(F.substring(text, 1, len(prefix))) == prefix.lower(), F.substring(text, len(prefix) + 1, 1 << 20)).otherwise(text)


def parse_filter(text: Column) -> Column:
    """k=v&k=v as a map; parts that aren't a key, one = and a value are left out, the last of equal keys wins."""
    parts = F.filter(F.split(text, "&"), lambda p: p.rlike("^[^=]+=[^=]*$"))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.split_part(p, F.lit("="), F.lit(2)).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x.key == e.key)))


def upload_allowed(content_type: Column, allowed: tuple[str, ...]) -> Column:
    """An empty list allows all; otherwise the type has to begin with one of the list."""
    return F.lit(True) if not allowed else F.exists(F.array(*[F.lit(a) for a in allowed]), lambda a: content_type.startswith(a))
