"""String functions of log normalisation. Absent strings are empty, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def session_suffix(x: Column) -> Column:
    """What follows the first session marker, to the end of the string; empty without one."""
    at = F.instr(_text(x), "_session_")
    return F.when(at > 0, F.substr(x, at + 9)).otherwise("")


def session_from_id(x: Column) -> Column:
    """session_id of a JSON object, else what follows the marker."""
    return F.coalesce(F.nullif(F.get_json_object(x, "$.session_id"), F.lit("")), session_suffix(x))


def stable_id(session_id: Column, *parts: Column) -> Column:
    """The session id, else 16 hex digits of the SHA-256 of parts, with a NUL after each."""
    joined = F.concat(*(p for part in parts for p in (_text(part), F.lit("\0"))))
    return F.when(_text(session_id) != "", session_id).otherwise(F.substring(F.sha2(joined, 256), 1, 16))


def sanitize_filename(x: Column) -> Column:
    """One flat file name: separators and parent steps become underscores; a name that is empty or a dot is 16 hex digits of its SHA-256."""
    clean = F.replace(F.translate(_text(x), "/\\:", "___"), F.lit(".."), F.lit("__"))
    return F.when(clean.isin("", "."), F.substring(F.sha2(_text(x), 256), 1, 16)).otherwise(clean)


def short_model(x: Column) -> Column:
    """The last path segment without a two-character region prefix and a -v1 suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(x), "^.*/", ""), r"^[^.]{2}\.", ""), "-v1$", "")


def base64_length(x: Column) -> Column:
    """Decoded bytes by arithmetic on length and padding."""
    n = F.length(_text(x))
    return F.floor(n * 3 / 4) - (n - F.length(F.replace(_text(x), F.lit("="), F.lit(""))))


def data_uri(x: Column) -> Column:
    """struct<mime, payload> of a base64 data URI; empty strings otherwise."""
    pattern = "^data:([^;]*);base64,(.*)$"
    return F.struct(F.regexp_extract(_text(x), pattern, 1).alias("mime"), F.regexp_extract(_text(x), pattern, 2).alias("payload"))


def path_segment(x: Column, key: str) -> Column:
    """The segment after the first segment named key; a plain name without pattern characters."""
    return F.regexp_extract(_text(x), f"(?:^|/){key}/([^/]+)", 1)


def arm_segment(x: Column, key: str) -> Column:
    """As path_segment, in either case."""
    return F.regexp_extract(_text(x), f"(?i)/{key}/([^/]+)", 1)


def duration_label(ms: Column) -> Column:
    """Milliseconds under a second, else seconds with one decimal.

    Half a tenth goes the way of the binary number ms / 1000, to the even tenth where it is exact, as C's %.1f does.
    """
    part, seconds = ms % 1000, ms.cast("double") / 1000
    f = seconds - F.floor(seconds)
    # f is cut in two, so that neither product with 1000 is rounded
    high = F.floor(f * (1 << 26)) / (1 << 26)
    off = (high * 1000 - part) + (f - high) * 1000
    tenths = F.floor(ms / 100)
    up = F.when(ms % 100 != 50, ms % 100 > 50).otherwise((off > 0) | (off == 0) & (tenths % 2 == 1))
    rounded = tenths + up.cast("long")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("s")))


def truncated(x: Column, n: int) -> Column:
    """The first n characters and three dots of a longer string."""
    return F.when(F.length(_text(x)) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(_text(x))


def short_session(x: Column) -> Column:
    """The first eight characters."""
    return F.left(_text(x), F.lit(8))


def grouped_digits(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


#: Bytes of a body that are shown inline.
PREVIEW = 32 * 1024


def preview(x: Column, limit: int = PREVIEW) -> Column:
    """x, or its longest whole-character prefix of at most limit bytes with a note of both sizes."""
    raw = F.encode(_text(x), "utf-8")
    # a character's later bytes have 10 as their top bits; there are three of them at most
    begins = lambda at: ~F.substring(F.hex(F.substring(raw, at + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    cut = F.coalesce(*(F.when(begins(limit - back), F.lit(limit - back)) for back in range(4)))
    note = F.format_string("\n\n[first %d bytes of %d]", cut, F.octet_length(x))
    return F.when(F.octet_length(_text(x)) <= limit, _text(x)).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), cut), "utf-8"), note))
