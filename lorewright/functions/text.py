"""Scalar text functions as Column expressions: white-space trim, tokens, identifiers, display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of a text that are Unicode white space ($ would also match before a last line end).
EDGES = r"\A[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without Unicode white space at either end (the built-in trim takes blanks only)."""
    return F.regexp_replace(col(c), EDGES, "")


def unix_lines(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\r\n"), F.lit("\n"))


def query_terms(c: Column | str) -> Column:
    """Lower-cased white-space tokens, repeats kept."""
    return F.filter(F.split(F.lower(col(c)), r"[\p{IsWhite_Space}]+", -1), lambda w: w != "")


def chunk_id(source: Column | str, index: Column | str) -> Column:
    """``source_index`` with path signs, dots and blanks as underscores; ``chunk_index`` without a source."""
    s = col(source)
    named = F.concat(F.translate(s, "/\\. ", "____"), F.lit("_"), col(index).cast("string"))
    return F.when(s.isNull() | (s == ""), F.concat(F.lit("chunk_"), col(index).cast("string"))).otherwise(named)


def agent_slug(c: Column | str) -> Column:
    s = F.lower(F.replace(col(c), F.lit(" "), F.lit("_")))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit("agent")).otherwise(s)


def embeddable(c: Column | str) -> Column:
    """What is sent to an embedder: trimmed, without NUL characters."""
    return F.regexp_replace(trim(c), "\\x00", "")


def is_rate_limited(c: Column | str) -> Column:
    c = col(c)
    return c.contains("429") | c.contains("Too Many Requests") | c.contains("rate limit")


def is_authorised(key: Column | str, path: Column | str, method: Column | str, header: Column | str) -> Column:
    """Whether a request passes: no key set, an open path or method, or the exact bearer token."""
    key, path, method, header = map(col, (key, path, method, header))
    exact = F.coalesce(header == F.concat(F.lit("Bearer "), key), F.lit(False))
    return F.coalesce(key, F.lit("")).eqNullSafe("") | (path == "/health") | (method == "OPTIONS") | exact


def short_count(c: Column | str) -> Column:
    """``n``, ``n (x.xK)`` or ``n (x.xM)``."""
    c = col(c)
    s = c.cast("string")
    thousands = F.concat(s, F.lit(" ("), F.format_string("%.1f", c / 1e3), F.lit("K)"))
    millions = F.concat(s, F.lit(" ("), F.format_string("%.1f", c / 1e6), F.lit("M)"))
    return F.when(c >= 1_000_000, millions).when(c >= 1_000, thousands).otherwise(s)


def short_duration(seconds: Column | str) -> Column:
    s = col(seconds)
    micro = F.concat((s * 1e6).cast("long").cast("string"), F.lit("µs"))
    milli = F.concat((s * 1e3).cast("long").cast("string"), F.lit("ms"))
    return F.when(s < 1e-3, micro).when(s < 1, milli).otherwise(F.format_string("%.1fs", s))


def pad_right(c: Column | str, width: int) -> Column:
    """Blanks up to a width in bytes; longer values stay whole."""
    c = col(c)
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.octet_length(c))))


def shown_url(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isNull() | (c == ""), F.lit("(not set)")).otherwise(F.rtrim(c, F.lit("/")))


def method_class(c: Column | str) -> Column:
    return F.when(col(c) == "GET", "read").when(col(c) == "POST", "write").when(col(c) == "OPTIONS", "probe").otherwise("other")


def status_class(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 500, "server error").when(c >= 400, "client error").when(c >= 300, "redirect").when(c >= 200, "ok").otherwise("other")
