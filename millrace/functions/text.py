"""Text functions. Nulls stay null; letters and white space are Unicode's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def title(c: Column) -> Column:
    """A capital after anything that is no letter, small letters after letters."""
    pieces = F.split(F.lower(c.cast("string")), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))), "")


def substring(c: Column, start: int, end: int = 0) -> Column:
    """From start (0 is the first) to before end; end 0 is to the end."""
    t = c.cast("string")
    return F.substring(t, start + 1, end - start if end else 2**31 - 1)


def replace(c: Column, old: str, new: str, case: bool = True) -> Column:
    return F.regexp_replace(c.cast("string"), ("" if case else "(?i)") + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def concat(*cols: Column, sep: str = "") -> Column:
    """Joined by sep, null as empty."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def remove(c: Column, what: str, pattern: str | None = None) -> Column:
    """punctuation, digits, specials or a pattern of one's own."""
    patterns = {"punctuation": r"(?U)[^\w\s]", "digits": r"(?U)\d+", "specials": r"(?U)[^a-zA-Z0-9\s]"}
    return F.regexp_replace(c.cast("string"), patterns.get(what, pattern), "")


def apply(c: Column, op: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": title, "strip": strip, "length": F.length}[op](c.cast("string"))
