"""Text scalars. All are plain column expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, written so that Java and RE2 read it alike; BLANKS are the same characters.
_OTHER = (
    r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[ {_OTHER}]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Runs that are not already one blank: most runs are, and need no replacing.
_RUN = f" {SPACE}+|[{_OTHER}]{SPACE}*"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Whitespace runs to one blank, none at the ends; case kept."""
    return F.btrim(F.regexp_replace(c, _RUN, " "), F.lit(" "))


def normalize(c: Column) -> Column:
    """Matching key for names: lower case, collapsed whitespace."""
    return collapse(F.lower(c))


def slug(c: Column) -> Column:
    """Lower case; every run outside a-z0-9 becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def tokens(c: Column) -> Column:
    """Lower-cased a-z0-9 runs, in order."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), F.lit(""))


def preview(c: Column, width: int) -> Column:
    return F.left(collapse(c), F.lit(width))


def ellipsis(c: Column, width: int = 800) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def file_key(collection: Column, path: Column) -> Column:
    return F.concat_ws("::", collection, path)


def first_nonblank(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def interface_endpoints(name: Column) -> tuple[Column, Column]:
    """Source and target of an interface named ``A to B`` (an ``LI`` suffix is dropped)."""
    pattern = r"(?i)^(.+?)\s+to\s+(.+?)(?:\s+LI)?$"
    side = lambda i: F.nullif(strip(F.regexp_extract(name, pattern, i)), F.lit(""))
    return side(1), side(2)


def excerpt(text: Column, mention: Column, window: int = 600) -> Column:
    """Up to ``window`` characters around the first mention, widened to whole words.

    Without a mention the first ``window`` characters are returned.
    Positions below are 1-based, as Spark's string functions count.
    """
    half = window // 2
    at = F.position(F.lower(mention), F.lower(text))
    begin = F.greatest(F.lit(1), at - half)
    until = F.least(F.length(text), at - 1 + half)
    head = F.left(text, begin)
    last_blank = F.position(F.lit(" "), F.reverse(head))
    begin = F.when((begin > 1) & (last_blank > 0), begin - last_blank + 2).otherwise(begin)
    next_blank = F.position(F.lit(" "), F.substr(text, F.greatest(until, F.lit(1))))
    until = F.when((until < F.length(text)) & (next_blank > 0), until + next_blank - 2).otherwise(until)
    window_text = strip(F.substr(text, begin, F.greatest(until - begin + 1, F.lit(0))))
    return F.when(at == 0, F.left(text, F.lit(window))).otherwise(window_text)
