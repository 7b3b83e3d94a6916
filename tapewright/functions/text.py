"""Text expressions: normalising messages, HTML to text, redaction, small helpers.

NFKC has no built-in; that one step is a pandas UDF over the column. All else
is regular expressions in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two strings, a swap of neighbours counting one; null with null. One table of distances for all pairs of a batch."""

    def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points, a row a place and a column a text, and lengths."""
        size = np.array([len(x) for x in texts])
        wide = max(int(size.max()), 1)
        flat = np.frombuffer("".join(x.ljust(wide, "\0") for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.ascontiguousarray(flat.reshape(len(texts), wide).T), size

    def table(a: list[str], b: list[str]) -> np.ndarray:
        (x, n), (y, m) = letters(a), letters(b)
        out = np.where(n == 0, m, 0).astype(np.int32)
        before, last = None, np.repeat(np.arange(len(y) + 1, dtype=np.int32)[:, None], len(a), 1)
        for i in range(1, int(n.max()) + 1):
            row = np.empty_like(last)
            row[0] = i
            row[1:] = np.minimum(last[1:] + 1, last[:-1] + (x[i - 1] != y))
            if before is not None:
                swap = (x[i - 1] == y[:-1]) & (x[i - 2] == y[1:])
                row[2:] = np.where(swap, np.minimum(row[2:], before[:-2] + 1), row[2:])
            for j in range(1, len(row)):
                np.minimum(row[j], row[j - 1] + 1, out=row[j])
            done = n == i
            out[done] = row[m[done], done.nonzero()[0]]
            before, last = last, row
        return out

    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    known = a.notna() & b.notna()
    if known.any():
        out[known] = table(a[known].tolist(), b[known].tolist())
    return out


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Numeric entities, and the six named ones; others stay."""
    named = dict(P.ENTITIES)

    def one(m):
        if m[1]:
            return chr(int(m[1]))
        return chr(int(m[2], 16)) if m[2] else named.get(m[3].lower(), m[0])

    return s.map(lambda x: None if x is None else re.sub(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z]+));", one, x))


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(p|div|blockquote|pre)>", "\n")
    return F.regexp_replace(c, r"<[^>]+>", "")


def html_to_text(c: Column) -> Column:
    """Line breaks and block ends become newlines, tags go, entities are read, blanks before newlines and at the ends go."""
    c = F.regexp_replace(unescape_html(strip_tags(c)), r"[ \t]+\n", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# fixed values: trade words, then numbers in brackets, broker shorthand, refusals, currency, thousands, amounts, list marks, charset.
# The charset names what it takes out: Java tries the ranges of a negated class one by one, at many times the cost
_REWRITES = (
    *P.HINGLISH,
    (r"\(\s*(\d+(?:\.\d+)?)\s*\)", " $1 "),
    (r"\bNSECALL\s+([A-Z&-]+)\s+(\S+)\s+(\d+(?:\.\d+)?)", "$1 $2 $3 CE"),
    (r"\bNSEPUT\s+([A-Z&-]+)\s+(\S+)\s+(\d+(?:\.\d+)?)", "$1 $2 $3 PE"),
    (r"\b(?:DON'?T|DO\s+NOT|NOT\s+A)\s+BUY\b", " "),
    (r"\bRS\.?(?=\s*\d)|\bINR\b", " "),
    (r"₹", " "),
    (r"/-", " "),
    (r"\b(\d{1,2}),(\d{2}),(\d{3})\b", "$1$2$3"),
    (r"\b(\d{1,2}),(\d{3})\b(?!,\d)", "$1$2"),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*(?:K|LAKHS?|LACS?|CR|CRORES?|X+)\b", " "),
    (r"(?<![\d.])[1-4]\)", " "),
    (r"[\x00-\x09\x0B-\x1F!\"*;<?\[-\x{10FFFF}]", " "),
    (r"[ \t]+", " "),
)


def _changes() -> str:
    """A pattern found in every text that a rewrite changes; where it is not found, each of them leaves the text as it was.

    One blank for one is no change. What may not stand before a number is left out, which finds more.
    """
    asked = [p for p, _ in _REWRITES[:-1]]
    words = [p for p in asked if P.led(p) != p]
    others = [p.removeprefix(r"(?<![\d.])") for p in asked if p not in words]  # none of them begins with a letter
    return P.led("|".join(words)) + r"|(?![A-Z])(?:" + "|".join([*others, r"[ \t]{2,}|\t"]) + ")"


def normalise(c: Column) -> Column:
    """Upper-cased text with Hindi and Hinglish trade words in English, and numbers that are no prices taken out. Order matters."""
    raw = nfkc(c)
    c = F.translate(raw, P.DEVANAGARI_DIGITS, "0123456789")
    hindi = c
    for pattern, to in P.HINDI:
        hindi = F.regexp_replace(hindi, pattern, to)
    # most texts have no Devanagari at all
    c = F.upper(F.when(c.rlike(r"[\x{900}-\x{97F}]"), hindi).otherwise(c))
    # letters of other scripts are blanks in the end; until then they are no part of words, for which Java's boundaries take them
    c = F.regexp_replace(c, r"[^\x00-\x7F₹]", "\x01")
    # as many bytes as characters: ASCII, which has nothing of this
    c = F.when(F.octet_length(raw) == F.length(raw), F.upper(raw)).otherwise(c)

    def rewritten(x: Column) -> Column:
        for pattern, to in _REWRITES:
            x = F.regexp_replace(x, pattern, to)
        return x

    # a lambda's variable is worked out once, however often it is named
    return F.get(F.transform(F.array(c), lambda x: F.when(x.rlike(_changes()), rewritten(x)).otherwise(x)), F.lit(0))


def scrub(c: Column, names: list[str]) -> Column:
    """Names, links, payment ids, handles and phone numbers redacted, in this order."""
    for n in names:
        c = F.regexp_replace(c, "(?i)" + re.escape(n), "[channel name]")
    # fixed values: the redactions
    for pattern, to in (
        (r"(?i)https?://t\.me/(?:\+|joinchat/)\S+", "t.me/+[link removed]"),
        (r"(?i)https?://(?:wa\.me|api\.whatsapp\.com)\S*", "wa.me/[number removed]"),
        (r"(?i)https?://chat\.whatsapp\.com/\S+", "chat.whatsapp.com/[link removed]"),
        (r"(?i)https?://\S+", "[link removed]"),
        (r"(?i)\bwww\.\S+", "[link removed]"),
        (r"(?i)\b[\w.-]{3,}@(ybl|okaxis|okhdfcbank|okicici|oksbi|paytm|upi|ibl|axl|apl)\b", "[id removed]@$1"),
        (r"@[A-Za-z][A-Za-z0-9_]{3,}", "@[handle removed]"),
        (r"(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b", "[number removed]"),
    ):
        c = F.regexp_replace(c, P.bounded(pattern), to)
    return c


def squash(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9&]", "")


def squash_unicode(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def words_unicode(c: Column) -> Column:
    """Words of three letters or more, lower case, space-joined."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{3,}"), F.lit(0)), " ")


def numbers_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(P.NUM), F.lit(0)), lambda x: x.cast("double"))


def one_line(c: Column, most: int | None = None) -> Column:
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return c if most is None else F.left(c, F.lit(most))


def file_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9-]", "_")


def option_key(strike: Column, opt_type: Column) -> Column:
    """24500CE; up to two decimals without trailing zeros."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", strike.cast("double")), r"\.?0+$", ""), opt_type)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null where there is none. In texts of other scripts the pattern has to be ``bounded``."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


