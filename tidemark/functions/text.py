"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits of any script.
NON_WORD = r"[^a-zA-Z0-9\p{L}\p{N}]++"


def clean_host(c: Column) -> Column:
    """A host without surrounding space, in lower case, without a trailing dot; blank becomes null."""
    h = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\.$", "")
    return F.nullif(h, F.lit(""))


def words_text(c: Column) -> Column:
    """The words of a text in lower case, parted by one blank each."""
    return F.lower(F.trim(F.regexp_replace(c, NON_WORD, " ")))


def day_of(epoch: Column) -> Column:
    """UTC day ``yyyy-MM-dd`` of epoch seconds; null and NaN have no day."""
    return F.date_format(F.timestamp_seconds(F.nanvl(epoch, F.lit(None).cast("double"))), "yyyy-MM-dd")


#: A search token: letters and digits of any script, joined by apostrophes or hyphens.
TOKEN = r"([a-z0-9\p{L}\p{N}]++(?:['’-][a-z0-9\p{L}\p{N}]++)*+)"


def fold(c: Column) -> Column:
    """Compatibility characters and letter cases made one (NFKC, then full case folding). Null gives the empty text.

    ASCII texts are put in lower case; others go through the ICU library that Spark brings along, in the JVM.
    """
    c = F.coalesce(c, F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.when(F.octet_length(c) > F.char_length(c), folded).otherwise(F.lower(c))


def folded(text: str) -> str:
    """The same for one text of the driver."""
    return unicodedata.normalize("NFKC", text).casefold()


def tokens(c: Column) -> Column:
    """Array of search tokens in order; empty for null."""
    return folded_tokens(fold(c))


def folded_tokens(c: Column) -> Column:
    """Search tokens of a text that is folded already."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def ascii_words(c: Column) -> Column:
    """Array of ASCII words in lower case; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
