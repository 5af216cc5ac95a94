"""Text helpers as column expressions: Unicode words, slugs, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.split() treats as white space, spelled out
# because Java's \s is ASCII only.
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def split_words(c: Column) -> Column:
    """str.split(): pieces between runs of white space, no empty strings."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(split_words(c)), F.lit(0))


def words(c: Column) -> Column:
    """All runs of word characters, in order."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def rstrip_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"/+$", "")


def slug(c: Column, length: int = 50) -> Column:
    """Lower case, punctuation dropped, white space and dashes to one dash."""
    kept = F.regexp_replace(strip(F.lower(c)), rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}-]", "")
    return F.left(F.regexp_replace(kept, rf"(?:{WS}|-)+", "-"), F.lit(length))


def truncate(c: Column, length: int) -> Column:
    """Cut to `length` characters, the last three being dots."""
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length - 3)), F.lit("..."))).otherwise(c)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal string (0 for an empty needle)."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(F.lit(0))


def keyword_density(text: Column, keyword: Column) -> Column:
    """100 × occurrences of the keyword per word of the text; 0 for no words."""
    n = word_count(text)
    return F.when(n > 0, occurrences(F.lower(text), F.lower(keyword)) * 100.0 / n).otherwise(F.lit(0.0))


VOWELS = "aeiouyàâäáãéèêëíìîïóòôöõúùûüœæ"


def vowel_groups(c: Column) -> Column:
    """Runs of vowels: they cut the text, which is held open at both ends, into one piece more."""
    return F.size(F.split(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), f"[{VOWELS}]+")) - 1


def readability(text: Column) -> Column:
    """Flesch reading ease; 100 for a text without words.

    Sentences are runs of . ! ? (at least one); syllables are vowel groups.
    Plain expressions, as Spark compiles them together; inside a lambda they are interpreted.
    """
    n, s = word_count(text), F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    return F.coalesce(206.835 - 1.015 * n / s - F.try_divide(84.6 * vowel_groups(text), n), F.lit(100.0))


def position_change(previous: Column, current: Column) -> Column:
    """Places gained; NULL when either position is unknown."""
    return previous - current


def volume_band(c: Column) -> Column:
    return (
        F.when(c >= 10000, "high").when(c >= 1000, "medium").when(c >= 100, "low").otherwise("very_low")
    )


def competition_band(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")
