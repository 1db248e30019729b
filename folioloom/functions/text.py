"""Text expressions: cleaning, tokens, audits, neutral CSV cells.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a document editor sees it, with the byte order mark. Fixed values.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Private-use characters: glyphs that a font mapped to no real character.
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
REFERENCE_TOKEN = "[가-힣a-z0-9]{2,}"
#: Particles that end a token, and words that carry no subject. Fixed values.
PARTICLES = ("으로", "에서", "에게", "부터", "까지", "처럼", "보다", "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "로", "도", "만")
STOP_WORDS = ("다음", "대한", "설명", "것은", "옳은", "있는", "보기", "고른", "the", "and", "of")


def clean(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def tokens(text: Column, pattern: str = REFERENCE_TOKEN, particles: tuple = PARTICLES, stop: tuple = STOP_WORDS) -> Column:
    """Distinct lower-case tokens, one trailing particle removed, two characters at least, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    if particles:
        ending = "(" + "|".join(particles) + r")\z"
        found = F.transform(found, lambda t: F.regexp_replace(t, ending, ""))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stop)) if stop else F.filter(found, lambda t: F.length(t) >= 2)
    return F.array_distinct(kept)


def glyph_count(text: Column, pattern: str = PRIVATE_USE) -> Column:
    """Characters of a class, unresolved glyphs by default."""
    return F.regexp_count(text, F.lit(pattern))


def duplicated_stem(text: Column, least: int = 240) -> Column:
    """True if the text is one stem written twice (halves equal, at least ``least`` characters in all)."""
    bare = compact(text)
    half = (F.length(bare) / 2).cast("int")
    return (F.length(bare) >= least) & (F.length(bare) % 2 == 0) & (F.substring(bare, F.lit(1), half) == F.substring(bare, half + 1, half))


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet runs as a formula: an apostrophe before = + - @, also after spaces, control or format characters, and before tab or return; quotes doubled."""
    neutral = F.when(value.rlike(r"\A(?:[\s\p{Z}\p{Cc}\p{Cf}]*[=+\-@]|[\t\r])"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.concat(F.lit('"'), F.replace(neutral, F.lit('"'), F.lit('""')), F.lit('"'))


def display_width(text: Column) -> Column:
    """Columns that a text takes: two for East Asian wide characters, one for others."""
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"))
    return F.length(text) + wide


def version_key(tag: Column) -> Column:
    """Sortable form of a stable v-tag; null where the tag is none or a number exceeds 2**53 - 1."""
    numbers = [F.regexp_extract(tag, r"\Av?(\d+)\.(\d+)\.(\d+)\z", k).try_cast("bigint") for k in (1, 2, 3)]
    safe = numbers[0].isNotNull()
    for n in numbers:
        safe = safe & n.isNotNull() & (n <= (1 << 53) - 1)
    return F.when(safe, F.array(*numbers))
