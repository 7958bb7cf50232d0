"""Column expressions on text: folding, tokens, hashes, source kinds, displays."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

#: Blocks of combining marks that folding drops, first and last code point (fixed values).
MARKS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F))
#: Hangul syllables, and the first of their leading, middle and trailing letters with the numbers of the latter two (Unicode, fixed values).
SYLLABLES, LEAD, VOWEL, TAIL, VOWELS, TAILS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7, 21, 28


@cache
def _decompositions() -> tuple[str, str, tuple[str, ...], tuple[str, ...]]:
    """Characters that become one, with those, then the marks, which become none; characters that become several, with those."""
    marks = {i for lo, hi in MARKS for i in range(lo, hi + 1)}
    one, several = {}, {}
    for i in range(0x80, 0x110000):
        if 0xD800 <= i < 0xE000 or SYLLABLES[0] <= i <= SYLLABLES[1]:
            continue
        whole = unicodedata.normalize("NFKD", chr(i))
        bare = "".join(c for c in whole if ord(c) not in marks)
        if bare != chr(i):
            (several if len(bare) > 1 else one)[chr(i)] = bare
    none = [c for c, d in one.items() if not d]
    ones = {c: d for c, d in one.items() if d}
    return "".join([*ones, *none]), "".join(ones.values()), tuple(several), tuple(several.values())


def _syllable(c: Column) -> Column:
    """The letters of a Hangul syllable."""
    at = F.ascii(c) - SYLLABLES[0]
    row = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))
    pick = lambda letters, i: F.substr(letters, i.cast("int"), F.lit(1))
    lead = pick(row(LEAD, 19), F.floor(at / (VOWELS * TAILS)) + 1)
    vowel = pick(row(VOWEL, VOWELS), F.floor(at % (VOWELS * TAILS) / TAILS) + 1)
    tail = F.when(at % TAILS > 0, pick(row(TAIL + 1, TAILS - 1), at % TAILS)).otherwise(F.lit(""))
    return F.concat(lead, vowel, tail)


def fold(text: Column) -> Column:
    """Lower case of the full compatibility decomposition without its combining marks; null for null.

    `É` is `e`, `ﬁ` is `fi`, `™` is `tm`. Marks outside MARKS stay, in the order they stand in. Texts of ASCII alone are only
    lowered; characters that become several are looked up once for each kind of them in a text.
    """
    before, after, several, parts = _decompositions()
    syllables = f"[{chr(SYLLABLES[0])}-{chr(SYLLABLES[1])}]"
    part = lambda c: F.element_at(F.split(F.lit("\n".join(parts)), "\n"), F.position(c, F.lit("".join(several))))
    spread = lambda t: F.aggregate(F.array_intersect(F.split(t, ""), F.split(F.lit("".join(several)), "")), t, lambda done, c: F.replace(done, c, part(c)))
    letters = lambda t: F.when(t.rlike(syllables), F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(syllables), _syllable(c)).otherwise(c)), "")).otherwise(t)
    wide = F.transform(F.array(F.translate(text, before, after)), lambda t: letters(spread(t)))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(wide.getItem(0)))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; none for a null text."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def content_hash(tenant: Column, text: Column) -> Column:
    """sha256 of tenant, a zero byte and the content, in hex. Nulls count as empty."""
    return F.sha2(F.concat(F.coalesce(tenant, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def source_kind(path: Column) -> Column:
    """text, markdown or document:<ext> by file extension; null without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext == "txt", "text").when(ext != "", F.concat(F.lit("document:"), ext))


def is_source_label(label: Column) -> Column:
    """Whether a source argument is text, markdown or document:<ext> with up to 8 letters or digits."""
    return F.coalesce(label.rlike(r"^(text|markdown|document:[a-z0-9]{1,8})$"), F.lit(False))


def node_display(name: Column, file: Column, start: Column, end: Column) -> Column:
    """name (file#Lx-Ly), or name (file#Lx) for a single line."""
    return F.concat(name, F.lit(" ("), file, F.lit("#L"), start.cast("string"), F.when(end > start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(F.lit("")), F.lit(")"))


def plain_text(content: Column) -> Column:
    """Text of UTF-8 bytes without a byte-order mark; null if they are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and tags go, blanks collapse."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
