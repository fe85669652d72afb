"""Text functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.pdf.crypt import PERMISSIONS

#: White space that trimming removes (fixed values: Unicode's White_Space), as a class both Java and RE2 read.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: ASCII white space of regular expressions.
BLANK = r"[\t\n\f\r ]"
BULLETS = "•◦▪▫■□●○"
MARKS = "-*+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ZERO_WIDTH = "​‌‍﻿"
CJK = r"[\x{4E00}-\x{9FFF}]"
CJK_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2CEAF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
NUMBERED = rf"^\d+[.)]{BLANK}+"
NUMBERED_HEADING = rf"^\d+(\.\d+)*\.?{BLANK}+[A-Z]"
#: Accented letters and their base letters (fixed values).
FOLDS = {
    "a": "àáâãäåāăąæ", "A": "ÀÁÂÃÄÅĀĂĄÆ", "e": "èéêëēĕėęě", "E": "ÈÉÊËĒĔĖĘĚ", "i": "ìíîïĩīĭį", "I": "ÌÍÎÏĨĪĬĮ",
    "o": "òóôõöōŏőœ", "O": "ÒÓÔÕÖŌŎŐŒ", "u": "ùúûüũūŭůűų", "U": "ÙÚÛÜŨŪŬŮŰŲ", "n": "ñńņň", "N": "ÑŃŅŇ", "c": "çćĉċč", "C": "ÇĆĈĊČ", "s": "ß",
}
FOLD_FROM = "".join(FOLDS.values())
FOLD_TO = "".join(k * len(v) for k, v in FOLDS.items())


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def is_all_caps(c: Column) -> Column:
    """Some A-Z and no a-z."""
    return c.rlike("[A-Z]") & ~c.rlike("[a-z]")


def is_bullet(t: Column) -> Column:
    """A trimmed line that starts with a bullet, a list mark or a list number."""
    return t.rlike(rf"^[{BULLETS}*+\-]") | t.rlike(NUMBERED)


def is_heading(t: Column, next_trimmed: Column) -> Column:
    """A trimmed line is a heading: short, and all capitals, before a blank line, or numbered. ``next_trimmed`` is null at the end."""
    size = F.octet_length(t)
    before_blank = F.coalesce(next_trimmed == "", F.lit(False)) & ~t.endswith(".") & ~t.endswith(",") & (size < 80)
    return (t != "") & (size <= 100) & ((is_all_caps(t) & (size > 3)) | before_blank | t.rlike(NUMBERED_HEADING))


def heading_level(t: Column) -> Column:
    return (
        F.when(t.rlike(rf"^\d+\.{BLANK}+"), 1).when(t.rlike(rf"^\d+\.\d+{BLANK}+"), 2).when(t.rlike(rf"^\d+\.\d+\.\d+{BLANK}+"), 3)
        .when(is_all_caps(t), 1).otherwise(2)
    )


def list_item(t: Column) -> Column:
    """A list line as Markdown writes it."""
    return (
        F.when(t.rlike(f"^[{BULLETS}]"), F.concat(F.lit("- "), trim(F.substring(t, 2, 1 << 30))))
        .when(t.rlike(NUMBERED), F.regexp_replace(t, rf"^(\d+)\){BLANK}+", "$1. "))
        .when(t.rlike(r"^[-*+] "), t).otherwise(F.concat(F.lit("- "), t))
    )


def is_code(line: Column) -> Column:
    """A line indented by four columns or more, a tab counting four."""
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.length(indent) + 3 * F.regexp_count(indent, F.lit(r"\t")) >= 4


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalise(c: Column) -> Column:
    """A-Z lower-cased and zero-width characters dropped: what case-insensitive search looks through."""
    return F.translate(c, UPPER + ZERO_WIDTH, LOWER)


def ascii_fold(c: Column) -> Column:
    """Normalised, accents dropped, and what is still outside ASCII left out."""
    return F.regexp_replace(F.translate(normalise(c), FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


def is_hyphenated(line: Column) -> Column:
    return line.rlike("[-­]\\z")


def rotation(a: Column, b: Column) -> Column:
    """Quarter turns of a text matrix."""
    angle = F.degrees(F.atan2(b, a))
    return F.when((angle >= -45) & (angle < 45), 0).when((angle >= 45) & (angle < 135), 1).when((angle >= 135) | (angle < -135), 2).otherwise(3)


def pdf_date(c: Column) -> Column:
    """``D:YYYYMMDDHHmmSSOHH'mm'`` as a timestamp: missing parts are the first, parts out of range give null."""
    form = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(?:(\d{2})'?)?)?"
    part = lambda k, least: F.coalesce(F.regexp_extract(c, form, k).try_cast("int"), F.lit(least))
    sign = F.regexp_extract(c, form, 8)
    minutes = F.when(sign == "", 0).otherwise(F.when(sign == "-", -1).otherwise(1) * (part(9, 0) * 60 + part(10, 0)))
    at = F.try_make_timestamp(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(c.rlike(form), at - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)))


def to_number(c: Column) -> Column:
    """A number as forms coerce it: what isn't one counts 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
PHONE = r"^[\d\t\n\f\r \-+()]{7,20}\z"


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def is_phone(c: Column) -> Column:
    return c.rlike(PHONE)


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def permission(bits: Column, name: str) -> Column:
    """Whether the permission flags of an encrypted file allow this."""
    return bits.bitwiseAND(F.lit(dict(PERMISSIONS)[name])) != 0


def compression_ratio(n_bytes: Column, width: Column, height: Column, components: Column, bpc: Column) -> Column:
    """Stored bytes in whole percent of the bytes of an image's samples."""
    full = F.call_function("div", width.cast("long") * height * components * bpc, F.lit(8))
    return F.when(full > 0, F.call_function("div", n_bytes * 100, full))


def cmyk(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """Cyan, magenta, yellow and black of an RGB colour (each 0 to 1)."""
    k = 1 - F.greatest(r, g, b)
    part = lambda x: F.when(k >= 1, 0.0).otherwise((1 - x - k) / (1 - k))
    return part(r), part(g), part(b), k
