"""Text expressions: normalisation, headings, escapes and predicates. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a character class, the same for Java and RE2.
SPACE = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters one by one.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Private-use bullets (two blocks of twenty) stand for the circled numbers 1 to 20.
BULLETS_FROM = "".join(chr(c) for start in (0xF02B1, 0xF2B1) for c in range(start, start + 20))
BULLETS_TO = 2 * "".join(chr(0x2460 + i) for i in range(20))
#: Sentence endings that rule out a heading, and caption labels.
PROSE_ENDINGS = ("다.", "함.", "임.", "음.")
CAPTION_LABELS = ("그림", "표", "Figure", "Table")


def trim_all(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def plain_spaces(x: Column) -> Column:
    """clean_text without its trimming."""
    plain = F.translate(x, BULLETS_FROM + "\u00a0\u2003\ufffc\u00ad", BULLETS_TO + "  ")
    return F.regexp_replace(plain, "  +", " ")


def clean_text(x: Column) -> Column:
    """Object and soft-hyphen marks go, hard and em spaces become spaces, bullets become circled numbers, runs of spaces one."""
    return trim_all(plain_spaces(x))


def clean_lines(text: Column) -> Column:
    """The array of a text's lines, each as clean_text gives it: marks and spaces are replaced in the whole text. Null: null."""
    return F.transform(F.split(plain_spaces(text), "\n"), trim_all)


def visible(x: Column) -> Column:
    """Without white space and object marks."""
    return F.translate(x, WHITE + "\ufffc", "")


def strip_caption_label(x: Column) -> Column:
    return F.regexp_replace(x, rf"^(?:{'|'.join(CAPTION_LABELS)}) \. ", "")


def box_heading_level(x: Column) -> Column:
    """2 for `12. `, 3 for `(a) ` with letters, digits or syllables inside, else null."""
    head = F.regexp_replace(x, f"^[{SPACE}]+", "")
    return F.when(head.rlike(r"^[0-9]+\. "), 2).when(head.rlike(r"^\([0-9A-Za-z가-힣]+\) "), 3)


def text_heading_level(x: Column) -> Column:
    """Number of parts of a leading `1.2.3` that white space follows, at most 6; null for long lines and for prose."""
    return cleaned_heading_level(clean_text(x))


def cleaned_heading_level(text: Column) -> Column:
    """text_heading_level of what is clean already. The number is looked for first, since few lines have one."""
    number = rf"^([0-9.]*[0-9][0-9.]*)[{SPACE}]"
    count = F.size(F.filter(F.split(F.regexp_extract(text, number, 1), r"\."), lambda p: p != ""))
    prose = F.lit(False)
    for ending in PROSE_ENDINGS:
        prose = prose | F.endswith(text, F.lit(ending))
    return F.when(text.rlike(number) & (F.length(text) <= 100) & ~prose, F.least(count, F.lit(6)))


def style_heading_level(name: Column, english: Column) -> Column:
    """Of an outline style's native name, then of its English one."""

    def of(x: Column) -> Column:
        level = F.regexp_extract(x, r"^(?:개요|Outline) ([1-6])$", 1)
        return F.when(level != "", level.cast("int")).when(x.isin("차례 제목", "TOC Heading"), 1)

    return F.coalesce(of(name), of(english))


def is_mostly_numeric(x: Column) -> Column:
    """Nine tenths of the characters are digits or number marks."""
    text = trim_all(x)
    marks = F.length(F.regexp_replace(text, r"[^0-9.,\-+%/() :]", ""))
    return (text != "") & (marks * 10 >= F.length(text) * 9)


def is_time_token(x: Column) -> Column:
    text = trim_all(x)
    return text.rlike(r"^[0-9]{1,2}$") | text.rlike(rf"^[0-9]+[{SPACE}]*(?:Q|q|월|분기|주차|주|년차|년)$")


def substring_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; none of an empty needle."""
    return F.when(needle == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def escape_record(x: Column) -> Column:
    """Backslash, line break and tab as two characters each."""
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def unescape_record(x: Column) -> Column:
    """Inverse of escape_record; unknown escapes stay. Doubled backslashes part the text, so no other escape can take half of one."""
    parts = F.split(x, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))), "\\")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_cell(x: Column) -> Column:
    """For a Markdown table cell: pipes escaped, line breaks as spaces."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def has_visible_body(x: Column) -> Column:
    """Something other than tags and white space."""
    return visible(F.regexp_replace(x, "<[^>]*>?", "")) != ""


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("int")


def atx_level(x: Column) -> Column:
    level = F.length(F.regexp_extract(x, "^(#{1,6}) ", 1))
    return F.when(level > 0, level)


def atx_text(x: Column) -> Column:
    return F.regexp_replace(x, "^#{1,6} ", "")


def markdown_kind(x: Column) -> Column:
    """llm, human or assets by the stamp on the first non-blank line, else llm by a section record, else unknown."""
    first = F.regexp_extract(x, rf"^[{SPACE}]*([^\n]*)", 1)
    stamp = F.regexp_extract(first, r"^<!-- [A-Za-z0-9._-]+:(llm|human|assets)\b", 1)
    return F.when(stamp != "", stamp).when(F.startswith(first, F.lit("SECTION[id=")), "llm").otherwise("unknown")
