"""Attribute bits, colours, lengths and identifiers. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml", "wmf": "image/x-wmf", "emf": "image/x-emf"}
#: Character-shape bits by name: first bit and width.
CHAR_BITS = {"italic": (0, 1), "bold": (1, 1), "underline_kind": (2, 3), "underline_shape": (5, 3), "outline_kind": (8, 3), "shadow_kind": (11, 4), "emboss": (15, 1), "engrave": (16, 1), "script": (17, 2), "strike": (21, 1)}
#: Paragraph-shape bits.
PARA_BITS = {"align": (0, 3), "snap_to_grid": (6, 1), "keep_with_next": (16, 1), "keep_lines": (17, 1), "page_break_before": (18, 1), "heading_level": (24, 3)}
#: Alignment and line-spacing names by their numbers.
ALIGN = ("justify", "left", "right", "center", "distribute", "divide")
SPACING = ("percent", "fixed", "between_lines", "at_least")


def bits(x: Column, first: int, width: int) -> Column:
    return F.shiftright(x, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def bit_columns(x: Column, table: dict[str, tuple[int, int]]) -> list[Column]:
    return [bits(x, *where).alias(name) for name, where in table.items()]


def to_mm(units: Column) -> Column:
    """7200ths of an inch to whole millimetres, halves up."""
    return F.floor(units.cast("double") * 25.4 / 7200 + 0.5).cast("int")


def colour_hex(bgr: Column) -> Column:
    """A 0x00BBGGRR number as #RRGGBB."""
    return F.format_string("#%02X%02X%02X", bits(bgr, 0, 8), bits(bgr, 8, 8), bits(bgr, 16, 8))


def colour_number(x: Column) -> Column:
    """Inverse of colour_hex; anything malformed is red."""
    part = lambda at: F.conv(F.substring(x, at, 2), 16, 10).cast("int")
    return F.when(x.rlike("^#[0-9A-Fa-f]{6}$"), part(2) + part(4) * 256 + part(6) * 65536).otherwise(255)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 1e-6), F.lit(255)).cast("int")


def tone(r: Column, g: Column, b: Column, a: Column) -> Column:
    """none, pale, mid or dark for greys by luminance; accent_<hue> where the channels are 12 or more apart."""
    high, low, y = F.greatest(r, g, b), F.least(r, g, b), luminance(r, g, b)
    grey = F.when(y <= 119, "dark").when(y <= 199, "mid").when(y <= 240, "pale").otherwise("none")
    red = F.when(b >= g, "magenta").when(g >= r - 40, "yellow").otherwise("red")
    green = F.when(b >= r, "cyan").otherwise("green")
    hue = F.when((r >= g) & (r >= b), red).when((g >= r) & (g >= b), green).when(r >= g, "magenta").otherwise("blue")
    return F.when(a == 0, "none").when(high - low < 12, grey).otherwise(F.concat(F.lit("accent_"), hue))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def mime_of(name: Column, default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(default))


def entry_number(name: Column) -> Column:
    """Of `BIN000A.png` the hexadecimal 10, of `image12.png` the first run of digits; null without one."""
    hexed = F.regexp_extract(name, r"^(?i:BIN)([0-9A-Fa-f]{4})", 1)
    digits = F.regexp_extract(name, "([0-9]+)", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("int")).when(digits != "", digits.cast("int"))


def base64_line(x: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(x), "[\r\n]", "")


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_line(content))


def line_segments_text(segments: Column) -> Column:
    """array<array<int>> as `a:b:..|a:b:..`."""
    return F.array_join(F.transform(segments, lambda s: F.array_join(s.cast("array<string>"), ":")), "|")


def line_segments(text: Column) -> Column:
    """Inverse of line_segments_text; a segment that isn't nine integers is left out."""
    rows = F.transform(F.split(text, r"\|"), lambda s: F.transform(F.split(s, ":"), lambda x: x.try_cast("int")))
    return F.filter(rows, lambda s: (F.size(s) == 9) & F.forall(s, lambda x: x.isNotNull()))


def name_of(number: Column, names: tuple[str, ...], default: str) -> Column:
    out = F.when(number == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        out = out.when(number == i, n)
    return out.otherwise(default)


#: Bits of a fill's kind, and the kinds of an embedded binary by their numbers.
FILL_BITS = {"is_color": (0, 1), "is_gradation": (1, 1), "is_image": (2, 1)}
BINARY_KINDS = ("link", "embedding", "storage")
#: First bytes of image files, in hex.
IMAGE_MAGIC = ("89504E47", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A", "52494646", "3C737667", "D7CDC69A", "01000000")
#: Extensions that browsers show.
WEB_NATIVE = ("png", "jpg", "jpeg", "gif", "webp", "svg")


def to_points(hundredths: Column) -> Column:
    """Hundredths of a point, as lengths and character sizes are stored, to points."""
    return hundredths.cast("double") / 100


def binary_kind(properties: Column) -> Column:
    """Number of an embedded binary's kind."""
    return bits(properties, 0, 4)


def binary_kind_columns(properties: Column) -> list[Column]:
    return [(binary_kind(properties) == i).alias(f"is_{name}") for i, name in enumerate(BINARY_KINDS)]


def char_count(stored: Column) -> Column:
    """Characters of a paragraph, without the marker in the top bit of 32."""
    return stored.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def has_marker(stored: Column) -> Column:
    return stored.cast("long").bitwiseAND(F.lit(0x80000000)) != 0


def looks_like_image(content: Column) -> Column:
    """Whether four bytes at least begin as an image file does; null counts as no content."""
    head = F.hex(F.substring(content, 1, 4))
    begins = F.lit(False)
    for magic in IMAGE_MAGIC:
        begins = begins | head.startswith(magic)
    return F.coalesce((F.octet_length(content) >= 4) & begins, F.lit(False))


def safe_entry_id(entry: Column) -> Column:
    """The id of a binary as a file name; null where it is empty, hidden, or would leave its folder."""
    unsafe = (entry == "") | entry.startswith(".") | entry.contains("/") | entry.contains("\\") | entry.contains("\x00")
    return F.when(~unsafe, entry)


def is_web_native(ext: Column) -> Column:
    return F.lower(ext).isin(*WEB_NATIVE)


def png_id(entry: Column) -> Column:
    """The id with its extension, or none, replaced by png."""
    return F.concat(F.regexp_replace(entry, r"(?s)\.[^.]*\z", ""), F.lit(".png"))


def css_font(name: Column) -> Column:
    return F.translate(name, "'\\", "")


def json_text(x: Column) -> Column:
    """Backslashes and quotes escaped."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
