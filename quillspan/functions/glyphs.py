"""Symbol fonts: which character a code of a dingbat font stands for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Code points of the fonts, and the characters of the same meaning.
WINGDINGS = {
    0x6C: "●", 0x6D: "❍", 0x6E: "■", 0x6F: "□", 0x70: "□", 0x71: "❑", 0x72: "❒", 0x73: "◆", 0x74: "◆", 0x75: "◆", 0x76: "❖", 0x77: "◆",
    0x9F: "•", 0xA7: "▪", 0xA8: "◻", 0xD8: "➢", 0xDF: "←", 0xE0: "→", 0xE8: "➔", 0xF0: "⇨", 0xFB: "✗", 0xFC: "✓", 0xFD: "☒", 0xFE: "☑",
}
ZAPF = {
    0x33: "✓", 0x34: "✔", 0x37: "✗", 0x38: "✘", 0x6C: "●", 0x6E: "■", 0x6F: "❏", 0x70: "❐", 0x71: "❑", 0x72: "❒", 0x75: "◆", 0x76: "❖",
    0xA8: "♣", 0xAA: "♥", 0xD5: "→",
}
SYMBOL = {0xAC: "←", 0xAE: "→", 0xB4: "×", 0xB7: "•", 0xD7: "×"}


FAMILIES = {"wingdings": WINGDINGS, "zapf": ZAPF, "symbol": SYMBOL}


def mapped(code: Column, font: Column) -> Column:
    """The standard character for a code point in a font; a bullet for unknown private ones; null where nothing is to change."""
    name = F.lower(F.coalesce(font, F.lit("")))
    kind = F.when(name.rlike("wingding|webding"), "wingdings").when(name.rlike("zapf|dingbat"), "zapf").when(name.rlike(r"symbol\z|\+symbol"), "symbol")
    raised = code.between(0xF000, 0xF0FF)
    key = F.concat(kind, F.lit(":"), F.when(raised, code - 0xF000).otherwise(code).cast("string"))
    meant = F.element_at(F.create_map(*(F.lit(x) for k, of in FAMILIES.items() for c, g in of.items() for x in (f"{k}:{c}", g))), key)
    # the symbol font's plain codes are letters; a dingbat font has no others, so what isn't known of it is a bullet
    known = F.when((kind != "symbol") | raised, meant)
    unknown = F.when(kind.isNull() & code.between(0xE000, 0xF8FF) | kind.isin("wingdings", "zapf") & (code >= 0xE000), "•")
    return F.coalesce(known, unknown)


def clean(text: Column) -> Column:
    """Recognised text with private-use characters as bullets."""
    return F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]", "•")
