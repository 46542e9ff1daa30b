"""Which font shows a character: coverage read from a font's own table, texts cut into runs of the main and the fallback font."""

from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

Ranges = list[tuple[int, int]]
#: Characters up to here are always set in the main font.
PLAIN = 0x7F
#: Platform and encoding of the tables of a font, the one with most characters first.
TABLES = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0))


def joined(ranges: Ranges) -> Ranges:
    """Sorted ranges without overlaps; neighbours go together."""
    out: Ranges = []
    for a, b in sorted(r for r in ranges if r[0] <= r[1]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(ranges: Ranges, taken: Ranges) -> Ranges:
    """The parts of ranges that lie in none of the others."""
    out, others = [], joined(taken)
    for a, b in joined(ranges):
        for c, d in others:
            if d < a or c > b:
                continue
            if c > a:
                out.append((a, c - 1))
            a = d + 1
        if a <= b:
            out.append((a, b))
    return out


def coverage(font: bytes) -> Ranges:
    """The code points that a TrueType or OpenType font has glyphs for, from its cmap table (segments or groups).

    A font that can't be read that way covers nothing.
    """
    try:
        tables = {font[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">II", font, 20 + 16 * k) for k in range(struct.unpack_from(">H", font, 4)[0])}
        start, _ = tables[b"cmap"]
        found = {}
        for k in range(struct.unpack_from(">H", font, start + 2)[0]):
            platform, encoding, at = struct.unpack_from(">HHI", font, start + 4 + 8 * k)
            found.setdefault((platform, encoding), start + at)
        at = next(found[t] for t in TABLES if t in found)
        kind = struct.unpack_from(">H", font, at)[0]
        if kind == 12:
            groups = struct.unpack_from(">I", font, at + 12)[0]
            return joined([(a, b) for a, b, glyph in (struct.unpack_from(">III", font, at + 16 + 12 * k) for k in range(groups)) if glyph or b > a])
        if kind != 4:
            return []
        n = struct.unpack_from(">H", font, at + 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", font, at + p) for p in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
        out = []
        for k, (a, b, delta, offset) in enumerate(zip(starts, ends, deltas, offsets)):
            for c in range(a, min(b, 0xFFFE) + 1):
                glyph = c + delta if not offset else struct.unpack_from(">H", font, at + 16 + 6 * n + 2 * k + offset + 2 * (c - a))[0]
                if glyph & 0xFFFF:
                    out.append((c, c))
        return joined(out)
    except (struct.error, KeyError, StopIteration):
        return []


def lacking(main: Ranges, fallback: Ranges) -> Ranges:
    """What only the fallback font has; everything is set in the main font where its coverage is unknown."""
    return without(fallback, [*main, (0, PLAIN)]) if main else []


def _class(ranges: Ranges) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def runs(text: Column, only: Ranges) -> Column:
    """array<struct<text, fallback>>: text cut where the font changes; white space never asks for the fallback.

    The ranges are one character class, so a text is passed over once and no character becomes a row.
    """
    if not only:
        return F.when(F.length(text) > 0, F.array(F.struct(text.alias("text"), F.lit(False).alias("fallback")))).otherwise(F.array().cast("array<struct<text:string,fallback:boolean>>"))
    special = rf"[{_class(only)}&&[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]]"
    parts = F.regexp_extract_all(text, F.lit(rf"{special}+|(?:(?!{special})[\s\S])+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), p.rlike(f"^{special}").alias("fallback")))
