"""Coverage of fonts and runs of the fallback font."""

import random
import struct

from pyspark.sql import functions as F

from quillspan.functions import fonts as N


def font(*tables):
    """A font file that has a cmap with these (platform, encoding, table)."""
    head = struct.pack(">HH", 0, len(tables))
    at, body = 4 + 8 * len(tables), b""
    for platform, encoding, data in tables:
        head += struct.pack(">HHI", platform, encoding, at + len(body))
        body += data
    cmap = head + body
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def segments(*parts):
    """A table of segments (first, last, delta) whose glyphs are code + delta."""
    parts = [*parts, (0xFFFF, 0xFFFF, 1)]
    n = len(parts)
    return struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *(p[1] for p in parts)) + b"\0\0" + struct.pack(f">{n}H", *(p[0] for p in parts)) + struct.pack(f">{n}H", *(p[2] % 65536 for p in parts)) + struct.pack(f">{n}H", *[0] * n)


def groups(*parts):
    return struct.pack(">HHIII", 12, 0, 16 + 12 * len(parts), 0, len(parts)) + b"".join(struct.pack(">III", *p) for p in parts)


def test_coverage():
    assert N.coverage(font((3, 1, segments((0x20, 0x7E, -29), (0xE9, 0xEA, -0xE9))))) == [(0x20, 0x7E), (0xEA, 0xEA)]  # 0xE9 leads to glyph 0
    assert N.coverage(font((3, 1, segments((0x20, 0x21, 1))), (3, 10, groups((0x41, 0x42, 1), (0x1F600, 0x1F601, 9))))) == [(0x41, 0x42), (0x1F600, 0x1F601)]
    assert N.coverage(b"") == N.coverage(b"\0\1\0\0\0\1" + b"\0" * 30) == N.coverage(font()) == []


def test_ranges():
    g = random.Random(2)
    for _ in range(200):
        some = lambda: [(a, a + g.randint(-1, 9)) for a in (g.randint(0, 60) for _ in range(g.randint(0, 6)))]
        a, b = some(), some()
        of = lambda rs: {c for x, y in rs for c in range(x, y + 1)}
        assert of(N.joined(a)) == of(a) and of(N.without(a, b)) == of(a) - of(b)
        assert all(x[1] + 1 < y[0] for x, y in zip(N.joined(a), N.joined(a)[1:]))


def test_runs(spark):
    only = N.lacking([(0x20, 0x7E), (0xE9, 0xE9)], [(0x20, 0x17F), (0x2000, 0x2100), (0x1F600, 0x1F640)])
    assert N.lacking([], [(0, 9)]) == [] and (0xE9, 0xE9) not in only
    rows = ["", "plain é", "ñ", "a ñoñ ü b\U0001f600\U0001f601c\n€ 日", "\xa0ñ"]
    got = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(N.runs(F.col("t"), only).alias("p")).collect()]

    def walked(text):
        out = []
        for c in text:
            needs = ord(c) > 0x7F and not c.isspace() and any(a <= ord(c) <= b for a, b in only)
            if out and out[-1][1] == needs:
                out[-1][0] += c
            else:
                out.append([c, needs])
        return [(t, n) for t, n in out]

    assert [[tuple(x) for x in p] for p in got] == [walked(t) for t in rows]
    plain = spark.createDataFrame([("é",), ("",)], "t string").select(N.runs(F.col("t"), []).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in plain] == [[("é", False)], []]
