"""Lines in painting order against a version that walks their characters."""

import random
import unicodedata

import pytest

from quillspan.functions import bidi as D
from pyspark.sql import functions as F

PAIRS = dict(zip("()[]{}<>«»‹›", ")(][}{><»«›‹"))


def side(c):
    if c in " \t":
        return "space"
    if D.is_rtl(c):
        return "rtl"
    return "ltr" if unicodedata.bidirectional(c) in ("L", "EN") else "none"


def walked(line, base):
    """Character by character: runs, directions of what has none, runs of one direction joined, each turned or not."""
    if not line.strip():
        return line
    runs = []
    for c in line:
        if runs and runs[-1][0] == side(c):
            runs[-1][1] += c
        else:
            runs.append([side(c), c])
    kinds = [k for k, _ in runs]
    joined = []
    for i, (kind, said) in enumerate(runs):
        if kind not in ("rtl", "ltr"):
            around = {kinds[i - 1] if i else None, kinds[i + 1] if i + 1 < len(kinds) else None}
            kind = around.pop() if len(around) == 1 and around <= {"rtl", "ltr"} else base
        if joined and joined[-1][0] == kind:
            joined[-1][1] += said
        else:
            joined.append([kind, said])
    out = ["".join(PAIRS.get(c, c) for c in reversed(s)) if k == "rtl" else s for k, s in joined]
    return "".join(reversed(out) if base == "rtl" else out)


@pytest.mark.parametrize("base", ["rtl", "ltr"])
def test_painting(spark, base):
    g = random.Random(5)
    letters = "ab Z9 ()[]«» .,-! \tابت ٣ שלום é²"
    rows = ["", " ", "abc", "ابت", "abc (ابت) def.", "المادة (5) من القانون", "a - - - ب", "(", "\t", "שלום, world [1]"] + ["".join(g.choice(letters) for _ in range(g.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string")
    got = {r.k: r.p for r in df.select("k", D.paint(F.col("s"), base).alias("p")).collect()}
    assert [got[k] for k in range(len(rows))] == [walked(r, base) for r in rows]


def test_lines_keep_their_ends(spark):
    rows = [("ab ابت\r\nتب cd\n\n  \nx",), (None,), ("﷐ابa",)]
    got = [r.p for r in spark.createDataFrame(rows, "s string").select(D.paint(F.col("s")).alias("p")).collect()]
    assert got == [walked("ab ابت", "rtl") + "\r\n" + walked("تب cd", "rtl") + "\n\n  \nx", None, walked("ابa", "rtl")]


def test_directions_by_script(spark):
    """The character classes agree with Unicode's bidi classes on the letters and digits of common scripts."""
    chars = [c for c in map(chr, [*range(0x21, 0x250), *range(0x370, 0x600), *range(0x5D0, 0x5F3), *range(0x620, 0x64B), *range(0x671, 0x6D4), *range(0x904, 0x93A), *range(0x3041, 0x3097), *range(0x4E00, 0x4F00)]) if unicodedata.name(c, "")]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", F.when(F.col("c").rlike(f"^[{D.RIGHT}]"), "rtl").when(F.col("c").rlike(f"^[{D.LEFT}]"), "ltr").otherwise("none").alias("side"))
    off = {r.c: (r.side, side(r.c)) for r in df.collect() if r.side != side(r.c)}
    assert all(unicodedata.category(c)[0] not in "LN" or unicodedata.bidirectional(c) in ("NSM", "ON") for c in off) and len(off) < 0.05 * len(chars), off
