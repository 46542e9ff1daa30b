"""Direction and reordering: painting order as expressions on runs; exact Unicode counts and recognised lines as Arrow functions."""

from __future__ import annotations

import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, functions as F

from . import arrow
from .text import RTL, SPACE

# Fixed values.
ARABIC = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
HEBREW = (0x0590, 0x05FF)
MIRROR = dict(zip("()[]{}<>«»‹›", ")(][}{><»«›‹"))
#: Direction by script, as character classes: right-to-left blocks, and letters, digits and spacing marks of all others.
RIGHT, LEFT = RTL + r"\x{07C0}-\x{07FF}\x{200F}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}", r"\p{L}\p{Nd}\p{Nl}\p{Mc}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
#: Characters that no text has: signs before runs.
SIGNS = "\ufdd0\ufdd1"
RECOGNISER_NEUTRAL = " ،؛؟"
SENTENCE_ENDS, CLAUSE_ENDS, OPENERS = ".!؟", ":;،", ".!؟:،;"
VISUAL_SHARE = 0.20


def is_arabic(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in ARABIC)


def is_rtl(c: str) -> bool:
    return is_arabic(c) or HEBREW[0] <= ord(c) <= HEBREW[1] or unicodedata.bidirectional(c) in ("R", "AL")


def counts(text: str) -> tuple[int, int, int, int]:
    n = [0, 0, 0, 0]
    for c in text or "":
        n[0 if is_rtl(c) else 1 if unicodedata.bidirectional(c) == "L" else 2 if c.isdigit() else 3] += 1
    return tuple(n)


@arrow("struct<rtl:int,ltr:int,digit:int,other:int>")
def exact_counts(text: pd.Series) -> pd.DataFrame:
    """Script counts by exact bidi class; the expression in `text` differs on letters without a strong class."""
    return pd.DataFrame([counts(t) for t in text], columns=["rtl", "ltr", "digit", "other"])


def _runs(items, key) -> list[list]:
    return [[k, list(g)] for k, g in groupby(items, key)]


def _resolved(line: Column, base: str) -> Column:
    """array<struct<text, rtl>>: a line's runs of one kind, those without a direction settled.

    What has none takes that of both its neighbours where these agree, else the base; a run beside another run without direction
    takes the base.
    """
    runs = F.regexp_extract_all(line, F.lit(rf"[{RIGHT}]+|(?:(?![{RIGHT}])[{LEFT}])+|[ \t]+|(?:(?![{RIGHT}{LEFT} \t])[\s\S])+"), F.lit(0))
    kind = lambda r: F.when(r.rlike(rf"^[{RIGHT}]"), "rtl").when(r.rlike(rf"^[{LEFT}]"), "ltr")
    marked = F.transform(runs, lambda r: F.struct(r.alias("text"), kind(r).alias("kind")))

    def settle(all_: Column) -> Column:
        def of(r: Column, k: Column) -> Column:
            before, after = F.get(all_, k - 1)["kind"], F.get(all_, k + 1)["kind"]
            return F.struct(r["text"].alias("text"), (F.coalesce(r["kind"], F.when(before == after, before), F.lit(base)) == "rtl").alias("rtl"))

        return F.transform(all_, of)

    # settled as the one element of an array: an expression would run again at each look-up
    return F.get(F.transform(F.array(marked), settle), F.lit(0))


def _painted(line: Column, base: str) -> Column:
    # runs of one direction go together: a sign stands before each, and those between equal ones fall away
    signed = F.array_join(F.transform(_resolved(F.translate(line, SIGNS, ""), base), lambda r: F.concat(F.when(r["rtl"], SIGNS[0]).otherwise(SIGNS[1]), r["text"])), "")
    parts = F.regexp_extract_all(signed, F.lit(f"{SIGNS[0]}[^{SIGNS[1]}]*|{SIGNS[1]}[^{SIGNS[0]}]*"), F.lit(0))
    faced = F.transform(parts, lambda p: F.when(p.startswith(SIGNS[0]), F.reverse(F.translate(p, "".join(MIRROR) + SIGNS, "".join(MIRROR.values())))).otherwise(F.translate(p, SIGNS, "")))
    return F.array_join(F.reverse(faced) if base == "rtl" else faced, "")


def paint(text: Column, base: str = "rtl") -> Column:
    """Lines of mixed script in the order in which a painter that goes from left to right needs their characters, unshaped.

    Runs of right-to-left letters are turned, their brackets mirrored; with a base of right to left the runs go from the right too.  Line
    ends stay where they are, and so do lines of white space.  A character's direction is that of its script's letters, digits and
    spacing marks; all other characters have none.
    """
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))

    def line(x: Column) -> Column:
        end = F.regexp_extract(x, r"\r?\n\z", 0)
        body = F.substr(x, F.lit(1), F.length(x) - F.length(end))
        return F.when(body.rlike(rf"^{SPACE}*\z"), x).otherwise(F.concat(_painted(body, base), end))

    return F.when(text == "", text).otherwise(F.array_join(F.transform(lines, line), ""))


def recognised(text: str) -> str:
    """A recogniser's line, read from left to right, in reading order: the line turned, foreign runs kept."""
    arabic = lambda c: c in RECOGNISER_NEUTRAL or "؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿"
    return "".join("".join(reversed(cs) if kind else cs) for kind, cs in reversed(_runs(text or "", arabic))).strip()


def looks_reversed(word: str) -> bool:
    a = "".join(filter(is_arabic, word))
    return len(a) >= 3 and (a.endswith("لا") or a.startswith("ة"))


def _moved(token: str, marks: str) -> str:
    while len(token) > 1 and token[0] in marks:
        token = token[1:] + token[0]
    return token


def logical_line(line: str) -> str:
    """An Arabic line that was stored as painted, in reading order; any other line as it is."""
    words = line.split()
    if not words or not any(map(is_arabic, line)):
        return line
    turned = words[0][0] in OPENERS or any(w[0] == ":" and len(w) > 1 for w in words)
    backwards = sum(looks_reversed(unicodedata.normalize("NFKD", w)) for w in words) / len(words) >= VISUAL_SHARE
    if not turned and not backwards:
        return line
    units = [(kind, ws) for kind, ws in _runs(words, lambda w: any(map(is_arabic, w.strip(".!؟:،,()[]"))))]
    flat = [(kind, w) for kind, ws in units for w in (ws if kind else [" ".join(ws)])]
    out = []
    for kind, w in reversed(flat) if turned else flat:
        if kind and backwards:
            tail = w[-1] if len(w) > 1 and w[-1] in ".!؟:،," else ""
            w = unicodedata.normalize("NFKD", w[: len(w) - len(tail)][::-1]) + tail
        out += w.split()
    text = " ".join(_moved(w, CLAUSE_ENDS + (SENTENCE_ENDS if turned else "")) for w in out)
    for p in SENTENCE_ENDS:
        text = text.replace(f" {p}", p)
        if text.startswith(p):
            text = text[1:].strip() + p
    return text


def logical(text: str) -> str:
    return "\n".join(logical_line(x) for x in (text or "").split("\n"))


def _text_udf(f):
    @arrow("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


reading_order, logical_order = _text_udf(recognised), _text_udf(logical)
nfc = _text_udf(lambda t: unicodedata.normalize("NFC", t))
ligatures = _text_udf(lambda t: "".join(unicodedata.normalize("NFKC" if "ﬀ" <= c <= "ﬆ" else "NFC", c) for c in t))
