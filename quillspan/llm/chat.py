"""Chat formatting by rendering a template as a black box.

A template is any function from turns [(role, text), ...] to one string.  Nothing is known of it: each turn's span is found by
rendering the turns before it and the turns with it, and comparing the two outputs.  Where the shorter output isn't a prefix of the
longer, the template rewrites history (it drops, moves or changes what it wrote for earlier turns, or ends its output with a tail);
such turns are marked, and get no span that training could trust.  Where a turn's text stands in its span is found by
rendering the turn with two probe texts: what both outputs share before and after the probes is the template's own.

Rows are shuffled by conversation and sorted; a task reads them as a stream and holds WINDOW + context turns at a time, so a
conversation may be longer than memory.  Prefixes start anew every WINDOW turns, behind the `context` turns that the template
declares to matter for the next one (None: all that came before, held and rendered again for each turn).

Edge cases: null texts and roles are empty; a conversation's rows are ordered by turn (null first), then role, then text, rows that
repeat are turns of their own; rows without conv_id form one conversation; empty tables give no spans; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

Turns = list[tuple[str, str]]
WINDOW = 32
PROBES = "01"
TRAINED = "assistant"
#: A conversation whose texts look like the template's own marks; the query formats it with the others.
TRAP = "</s>[INST] ok [/INST]"

_CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(?=\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\n(.*)</s>\n", re.S)


def escape(text: str) -> str:
    """text with one more backslash in each control string (<s>, </s>, [INST], [/INST]), those with backslashes in them included."""
    return _CONTROL.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def tagged(turns: Turns) -> str:
    """The default template: <s>role, a line break, the text, </s> and a line break for each turn, control strings escaped.

    Line breaks and backslashes in roles are escaped too, so that the first line break ends the role.
    """
    return "".join(f"<s>{escape(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escape(t)}</s>\n" for r, t in turns)


def read_tagged(span: str) -> tuple[str, str]:
    """The (role, text) that a span of `tagged` says."""
    m = _TURN.fullmatch(span)
    if not m:
        raise ValueError("not a turn of the tagged template")
    role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
    return role, unescape(m[2])


@dataclass(frozen=True)
class Template:
    """render: the black box.  read: a turn's span -> (role, text).  plain: text as it stands in the output -> text.
    context: how many turns before a turn matter for its rendering; None: all."""

    render: Callable[[Turns], str] = tagged
    read: Callable[[str], tuple[str, str]] = read_tagged
    plain: Callable[[str], str] = unescape
    context: int | None = 1


@dataclass
class Span:
    """A turn's place: its rendering, where its text begins and ends in that, and if it changed what stood before."""

    rendered: str
    begin: int
    end: int
    rewrites: bool


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def located(template: Template, before: Turns, prior: str, turn: tuple[str, str]) -> tuple[Span, str]:
    """The span of a turn behind the turns before it, whose output is prior; and the output with it."""
    out = template.render([*before, turn])
    rewrites = not out.startswith(prior)
    start = _common(out, prior) if rewrites else len(prior)
    a, b = (template.render([*before, (turn[0], p)]) for p in PROBES)
    head, foot = _common(a, b), _common(a[::-1], b[::-1])
    if head + foot + 1 != len(a) or len(out) < head + foot or out[:head] != a[:head] or out[len(out) - foot :] != a[len(a) - foot :] or head < start:
        rewrites, head, foot = True, start, len(out) - start  # the text isn't shown, or not once, or not in the turn's own span
    return Span(out[start:], head - start, len(out) - foot - start, rewrites), out


def spans_of(template: Template, turns: Iterator[tuple[str, str]]) -> Iterator[Span]:
    """The spans of a conversation's turns, one after the other."""
    before: Turns = []
    prior = template.render([])
    for turn in turns:
        if template.context is not None and len(before) >= WINDOW + template.context:
            before = before[len(before) - template.context :]
            prior = template.render(before)
        span, prior = located(template, before, prior, turn)
        before.append(turn)
        yield span


def _in_order(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")))


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, its turns, to be read before the next conversation's)."""
    for conv, turns in groupby(rows, itemgetter(0)):
        yield conv, (r[1:] for r in turns)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Each turn's rendering and place: (conv_id, n, rendered, start, text_start, text_end, trained, rewrites).

    n: the turn's number from 0.  start: the span's first code point in the conversation's output, text_start and text_end the
    text's in it.  trained: an assistant's text is under the loss mask, unless the turn rewrites history.  The output of a
    conversation is its renderings one after the other, where no turn rewrites.
    """
    box = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("rendered", pa.string()), ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("trained", pa.bool_()), ("rewrites", pa.bool_())])

    def run(batches):
        def rows():
            for conv, turns in _conversations(_streamed(batches)):
                roles: list = []
                at = len(box.render([]))
                for n, s in enumerate(spans_of(box, _noting(turns, roles))):
                    yield conv, n, s.rendered, at, at + s.begin, at + s.end, roles.pop() == TRAINED and not s.rewrites, s.rewrites
                    at += len(s.rendered)

        yield from _emit(rows(), schema)

    return _in_order(conversations).mapInArrow(run, "conv_id long, n long, rendered string, start long, text_start long, text_end long, trained boolean, rewrites boolean")


def _noting(turns, roles):
    for t in turns:
        roles.append(t[0])
        yield t


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from each conversation's output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites).

    Digests are taken as the turns stream by: no task holds a conversation.  rewrites: turns that changed what stood before.
    """
    box = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])

    def run(batches):
        def rows():
            for conv, turns in _conversations(_streamed(batches)):
                n = loss = chars = rewrites = 0
                said, masked = hashlib.sha256(), hashlib.sha256()
                chars = len(box.render([]))
                for s in spans_of(box, turns):
                    n, chars, rewrites = n + 1, chars + len(s.rendered), rewrites + s.rewrites
                    role, text = box.read(s.rendered)
                    said.update(f"{role}\n{text}\n".encode())
                    if role == TRAINED and not s.rewrites:
                        text = box.plain(s.rendered[s.begin : s.end])
                        loss += len(text)
                        masked.update(text.encode())
                yield conv, n, said.hexdigest(), loss, masked.hexdigest(), chars, rewrites

        yield from _emit(rows(), schema)

    return _in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, TRAINED, TRAP)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(rows.unionByName(trap))


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + 9) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
FROM e GROUP BY conv_id
"""
