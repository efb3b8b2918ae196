"""Offset maps: where the characters of a normalised text come from, and token offsets. Arrow UDFs, for pages of hits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom import runtime
from textloom.functions import normalize

_JAVA_TO_PYTHON = {r"\p{IsAlphabetic}": r"[^\W\d_]"}


def _python(pattern: str) -> re.Pattern[str]:
    pattern = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    for java, own in _JAVA_TO_PYTHON.items():
        pattern = pattern.replace(java, own)
    return re.compile(pattern)


def _substitute(text: str, origin: list[int], pattern: re.Pattern[str], replacement: str) -> tuple[str, list[int]]:
    out, where, at = [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        where += origin[at : m.start()]
        if "$1" in replacement:
            kept, first = replacement.replace("$1", m[1]), m.start(1)
            sources = [origin[first + k % len(m[1])] for k in range(len(kept))]
        else:
            kept = replacement
            sources = [origin[m.start()]] * len(kept)
        out.append(kept)
        where += sources
        at = m.end()
    out.append(text[at:])
    return "".join(out), where + origin[at:]


def _nfc(text: str, origin: list[int]) -> tuple[str, list[int]]:
    out, where, at = [], [], 0
    for k in range(1, len(text) + 1):  # clusters: a starter and the marks after it
        if k == len(text) or unicodedata.combining(text[k]) == 0:
            done = unicodedata.normalize("NFC", text[at:k])
            out.append(done)
            where += [origin[min(at + j, k - 1)] for j in range(len(done))]
            at = k
    joined = "".join(out)
    whole = unicodedata.normalize("NFC", text)
    return (joined, where) if joined == whole else (whole, [origin[min(k, len(text) - 1)] for k in range(len(whole))])


def forward(rule_ids: tuple[str, ...], text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters, the index of its source character."""
    origin = list(range(len(text)))
    for one in rule_ids:
        if one == "N16":
            text, origin = _nfc(text, origin)
        elif one in normalize.MAPS:
            a, b = normalize.MAPS[one]
            table = {x: b[k] if k < len(b) else "" for k, x in enumerate(a)}
            kept = [(table.get(x, x), o) for x, o in zip(text, origin, strict=True)]
            text, origin = "".join(x for x, _ in kept), [o for x, o in kept if x]
        else:
            for pattern, replacement in normalize.PATTERNS.get(one) or normalize.JAVA_PATTERNS[one]:
                text, origin = _substitute(text, origin, _python(pattern), replacement)
    return text, origin


def span_map(rule_ids: tuple[str, ...], text: Column) -> Column:
    """struct<text string, forward array<int>> of a string column."""

    runtime.ship(SparkSession.active())

    @F.pandas_udf("text string, forward array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, None) if x is None else forward(rule_ids, x) for x in texts]
        return pd.DataFrame({"text": [x for x, _ in done], "forward": [y for _, y in done]})

    return run(text)


def to_canonical(mapped: Column, start: Column, end: Column) -> Column:
    """struct<start, end, exact>: the tight hull in the source of [start, end) in the derived text; clamped ranges are not exact."""
    places = mapped["forward"]
    low = F.greatest(F.least(start, F.size(places)), F.lit(0))
    high = F.greatest(F.least(end, F.size(places)), low)
    part = F.slice(places, low + 1, high - low)
    return F.when(high > low, F.struct(F.array_min(part).alias("start"), (F.array_max(part) + 1).alias("end"), ((low == start) & (high == end)).alias("exact")))


def to_derived(mapped: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: the hull in the derived text of what [start, end) of the source became; null where nothing is left of it."""
    inside = F.filter(F.transform(mapped["forward"], lambda x, i: F.when((x >= start) & (x < end), i)), lambda x: x.isNotNull())
    return F.when(F.size(inside) > 0, F.struct(F.array_min(inside).alias("start"), (F.array_max(inside) + 1).alias("end")))


def compose(first: Column, second: Column) -> Column:
    """struct<text, forward>: the map of the second step after the first, back to the first one's source."""
    places = F.transform(second["forward"], lambda i: F.get(first["forward"], i))
    return F.struct(second["text"].alias("text"), places.alias("forward"))


def identity(text: Column) -> Column:
    """struct<text, forward> of a text that stays as it is."""
    return F.struct(text.alias("text"), F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>")).alias("forward"))


def span_segments(mapped: Column) -> Column:
    """array<struct<derived_start, derived_end, canonical_start>>: maximal runs in which both sides go on by one."""
    kind = "array<struct<derived_start:int,derived_end:int,canonical_start:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        goes_on = (F.size(acc["out"]) > 0) & (x == last["canonical_start"] + acc["i"] - last["derived_start"])
        longer = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["derived_start"].alias("derived_start"), (acc["i"] + 1).alias("derived_end"), last["canonical_start"].alias("canonical_start"))))
        fresh = F.concat(acc["out"], F.array(F.struct(acc["i"].alias("derived_start"), (acc["i"] + 1).alias("derived_end"), x.alias("canonical_start"))))
        return F.struct((acc["i"] + 1).alias("i"), F.when(goes_on, longer).otherwise(fresh).cast(kind).alias("out"))

    return F.aggregate(mapped["forward"], F.struct(F.lit(0).alias("i"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def highlight(text: Column, ranges: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Markers around sorted, disjoint [start, end) character ranges; null where ranges are unsorted, overlap or leave the text."""
    step = F.aggregate(
        ranges,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("ok")),
        lambda acc, r: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(r["start"] - acc["at"], F.lit(0))), F.lit(opening), F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit(closing)).alias("out"),
            r["end"].alias("at"),
            (acc["ok"] & (r["start"] >= acc["at"]) & (r["end"] > r["start"]) & (r["end"] <= F.length(text))).alias("ok"),
        ),
        lambda acc: F.when(acc["ok"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))),
    )
    return step
