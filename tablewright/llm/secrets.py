"""Secrets in text: fixed patterns, and random-looking strings by windowed entropy.

Everything is a column expression over one row, so a scan needs no exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds. Runs are taken from their first
# character on, which the look-behind says; it keeps short runs from being tried again.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Strings that look random and are no secrets.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|redacted|changeme",
    r"^sha(256|384|512)-",
    r"(?i)0123456789|abcdefghij|zyxwvutsrq",
)


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: all characters from ``only``, some from each of ``some``."""

    only: str
    some: tuple[str, ...]
    bits: float


CLASSES = (
    CharClass(r"^[0-9A-Fa-f]+$", (r"[0-9]", r"[A-Fa-f]"), 3.0001),
    CharClass(r"^[A-Za-z0-9+/=_-]+$", (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.8001),
)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: structs of start, end (code points) and match."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = "struct<start:int,end:int,match:string>"
    empty = F.array().cast(f"array<{one}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        here = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")).cast(one)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    pairs = F.zip_with(found, between, lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
    # The text after the last match has no match of its own.
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)


def _gain(window: int) -> Column:
    """c * log2(c) for counts up to the window."""
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])


def random_part(candidate: Column, bits: Column, window: int) -> Column:
    """Span (first, last; code points within the candidate) of the windows with ``bits`` or more; null if none.

    One pass with a count per character: a step adds the entering character, takes
    off the leaving one and adjusts the sum of c * log2(c) by those two counts only;
    entropy is log2(window) minus that sum over the window.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    gain = _gain(window)
    state = F.struct(
        F.lit(0).alias("i"),
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    # Entering and leaving characters are paired once: a lambda that named the array would build it at every step.
    behind = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.zip_with(codes, behind, lambda c, o: F.struct(c.alias("into"), o.alias("out")))
    steps = F.filter(steps, lambda x: x["into"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        i, into, out = acc["i"], x["into"], x["out"]
        had = F.get(acc["counts"], into)
        left = F.get(acc["counts"], out) + (into == out).cast("int")
        total = acc["total"] + F.get(gain, had + 1) - F.get(gain, had)
        total = total + F.when(out >= 0, F.get(gain, left - 1) - F.get(gain, left)).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda n, k: n + (k == into).cast("int") - (k == out).cast("int"))
        high = (i >= window - 1) & (math.log2(window) - total / window >= bits)
        return F.struct(
            (i + 1).alias("i"),
            counts.alias("counts"),
            total.alias("total"),
            F.when(acc["first"].isNull() & high, i - (window - 1)).otherwise(acc["first"]).alias("first"),
            F.when(high, i + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        steps, state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
    )


def _bits(candidate: Column) -> Column:
    """The threshold of the first class that a candidate belongs to; null if none."""
    out = F.lit(None).cast("double")
    for c in reversed(CLASSES):
        belongs = candidate.rlike(c.only)
        for part in c.some:
            belongs = belongs & candidate.rlike(part)
        out = F.when(belongs, F.lit(c.bits)).otherwise(out)
    return out


def _typed(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    into: str = "secrets",
    window: int = 20,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """All rows and columns of ``docs`` with a column ``into``: spans sorted by start and kind.

    A span is a struct of start, kind (a number in KINDS) and end, in code points,
    end exclusive. Assignments, access keys and long hexadecimal strings are always
    reported. Other strings of ``window`` characters or more are candidates; what
    their high-entropy windows cover is reported as "entropy", unless the string
    matches ``allow`` or touches a base span. The work per character does not depend on
    the length of a string or text. Null and empty texts have no spans;
    repeated rows are judged alike; an empty table stays empty. A column called
    ``into`` is replaced.
    """
    # Each expression is used more than once, so it gets a column of its own.
    p = "__tw_sec_"
    text = F.coalesce(docs[text_col], F.lit(""))
    candidate = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{window},}}"
    step = docs.select(
        "*",
        matches(text, ASSIGN).alias(p + "assign"),
        matches(text, ACCESS).alias(p + "access"),
        matches(text, HEX).alias(p + "hex"),
        matches(text, candidate).alias(p + "cand"),
    )
    long_enough = F.filter(
        step[p + "assign"], lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    base = F.concat(_typed(long_enough, 0), _typed(step[p + "access"], 1), _typed(step[p + "hex"], 2))
    step = step.select(*[step[c] for c in docs.columns], step[p + "cand"], base.alias(p + "base"))

    def judged(s: Column) -> Column:
        bits = _bits(s["match"])
        for pattern in allow:
            bits = F.when(s["match"].rlike(pattern), None).otherwise(bits)
        return F.struct(s["start"].alias("at"), s["end"].alias("to"), s["match"].alias("match"), bits.alias("bits"))

    likely = F.filter(F.transform(step[p + "cand"], judged), lambda c: c["bits"].isNotNull())
    free = F.filter(
        likely,
        lambda c: ~F.exists(step[p + "base"], lambda b: (b["start"] < c["to"]) & (b["end"] > c["at"])),
    )
    scored = F.transform(
        free, lambda c: F.struct(c["at"].alias("at"), random_part(c["match"], c["bits"], window).alias("part"))
    )
    random = F.transform(
        F.filter(scored, lambda c: c["part"]["first"].isNotNull()),
        lambda c: F.struct(
            (c["at"] + c["part"]["first"]).alias("start"), F.lit(3).alias("kind"), (c["at"] + c["part"]["last"]).alias("end")
        ),
    )
    spans = F.array_sort(F.concat(step[p + "base"], random))
    return step.select(*[step[c] for c in docs.columns if c != into], spans.alias(into))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
