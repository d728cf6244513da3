"""Secrets in texts, with DataFrame functions only.

Base kinds are found by pattern. The method adds high-entropy strings: candidates are
maximal runs of a character class (hex, base64); a window of ``window`` characters slides
over each, and its Shannon entropy follows from counts that change by one character in and
one out. A candidate is reported from the first to the last window whose entropy reaches
the threshold of its class. Candidates that an allow-list pattern matches, that lack the
variety of a key (hex: a digit and a letter; base64: digit, lower and upper case), or that
lie within a base span are suppressed. Base spans always stay.

Everything is an expression over the row: no shuffle, no Python, any number of matches in
a text. Offsets count code points from 0, the end is exclusive.

Defined cases: a null text is empty and has no spans; every input row gives one row, rows
with equal or null doc_id too; an empty table gives an empty result; other columns, also
those named like a result, are left behind (redact() keeps all columns).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

HEX_DIGITS = "0123456789abcdef"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    run: str
    letters: str
    bits: float
    variety: list[str] = field(default_factory=list)
    fold: bool = False


def classes(window: int) -> list[EntropyClass]:
    """The classes; runs shorter than the window are no candidates."""
    inside = "A-Za-z0-9+/_=-"
    return [
        EntropyClass(
            "entropy_hex",
            rf"(?<![{inside}])[0-9A-Fa-f]{{{window},}}+(?![{inside}])",
            HEX_DIGITS,
            2.9,
            ["[0-9]", "[A-Fa-f]"],
            True,
        ),
        EntropyClass(
            "entropy_base64",
            rf"(?<![{inside}])[{inside}]{{{window},}}+",
            BASE64,
            3.7,
            ["[0-9]", "[a-z]", "[A-Z]"],
        ),
    ]


ALLOW = [r"(?i)example|sample|dummy|placeholder|x{6}|\*{6}", r"(?i)0123456789|abcdefgh", r"(.)\1{7}"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once.

    Inside a lambda Spark computes an expression again for every element, so whatever a
    lambda refers to is bound here first, as the only element of an array.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _running(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array, in blocks, so that long arrays take no quadratic copying."""
    none = F.array().cast("array<int>")

    def plain(part: Column) -> Column:
        return F.aggregate(
            part, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
        )

    def joined(blocks: Column) -> Column:
        heads = plain(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda x, i: shifted(x, h, i))))

    def shifted(part: Column, heads: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(heads, i - 1))
        return let(before, lambda n: F.transform(part, lambda v: v + n))

    last = F.floor((F.size(lengths) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: plain(F.slice(lengths, b * block + 1, F.lit(block))))
    return F.when(F.size(lengths) > 0, let(blocks, joined)).otherwise(none)


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Non-overlapping matches: array of (start, rank, end, kind, found).

    What lies between the matches and the matches themselves fill the text, so running
    lengths give the places.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
    )

    def placed(p: Column) -> Column:
        lengths = F.zip_with(p["whole"], p["gaps"], lambda m, gap: F.length(m) + gap)
        # the gap after the last match has no match: its length is unknown here
        return F.zip_with(
            F.arrays_zip(p["whole"], p["found"]),
            let(F.filter(lengths, lambda n: n.isNotNull()), lambda n: _running(n)),
            lambda m, end: F.struct(
                (end - F.length(m["whole"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                end.alias("end"),
                F.lit(kind).alias("kind"),
                m["found"].alias("found"),
            ),
        )

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(SPANS))


SPAN = "struct<start:int,rank:int,end:int,kind:string,found:string>"
SPANS = f"array<{SPAN}>"


def dense_part(found: Column, one: EntropyClass, window: int) -> Column:
    """(first, last): last characters, counted from 1, of the first and last dense window.

    The state of the fold is the count of each letter in the window and the sum of
    n * log2(n) over the counts, which one letter in and one out change by four terms of a
    table; the entropy is log2(window) - sum / window.
    """
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    chars = F.split(F.lower(found) if one.fold else found, "")
    numbers = F.transform(chars, lambda c: F.position(c, F.lit(one.letters)))
    start = F.struct(
        F.array_repeat(F.lit(0), len(one.letters)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(codes: Column, state: Column, i: Column) -> Column:
        full = i > window
        came = F.get(codes, i - 1)
        left = F.when(full, F.get(codes, i - 1 - window)).otherwise(0)
        n_came = F.get(state["counts"], came - 1)
        n_left = F.get(state["counts"], left - 1) + (came == left).cast("int")
        total = state["sum"] + F.get(terms, n_came + 1) - F.get(terms, n_came)
        total = total + F.when(full, F.get(terms, n_left - 1) - F.get(terms, n_left)).otherwise(0.0)
        dense = (i >= window) & (F.lit(math.log2(window)) - total / window >= one.bits - 1e-9)
        return F.struct(
            F.transform(
                state["counts"],
                lambda n, j: n + (j + 1 == came).cast("int") - (full & (j + 1 == left)).cast("int"),
            ).alias("counts"),
            total.alias("sum"),
            F.coalesce(state["first"], F.when(dense, i)).alias("first"),
            F.when(dense, i).otherwise(state["last"]).alias("last"),
        )

    places = F.sequence(F.lit(1), F.length(found))
    ends = lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
    return let(numbers, lambda codes: F.aggregate(places, start, lambda s, i: step(codes, s, i), ends))


def entropy_spans(text: Column, one: EntropyClass, window: int, allow: list[str]) -> Column:
    """Dense parts of the candidates of one class, as an array of spans."""

    def wanted(span: Column) -> Column:
        found = span["found"]
        ok = F.lit(True)
        for pattern in one.variety:
            ok = ok & found.rlike(pattern)
        for pattern in allow:
            ok = ok & ~found.rlike(pattern)
        return ok

    def narrowed(span: Column, part: Column) -> Column:
        start = (span["start"] + part["first"] - window).cast("int")
        end = (span["start"] + part["last"]).cast("int")
        length = part["last"] - part["first"] + window
        inside = F.substr(span["found"], part["first"] - window + 1, length)
        return F.struct(
            start.alias("start"), span["rank"].alias("rank"), end.alias("end"), span["kind"].alias("kind"), inside.alias("found")
        )

    candidates = F.filter(matches(text, one.run, one.kind), wanted)
    parts = F.transform(candidates, lambda s: let(dense_part(s["found"], one, window), lambda p: narrowed(s, p)))
    return F.filter(parts, lambda s: s["start"].isNotNull())


def _filled(text: Column, pattern: str) -> Column:
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(found), F.lit(0)))),
    )
    return F.array_join(parts, "")


def _blanked(pattern: str):
    return lambda t: F.when(t.rlike(pattern), _filled(t, pattern)).otherwise(t)


def blanked(text: Column, patterns: list[str]) -> Column:
    """The text with every match of the patterns as so many spaces; places stay the same."""
    for pattern in patterns:
        text = let(text, _blanked(pattern))
    return text


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds in order of start, then kind."""
    assigned = F.filter(
        matches(text, ASSIGN, "assign", 2), lambda s: F.length(s["found"]) >= ASSIGN_LEAST
    )
    return F.array_sort(F.concat(assigned, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def all_spans(base: Column, text: Column, window: int = 20, allow: list[str] = ALLOW) -> Column:
    """Base spans and the high-entropy ones outside of them."""
    added = F.concat(*[entropy_spans(text, c, window, allow) for c in classes(window)])
    added = F.filter(
        added, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    )
    return F.array_sort(F.concat(base, added))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, allow: list[str] = ALLOW
) -> DataFrame:
    """doc_id, base spans and all spans of every row, found strings included."""
    given = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    body = F.col("text")
    found = let(
        base_spans(body),
        lambda base: F.struct(base.alias("base"), all_spans(base, body, window, allow).alias("spans")),
    )
    return given.select("doc_id", found.alias("f")).select("doc_id", "f.base", "f.spans")


def redact(
    docs: DataFrame, text: str = "text", mask: str = "[SECRET]", window: int = 20, allow: list[str] = ALLOW
) -> DataFrame:
    """The frame with every span of its text replaced by ``mask``; null texts stay null.

    Overlapping spans are masked once, as their union. The allow-list takes out its own
    matches only: what is dense beside one in the same run is masked, other than scan(), which
    lets the whole run go.
    """
    column = F.col(text).cast("string")
    bound = F.struct(base_spans(column).alias("base"), blanked(column, allow).alias("rest"))
    spans = let(bound, lambda b: all_spans(b["base"], b["rest"], window, []))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(column, state["at"] + 1, span["start"] - state["at"])
        apart = F.concat(state["done"], gap, F.lit(mask))
        return F.struct(
            F.when(span["start"] >= state["at"], apart).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    masked = F.aggregate(
        spans, start, step, lambda s: F.concat(s["done"], F.substr(column, s["at"] + 1, F.length(column)))
    )
    # without a span the result is the text itself
    return docs.withColumn(text, F.when(column.isNotNull(), masked))
