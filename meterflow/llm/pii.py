"""Personal data: regular expressions propose spans, checksums confirm them, words near by adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import text_or_empty

#: Code points on either side in which context words count.
CONTEXT = 40
#: Kinds that are not certain by their form need this score.
THRESHOLD = 0.5
NEAR, APART = 0.3, 0.3
#: Shifts of a running sum by doubling: enough for any number of matches an array can hold.
SHIFTS = [1 << k for k in range(31)]


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``quick`` is a cheap test that holds wherever the pattern matches; ``valid`` confirms a match."""

    name: str
    pattern: str
    quick: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    words: str
    score: float
    certain: bool = True


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string ends in 0: every second digit from the right counts double."""

    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * F.when(pair["i"] % 2 == 1, 2).otherwise(1)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, first four characters last and letters as 10 to 35, leaves 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        value = F.when(char.between("0", "9"), char.cast("int")).otherwise(F.ascii(char) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


#: One part of an address: leading zeros, then at most 255.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The possessive quantifiers and the conditions in front change no match; they keep long runs of one class linear.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        "mail|e-mail|contact|kontakt|correo|courriel|write to",
        0.7,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "ip|host|server|address|adresse|client|from",
        0.6,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        lambda m: F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m)),
        "card|credit|visa|karte|carte|tarjeta|payment",
        0.8,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.rlike(r"\+[0-9]"),
        lambda m: F.length(digits_of(m)).between(8, 15),
        "phone|tel|call|mobile|fax|telefon|teléfono",
        0.6,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
        mod97,
        "iban|account|bank|konto|compte|cuenta",
        0.6,
        certain=False,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "ssn|social security|taxpayer",
        0.3,
        certain=False,
    ),
)
BASE = ("email", "ip", "card", "phone")


def running_sum(lengths: Column) -> Column:
    """Sums up to and with each element; each of the log n passes adds the element a power of two further left."""
    return F.aggregate(
        F.filter(F.array(*map(F.lit, SHIFTS)), lambda d: d < F.size(lengths)),
        lengths,
        lambda sums, d: F.transform(sums, lambda x, i: x + F.when(i >= d, F.get(sums, i - d)).otherwise(0)),
    )


def proposals(text: Column, pattern: str) -> Column:
    """All matches as ``struct<start, end, match>``, in code points from 0, end exclusive.

    The pieces between the matches come from splitting at them; positions are running sums of both lengths.
    """
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        pieces,
        lambda m, p: F.struct(m.alias("match"), (F.length(p) + F.coalesce(F.length(m), F.lit(0))).alias("step")),
    )

    def placed(found: Column) -> Column:
        sums = running_sum(F.transform(found, lambda x: x["step"]))
        spans = F.zip_with(
            found,
            sums,
            lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match")),
        )
        return F.filter(spans, lambda s: s["match"].isNotNull())

    return F.transform(F.array(pairs), placed)[0]


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind, as ``struct<kind, start, end, score>`` in order; none where the quick test fails.

    The score starts at the kind's own, rises by ``NEAR`` if one of its words is within ``CONTEXT`` code points, and falls
    by ``APART`` if a letter or digit touches the span. Spans of certain kinds stay whatever their score.
    """

    def scored(s: Column) -> Column:
        ahead = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        behind = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        near = F.lower(ahead).rlike(kind.words) | F.lower(behind).rlike(kind.words)
        touched = ahead.rlike("[A-Za-z0-9]$") | behind.rlike("^[A-Za-z0-9]")
        score = F.lit(kind.score) + F.when(near, NEAR).otherwise(0.0) - F.when(touched, APART).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    found = F.transform(F.filter(proposals(text, kind.pattern), lambda s: kind.valid(s["match"])), scored)
    if not kind.certain:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(kind.quick(text), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds an array column of spans for each kind, named ``<kind>_spans``; the table's other columns stay as they are.

    Whole texts are searched, null counts as empty. The base kinds hold exactly the leftmost non-overlapping matches of
    their patterns that pass their test; ``iban`` and ``ssn`` come on top. Spans of different kinds may overlap. Repeated
    rows are searched each on its own; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    return docs.withColumns({f"{kind.name}_spans": spans_of(text, kind) for kind in KINDS})


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with every span in ``text_col`` replaced by its kind in angle brackets; overlapping spans count as one."""
    names = [f"{kind.name}_spans" for kind in KINDS]
    found = find_personal_data(docs.drop(*names), text_col)
    text = F.col(text_col)
    spans = F.array_sort(F.transform(F.flatten(F.array(*names)), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        out = F.when(s["start"] >= state["at"], gap).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    masked = F.when(text.isNotNull(), F.aggregate(spans, start, add, finish))
    return found.withColumn(text_col, masked).drop(*names)
