"""Personal data: patterns propose spans, checksums confirm them, nearby words score them.

DataFrame functions only. Positions follow from the texts between matches: a match
starts after all the gaps and matches before it, so each text is split once and added up
once, in blocks of matches. All patterns take each character a bounded number of
times: possessive repeats, and look-behinds where a pattern could start inside a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import text_of

# Characters before and after a match that are read for context.
CONTEXT = 40
# Matches of a text that are worked through together.
BLOCK = 512
# What stands between the items of a list: no word but a short one.
_LIST_GAP = r"^[^\p{L}]*+(?:\p{L}{1,3}+[^\p{L}]*+)?$"
# Scores: what a pattern alone, a checksum, and a word nearby are worth.
BASE_SCORE, CHECKED, NEARBY = 0.5, 0.3, 0.2


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of 10."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    doubled = F.transform(
        each,
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            (x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def _mod_97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    # Letters count as two digits from A = 10.
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda x: x != ""),
        F.lit(0),
        lambda rest, x: F.when(x.rlike("[0-9]"), (rest * 10 + F.ascii(x) - 48) % 97).otherwise(
            (rest * 100 + F.ascii(x) - 55) % 97
        ),
    )
    return rest == 1


def _small_parts(address: Column) -> Column:
    """Whether all four numbers are at most 255, leading zeros or not."""
    return F.forall(
        F.transform(F.split(address, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")),
        lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, x.cast("int")) <= 255),
    )


def _between(column: Column, low: int, high: int) -> Column:
    return (F.length(column) >= low) & (F.length(column) <= high)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``needs`` is a cheap test that every text with a match passes. ``valid`` decides on
    a match; with ``only_near`` one of the ``near`` words must also stand near it.
    """

    name: str
    pattern: str
    needs: str
    valid: object
    checked: bool
    near: str
    only_near: bool = False


_MAIL = "A-Za-z0-9._%+-"
_PLACE = "[A-Za-z0-9-]"
BASE = (
    Kind(
        "email",
        # Starts where a run starts, or goes on where the last match ended: a start
        # inside a run can only match what a start at its head matches too.
        rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@{_PLACE}++(?:\.{_PLACE}++)++",
        "@",
        lambda m: F.lit(True),
        False,
        "mail|contact|write|schreib|courri|correo",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        _small_parts,
        False,
        r"\bip\b|address|host|server|login|adresse|servidor",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "[0-9][ -]?[0-9]",
        lambda m: _between(_digits(m), 16, 19) & F.when(_between(_digits(m), 16, 19), _luhn(_digits(m))),
        True,
        "card|visa|credit|debit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda m: _between(_digits(m), 8, 15),
        False,
        r"phone|tel\b|call|mobile|fax|telefon|llame|appel",
    ),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        lambda m: _between(F.replace(m, F.lit(" ")), 15, 34) & _mod_97(F.replace(m, F.lit(" "))),
        True,
        "iban|account|bank|konto|compte|cuenta",
    ),
    # Shorter card numbers are common in other numbers, so a word must stand nearby.
    Kind(
        "short_card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
        "[0-9][ -]?[0-9]",
        lambda m: _luhn(_digits(m)),
        True,
        "card|visa|credit|debit|amex|karte|carte|tarjeta",
        only_near=True,
    ),
)


def _matches(kind: Kind, text: Column) -> Column:
    """All matches in order, valid or not; null where the text cannot have any."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.rlike(kind.needs), matches)


def _gaps(kind: Kind, text: Column, matches: Column) -> Column:
    """The texts before, between and after the matches; null where there are none."""
    return F.when(F.size(matches) > 0, F.split(text, kind.pattern, -1))


def _scanned(items: Column, start: Column, add) -> Column:
    """The array ``all`` of the struct that ``add`` makes of ``start`` with item after item.

    Appending to an array copies it, so each block of items has an array of its own, and
    blocks are appended whole: the work stays in proportion to the items.
    """

    def bound(value: Column, use) -> Column:
        # An array of one, so that the value is worked out once however often it is used.
        return F.transform(F.array(value), use)[0]

    def scan(every: Column) -> Column:
        def block(state: Column, number: Column) -> Column:
            own = F.aggregate(F.slice(every, number * BLOCK + 1, F.lit(BLOCK)), state["now"], add)
            empty = F.slice(state["now"]["all"], 1, 0)
            return bound(
                own,
                lambda done: F.struct(
                    done.withField("all", empty).alias("now"), F.array_append(state["blocks"], done["all"]).alias("blocks")
                ),
            )

        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        none = F.slice(F.array(start["all"]), 1, 0)
        return F.aggregate(blocks, F.struct(start.alias("now"), none.alias("blocks")), block, lambda s: F.flatten(s["blocks"]))

    return bound(items, scan)


def _near(kind: Kind, gaps: Column, matches: Column, before: bool) -> Column:
    """For each match whether a word of the kind is near, on the side where its gap of ``gaps`` is.

    Arrays run towards the matches: from the end of the text for what is after them.
    Other matches count as blanks, so that none is the word near the next. Items of a
    list share what stands at its end, however long it is.
    """
    start = F.struct(F.lit("").alias("around"), F.lit(False).alias("near"), F.array().cast("array<boolean>").alias("all"))

    def add(state: Column, pair: Column) -> Column:
        gap = pair["gap"]
        blank = F.repeat(F.lit(" "), F.least(F.length(pair["behind"]), F.lit(CONTEXT)))
        if before:
            around = F.right(F.concat(state["around"], blank, F.right(gap, F.lit(CONTEXT))), F.lit(CONTEXT))
        else:
            around = F.left(F.concat(F.left(gap, F.lit(CONTEXT)), blank, state["around"]), F.lit(CONTEXT))
        listed = state["near"] & (F.length(gap) <= CONTEXT) & F.left(gap, F.lit(CONTEXT)).rlike(_LIST_GAP)
        near = F.lower(around).rlike(kind.near) | listed
        return F.struct(around.alias("around"), near.alias("near"), F.array_append(state["all"], near).alias("all"))

    behind = F.slice(F.concat(F.array(F.lit("")), matches), 1, F.size(matches))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), behind.alias("behind"))
    return _scanned(pairs, start, add)


def _placed(kind: Kind, gaps: Column, matches: Column) -> Column:
    """The valid matches: array of start, end, score; null where nothing matches."""
    span = "struct<start:int,end:int,found:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("all"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(state["all"], one).alias("all"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("found"))
    spans = _scanned(pairs, start, add)
    before = _near(kind, gaps, matches, True)
    after = F.reverse(_near(kind, F.reverse(gaps), F.reverse(matches), False))
    placed = F.transform(
        F.arrays_zip(spans.alias("span"), before.alias("before"), after.alias("after")),
        lambda x: F.struct(
            x["span"]["start"].alias("start"),
            x["span"]["end"].alias("end"),
            x["span"]["found"].alias("found"),
            (x["before"] | x["after"]).alias("near"),
        ),
    )
    good = F.filter(
        F.transform(
            placed,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                (
                    F.lit(BASE_SCORE)
                    + F.lit(CHECKED if kind.checked else 0.0)
                    + F.when(s["near"], F.lit(NEARBY)).otherwise(F.lit(0.0))
                ).alias("score"),
                (kind.valid(s["found"]) & (s["near"] if kind.only_near else F.lit(True))).alias("valid"),
            ),
        ),
        lambda s: s["valid"],
    )
    return F.when(F.size(matches) > 0, good)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + MORE) -> DataFrame:
    """``doc_id`` and, for each kind, a column of its name with the spans found.

    A span has ``start`` and ``end`` (code points, end exclusive) and a ``score``: 0.5
    for a pattern, 0.3 more where a checksum confirms it, 0.2 more where a word of the
    kind stands among the 40 characters before or after it, or before or after a list
    that it is an item of. Matches that fail their check are
    dropped and not tried again. One row per row of ``docs``, repeated rows and null ids
    included; null and empty texts have no spans (null arrays). Other columns are
    ignored, whatever their names.
    """
    matched = docs.select("doc_id", text_of("text").alias("_text")).select(
        "doc_id", "_text", *[_matches(kind, F.col("_text")).alias(f"_{kind.name}") for kind in kinds]
    )
    found = [F.col(f"_{kind.name}") for kind in kinds]
    gaps = [_gaps(kind, F.col("_text"), x).alias(f"_gaps_{kind.name}") for kind, x in zip(kinds, found, strict=True)]
    return matched.select("doc_id", *found, *gaps).select(
        "doc_id", *[_placed(kind, F.col(f"_gaps_{kind.name}"), F.col(f"_{kind.name}")).alias(kind.name) for kind in kinds]
    )


def digested(found: DataFrame, base: tuple[Kind, ...] = BASE, more: tuple[Kind, ...] = MORE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""

    nothing = F.array().cast("array<string>")

    def named(kind: Kind) -> Column:
        return F.coalesce(
            F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"])), nothing
        )

    def scored(kind: Kind) -> Column:
        return F.coalesce(F.transform(kind.name, lambda s: F.format_number(s["score"], 1)), nothing)

    def joined(kinds: tuple[Kind, ...], text) -> Column:
        return F.array_join(F.concat(*[text(kind) for kind in kinds]), ",")

    return found.select(
        "doc_id",
        *[F.coalesce(F.size(kind.name), F.lit(0)).cast("long").alias(f"n_{kind.name}") for kind in base],
        F.sha2(joined(base, named), 256).alias("base_sha256"),
        joined(base + more, named).alias("spans"),
        joined(base + more, scored).alias("scores"),
    )
