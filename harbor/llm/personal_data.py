"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

All steps are DataFrame functions. A text is cut at the matches of a pattern; the
lengths of the pieces and of the matches, summed in order, give the places.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbor.llm.common import ROW, whole_text, with_row

NEARBY = 40  # code points before and after a span that are searched for context words
CONTEXT = 0.3  # added to the score by a context word
LEAST_SCORE = 0.5  # spans of kinds that are not certain need as much


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def digit_count(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


def small_parts(match: Column) -> Column:
    """Numbers between dots, each at most 255."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(match: Column) -> Column:
    """Digits whose sum, every second one from the right doubled, is a multiple of ten."""

    def share(digit: Column, place: Column) -> Column:
        value = digit.cast("int") * F.when(place % 2 == 1, 2).otherwise(1)
        return F.when(value > 9, value - 9).otherwise(value)

    shares = F.transform(F.split(F.reverse(digits(match)), ""), share)
    return F.aggregate(shares, F.lit(0), lambda total, value: total + value) % 10 == 0


def mod_97(match: Column) -> Column:
    """Account numbers: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(match, " ", "")
    characters = F.split(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4)), "")

    def step(remainder: Column, character: Column) -> Column:
        number = F.ascii(character)
        longer = F.when(number >= 65, remainder * 100 + number - 55).otherwise(remainder * 10 + number - 48)
        return longer % 97

    return F.aggregate(characters, F.lit(0), step) == 1


def account(head: Column, run: Column) -> Column:
    """The longest account number that begins with ``head`` and ends with a group of ``run``; null if none passes."""
    groups = F.split(run, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.concat(head, F.array_join(F.slice(groups, 1, n), " ")))
    good = F.filter(prefixes, lambda prefix: (F.length(F.regexp_replace(prefix, " ", "")) >= 12) & mod_97(prefix))
    return F.get(F.reverse(good), F.lit(0))


@dataclass(frozen=True)
class Kind:
    """``marks`` are characters that every match holds. ``base`` spans stay whatever their score.

    With ``ahead`` the pattern finds the head of a span only and captures what may follow;
    ``ahead`` makes the span of both. Heads inside a span are tried too, but spans of a kind
    do not overlap.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    prior: float
    context: str
    marks: str = ""
    base: bool = False
    ahead: Callable[[Column, Column], Column] | None = None


# The patterns of the first four kinds and their order. Repetitions that never
# need to give back are possessive, and a match may not begin inside a run that an earlier
# begin has already failed on; both leave the matches as they are and keep the time linear.
# An account number is followed by other words and gives back; it has 35 characters at most.
# The pattern of cards takes whole runs of 13 to 19 digits only; other runs would fail anyway.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda match: F.lit(True), 0.9, "mail|contact|kontakt|courriel|correo", "@", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_parts, 0.6, "ip|host|server|address|adresse", ".", base=True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", luhn, 0.7,
         "card|visa|master|credit|karte|carte|tarjeta", base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda match: digit_count(match, 9, 15), 0.6, "phone|call|tel|mobile|fax|anruf|appel", "+", base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))", F.isnotnull, 0.6,
         "iban|account|konto|compte|cuenta", ahead=account),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda match: ~match.rlike("^(?:000|666|9)"), 0.3, "ssn|social security|identity"),
)


def _proposals(body: Column, kind: Kind, order: int) -> list[Column]:
    """Matches of a pattern, what follows them if it counts, and the pieces of text between them; none without the marks of the kind."""
    may = body.contains(kind.marks) if kind.marks else F.lit(True)
    matches = F.when(may, F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0)))
    runs = [F.when(may, F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(1))).alias(f"runs_{order}")] if kind.ahead else []
    return [matches.alias(f"matches_{order}"), *runs, F.when(may, F.split(body, kind.pattern, -1)).alias(f"pieces_{order}")]


def _spans(kind: Kind, order: int) -> Column:
    """The matches of a kind in order, each with the length of the piece before it and its own."""
    pieces = F.col(f"pieces_{order}")

    def span(match: Column, place: Column) -> Column:
        whole = kind.ahead(match, F.get(f"runs_{order}", place)) if kind.ahead else match
        after = F.substring(pieces[place + 1], F.length(whole) - F.length(match) + 1, F.lit(NEARBY)) if kind.ahead else F.left(pieces[place + 1], F.lit(NEARBY))
        near = F.concat_ws(" ", F.right(pieces[place], F.lit(NEARBY)), after)
        context = F.when(F.lower(near).rlike(kind.context), CONTEXT).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.prior) + context)
        good = kind.confirm(whole) & (F.lit(kind.base) | (score >= LEAST_SCORE))
        return F.struct(
            F.lit(order).alias("kind"), place.alias("place"), F.length(pieces[place]).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"), F.when(good, whole).alias("match"), score.alias("score"),
        )

    return F.coalesce(F.transform(f"matches_{order}", span), F.array())


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``found``, its spans (kind, start, end, match, score) by kind in the order of ``KINDS``, then place.

    Places are code points, the end exclusive. A null text is empty; a text without
    spans has an empty list; equal rows give equal rows. Matches that fail their
    check are dropped without another try,
    but an account number may end at any of its groups. Only spans are shuffled, one
    small row each.
    """
    body = whole_text(text)
    proposed = [column for order, kind in enumerate(KINDS) for column in _proposals(body, kind, order)]
    cut = with_row(docs).select(ROW, F.col(doc_id).alias("doc_id"), *proposed)
    spans = F.concat(*(_spans(kind, order) for order, kind in enumerate(KINDS)))
    rows = cut.select(ROW, "doc_id", F.explode_outer(spans).alias("span")).select(ROW, "doc_id", "span.*")
    before = Window.partitionBy(ROW, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition(ROW).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).withColumn("end", F.col("start") + F.length("match"))
    free = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    placed = placed.withColumn("free", free)
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    span = F.struct(
        F.col("kind").alias("order"), "start", "end",
        names[F.col("kind")].alias("kind"), "match", "score",
    )
    found = F.sort_array(F.collect_list(F.when(F.col("match").isNotNull() & F.col("free"), span)))
    return placed.groupBy(ROW, "doc_id").agg(found.alias("found")).drop(ROW)


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    base = [kind.name for kind in KINDS if kind.base]
    counts = [number(name) for name in base]
    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
