"""Benchmark items in documents, also with numbers, names and units exchanged.

Both sides are brought to templates: words lose outer punctuation and case; a number,
a name or a unit becomes a typed placeholder, its slot. Windows of template words are
hashed and joined. A window that matches lines the item up with the document; the
values in the slots of that alignment must then be consistent: one value of the item
must stand for one value of the document throughout, as in a question asked again
with other parameters, but not in two texts that only share a pattern.

A name is told by its capital, so a copy in other case has other templates. Literal
windows, of the words without case and without slots, are hashed and joined beside
the templates; a document holds an item that reaches the coverage by either kind.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbor.llm.common import ROW, numbered, text_slices, trimmed, whole_text, with_row
from harbor.llm.words import DIGIT, LETTER, UPPER, Words, mix, words_of
from harbor.sources.scratch import materialize

BATCH_BYTES = 250_000
WINDOW = 8  # template words; shorter items are matched whole
LEAST_WORDS = 4  # templates of fewer words are no evidence; such items are matched word for word
LEAST_COVERAGE = 0.3  # share of an item's windows that a document must hold
LEAST_CONSISTENT = 0.8  # share of slots that agree with the commonest value for their item value
SHIPPED_WINDOWS = 2_000_000  # up to so many distinct window hashes of a benchmark are sent to the tasks, 16 MB

NUMBER, NAME, UNIT, LITERAL = (np.uint64(value) for value in (0x4E554D42, 0x4E414D45, 0x554E4954, 0x4C495445))
# Units of measure and money.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ton tons pound pounds lb lbs ounce "
    "ounces oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years euro euros dollar dollars cent cents usd eur percent degrees celsius fahrenheit mph kmh volt volts watt "
    "watts kw mb gb byte bytes metro metros meter meters metre metres heure heures jour jours stunde stunden tag tage hora horas"
).split()

SCHEMA = "key long, place long, window long, slots array<struct<at:int,value:long>>, windows long, size int, literal boolean"


def _units() -> np.ndarray:
    return np.sort(words_of([" ".join(UNITS)]).hashes())


def templates(texts: list[str], units: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts without outer punctuation, their template hashes and their own hashes.

    A number holds a digit, a name begins with a capital but is not all capitals, a
    unit is in the list. Words without a letter or digit are left out.
    """
    words = words_of(texts)
    solid = (words.kinds & (LETTER | DIGIT)) != 0
    places = np.arange(len(solid))
    after = np.minimum.accumulate(np.where(solid, places, len(solid))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, places, -1))
    begin, end = after[words.begin], before[words.end - 1] + 1
    keep = begin < end
    begin, end, doc = begin[keep], end[keep], words.doc[keep]
    own = words.hashes(begin, end)
    digits = np.concatenate([[0], np.cumsum((words.kinds & DIGIT) != 0)])
    capital = (words.kinds & UPPER) != 0
    capitals = np.concatenate([[0], np.cumsum(capital)])
    name = capital[begin] & ((capitals[end] - capitals[begin] == 1) | (end - begin == 1))
    unit = units[np.minimum(np.searchsorted(units, own), len(units) - 1)] == own
    template = np.where(name, NAME, own)
    template = np.where(unit, UNIT, template)
    template = np.where(digits[end] > digits[begin], NUMBER, template)
    return Words(words.points, words.kinds, doc, begin, end), template, own


def _windows(doc: np.ndarray, template: np.ndarray, own: np.ndarray, size: int, docs: int, literal: bool):
    """Begin, place in its text and hash of the windows of ``size`` words of which at least half are no slots.

    ``literal`` windows, of the words' own hashes, have no slots; their hashes differ from those of templates.
    """
    count = max(0, len(doc) - size + 1)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    hashes = np.full(count, np.uint64(size) ^ (LITERAL if literal else np.uint64(0)))
    for at in range(size):
        hashes += template[at : at + count] * weights[at]
    plain = np.concatenate([[0], np.cumsum(template == own)])
    good = (doc[:count] == doc[size - 1 :]) & (2 * (plain[size : size + count] - plain[:count]) >= size) if count else np.zeros(0, bool)
    first = np.searchsorted(doc, np.arange(docs))
    begin = np.flatnonzero(good)
    return begin, begin - first[doc[begin]], mix(hashes[begin])


def _holder(known: np.ndarray | None):
    """A test whether hashes are in the sorted ``known``, by a table of their last bits first."""
    if known is None:
        return None
    marked = np.zeros(1 << 20, bool)
    marked[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def held(hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(marked[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(known) or not len(maybe):
            return maybe[:0]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[at] == hashes[maybe]]

    return held


def template_windows(rows: DataFrame, sizes: tuple[int, ...] | None, known: np.ndarray | None) -> DataFrame:
    """Windows of the templates of ``rows(key, text, ...)``: key, place, window hash, slots, kind, the other columns of the row.

    With ``sizes`` windows of these lengths are made, and of their hashes those in
    ``known`` are kept, all if it is None. Without ``sizes`` each text gets windows of
    WINDOW words, or one of all its words, with their number.
    """
    units = _units()
    shipped = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None
    slot = pa.struct([("at", pa.int32()), ("value", pa.int64())])
    names = ["key", "place", "window", "slots", "windows", "size", "literal", *rows.columns[2:]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _holder(shipped.value if shipped else None)
        for batch in trimmed(batches, "words"):
            keys, texts = np.asarray(batch.column(0)), batch.column(1)
            for a, b in text_slices(texts, BATCH_BYTES):
                words, template, own = templates(texts.slice(a, b - a).to_pylist(), units)
                counts = np.bincount(words.doc, minlength=b - a)
                for size in sizes or sorted({min(WINDOW, int(n)) for n in counts if n}):
                    for literal in (False, True) if size >= LEAST_WORDS else (True,):
                        kind = own if literal else template
                        begin, place, hashes = _windows(words.doc, kind, own, size, b - a, literal)
                        if sizes is None:
                            fit = np.minimum(WINDOW, counts)[words.doc[begin]] == size
                            begin, place, hashes = begin[fit], place[fit], hashes[fit]
                        number = np.bincount(words.doc[begin], minlength=b - a)
                        if held:
                            found = held(hashes)
                            begin, place, hashes = begin[found], place[found], hashes[found]
                        slots = [
                            [{"at": at, "value": value} for at, value in enumerate(own[n : n + size].view(np.int64).tolist()) if kind[n + at] != own[n + at]]
                            for n in begin.tolist()
                        ]
                        text = words.doc[begin]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(keys[a + text]), pa.array(place), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(slot)),
                            pa.array(number[text]), pa.array(np.full(len(begin), size, np.int32)), pa.array(np.full(len(begin), literal)),
                            *(column.take(pa.array(a + text)) for column in batch.columns[2:]),
                        ], names)

    others = rows.drop("key", "text").schema.fields
    return rows.mapInArrow(make, T.StructType([*T.StructType.fromDDL(SCHEMA).fields, *others]))


def find_benchmark_items(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", stored: bool = False,
) -> DataFrame:
    """Pairs of a document and an item that it holds: the row's number, doc_id, item_id, windows, coverage, slots, consistent.

    ``windows`` of the item's windows are in the best alignment of the document with the
    item, ``coverage`` as a share; ``consistent`` is the share of its ``slots`` whose
    values agree. Words inserted up to the length of the item do not end an alignment;
    what lies elsewhere in the document adds nothing to it and takes nothing from it. A null text is empty and
    holds nothing. Items of fewer than LEAST_WORDS words and windows with more slots
    than other words have no templates and are matched by their own words, values
    included. Empty tables give no rows; equal rows each give theirs.

    The benchmark's window hashes go to the tasks to sift the documents' windows if
    there are at most SHIPPED_WINDOWS; else all windows enter the same join.
    Row numbers are given in the one pass that writes the documents' windows; ``stored``
    no longer matters.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("key"), whole_text(item_text).alias("text"))
    items = materialize(template_windows(items, None, None).withColumnRenamed("key", "item_id"), "items")
    sizes = tuple(row[0] for row in items.select("size").distinct().collect())
    hashes = items.select("window").distinct()
    known = None
    if hashes.count() <= SHIPPED_WINDOWS:
        known = np.sort(np.array([row[0] for row in hashes.collect()], np.int64).view(np.uint64))
    rows = with_row(docs).select(F.col(ROW).alias("key"), whole_text(text).alias("text"), F.col(doc_id).alias("doc_id"))
    found = template_windows(rows, sizes or (WINDOW,), known)
    found = materialize(
        found.select(F.col("key").alias(ROW), "doc_id", F.col("place").alias("doc_place"), "window", F.col("slots").alias("doc_slots")),
        "found",
    )
    matches = found.join(items, "window").withColumn("shift", F.col("doc_place") - F.col("place"))
    matches = materialize(matches, "matches")
    # An alignment is one shift, or the shifts of one of two overlapping rows of spans, each two items long.
    span = F.greatest(F.lit(WINDOW), F.col("windows"))
    near = F.floor(F.col("shift") / span)
    ways = F.array(*(F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at")) for kind, at in ((0, F.col("shift")), (1, near), (1, near - 1))))
    held = matches.withColumn("way", F.explode(ways)).groupBy(ROW, "doc_id", "item_id", "literal", "way").agg(
        F.count_distinct("place").alias("held"), (F.count_distinct("place") / F.max("windows")).alias("coverage")
    )
    # Values of each slot of a shift once, however many windows cover it.
    pairs = F.arrays_zip(F.col("slots").alias("slots"), F.col("doc_slots.value").alias("doc_value"))
    values = matches.select(ROW, "item_id", "windows", "shift", "place", F.explode(pairs).alias("pair"))
    values = values.select(
        ROW, "item_id", "windows", "shift", (F.col("place") + F.col("pair.slots.at")).alias("at"),
        F.col("pair.slots.value").alias("value"), F.col("pair.doc_value").alias("doc_value"),
    ).distinct()
    shifts = (ROW, "item_id", "windows", "shift")
    agreeing = values.groupBy(*shifts, "value", "doc_value").agg(F.count("*").alias("n"))
    most = agreeing.groupBy(*shifts, "value").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    slots = most.groupBy(*shifts).agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
    slots = slots.withColumn("way", F.explode(ways)).groupBy(ROW, "item_id", "way").agg(
        F.sum("n").alias("slots"), (F.sum("most") / F.sum("n")).alias("consistent")
    )
    judged = held.filter(F.col("coverage") >= LEAST_COVERAGE).join(slots.withColumn("literal", F.lit(False)), [ROW, "item_id", "literal", "way"], "left")
    judged = judged.fillna({"slots": 0, "consistent": 1.0}).filter(F.col("consistent") >= LEAST_CONSISTENT)
    best = F.max(F.struct("coverage", "consistent", F.col("held").alias("windows"), "slots")).alias("best")
    return judged.groupBy(ROW, "doc_id", "item_id").agg(best).select(
        ROW, "doc_id", "item_id", "best.windows", "best.coverage", "best.slots", "best.consistent"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    rows = numbered(docs)
    found = materialize(find_benchmark_items(rows, benchmark, doc_id, text).select(ROW).distinct(), "contaminated")
    return rows.join(found, ROW, "left_anti").drop(ROW)
