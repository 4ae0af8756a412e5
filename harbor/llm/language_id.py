"""Language by cross-parsing entropy.

For each language a bounded sample of labelled text is held in a suffix automaton,
which reads any text and knows how long it has been a substring of the sample. A
text is parsed into phrases, each the longest match from where it begins. The fewer
phrases it needs, the closer it is to the sample: ``phrases * log2(sample size) /
text size`` estimates the bits per symbol that the sample leaves open. The language
of the least estimate wins.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import text_slices, trimmed

UNKNOWN = "und"
SAMPLE_DOCS = 128  # about as many documents of each language are fetched, and at most four times as many
SAMPLE_PIECES, PIECE_CHARS = 20, 200  # of a longer text as many pieces, spread evenly from its begin to its end
SAMPLE_SYMBOLS = 10_000  # symbols of each language in its automaton, about as many from each of its documents
SYMBOLS = 64  # 0: anything but a letter; 1 to 62: the most frequent letters; 63: any other letter
SEGMENT = 512  # symbols parsed at a stretch; a phrase ends at the end of a segment
BATCH_BYTES = 250_000


def part_of(doc_id: Column) -> Column:
    """The fold of a document, 0 to 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@dataclass
class LanguageModel:
    """``steps[k]`` holds 4 * next state + phrases ended, for each state and symbol of language k."""

    languages: list[str]
    letters: dict[str, int]
    sizes: list[int]
    steps: list[np.ndarray]


def automaton_steps(sample: list[int]) -> np.ndarray:
    """The suffix automaton of ``sample`` as a table of steps, restarts built in."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sample:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at != -1:
            target = follow[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and follow[at].get(symbol) == target:
                    follow[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    steps = np.full((len(follow), SYMBOLS), -1, np.int32)
    for state, targets in enumerate(follow):
        for symbol, target in targets.items():
            steps[state, symbol] = 4 * target
    # No step from the start: the symbol alone is a phrase. None elsewhere: a phrase ends, another begins here.
    steps[0][steps[0] < 0] = 1
    restart = np.broadcast_to(steps[0] + 1, steps.shape)
    return np.where(steps < 0, restart, steps).astype(np.int32).ravel()


def _spread(text: Column) -> Column:
    """A text of up to SAMPLE_PIECES * PIECE_CHARS characters whole, pieces of a longer one."""
    room = F.length(text) - PIECE_CHARS
    pieces = [F.substring(text, F.floor(room * n / (SAMPLE_PIECES - 1)).cast("int") + 1, F.lit(PIECE_CHARS)) for n in range(SAMPLE_PIECES)]
    return F.when(F.length(text) <= SAMPLE_PIECES * PIECE_CHARS, text).otherwise(F.concat_ws(" ", *pieces))


def fit_languages(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of the labelled rows. Bounded: see the parameters above; everything else covers all rows.

    Rows without a label or a text teach nothing. The counts of labels and about
    ``SAMPLE_DOCS`` rows of each, those of least hash, come to the driver.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[0]: row[1] for row in rows.groupBy(lang).count().collect()}
    if not counts:
        return LanguageModel([], {}, [], [])
    shares = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 2 * SAMPLE_DOCS / n))))
    draw = F.xxhash64(F.col(doc_id), F.col(lang))
    uniform = F.pmod(draw, F.lit(1 << 20)) / float(1 << 20)
    fetched = rows.filter(uniform < shares[F.col(lang)])
    fetched = fetched.select(F.col(lang).alias("lang"), uniform.alias("draw"), _spread(F.col(text)).alias("text"))
    samples: dict[str, list[tuple[float, str]]] = {}
    for row in fetched.limit(4 * SAMPLE_DOCS * len(counts)).collect():
        samples.setdefault(row["lang"], []).append((row["draw"], row["text"]))
    languages = sorted(samples)
    texts = {name: " ".join(text for _, text in sorted(samples[name])).lower() for name in languages}
    letters = Counter()
    for joined in texts.values():
        letters.update({char: n / len(joined) for char, n in Counter(joined).items() if char.isalpha()})
    order = sorted(letters, key=lambda char: (-letters[char], char))[: SYMBOLS - 2]
    places = {char: place for place, char in enumerate(order, 1)}
    model = LanguageModel([], places, [], [])
    coder = TextCoder(places)
    for name in languages:
        codes, _ = coder.codes([texts[name]])
        if codes.any():
            sample = _thinned(codes).tolist()
            model.languages.append(name)
            model.sizes.append(len(sample))
            model.steps.append(automaton_steps(sample))
    return model


def _thinned(codes: np.ndarray) -> np.ndarray:
    """At most SAMPLE_SYMBOLS symbols, in stretches spread over all of ``codes``."""
    if len(codes) <= SAMPLE_SYMBOLS:
        return codes
    stretch = PIECE_CHARS
    number = SAMPLE_SYMBOLS // stretch
    begins = np.linspace(0, len(codes) - stretch, number).astype(np.int64)
    return codes[(begins[:, None] + np.arange(stretch)).ravel()]


@cache
def _letters() -> np.ndarray:
    """Which code points are letters by their Unicode class."""
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


class TextCoder:
    """Texts as symbols: letters of either case by their place, every run of other characters as one 0."""

    def __init__(self, letters: dict[str, int]):
        self.table = np.where(_letters(), SYMBOLS - 1, 0).astype(np.uint8)
        for char, place in letters.items():
            for form in {char, char.upper()}:
                if len(form) == 1:
                    self.table[ord(form)] = place

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of the texts one after another, and how many each text has."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = self.table[points]
        doc = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
        return codes[keep], np.bincount(doc[keep], minlength=len(texts))


def count_phrases(codes: np.ndarray, sizes: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text in each language. All segments of all texts are parsed side by side."""
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), parts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + place * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(sizes, parts) - place * SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length, text = begin[order], length[order], text[order]
    active = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
    out = np.zeros((len(steps), len(sizes)), np.int64)
    state = [np.zeros(len(begin), np.int64) for _ in steps]
    phrases = [np.zeros(len(begin), np.int64) for _ in steps]
    for at in range(SEGMENT):
        n = active[at]
        if not n:
            break
        symbols = codes[begin[:n] + at].astype(np.int64)
        for table, where, ended in zip(steps, state, phrases, strict=True):
            found = table[where[:n] * SYMBOLS + symbols]
            where[:n] = found >> 2
            ended[:n] += found & 3
    for language, (where, ended) in enumerate(zip(state, phrases, strict=True)):
        out[language] = np.bincount(text, ended + (where != 0), len(sizes))
    return out


def predict_languages(
    docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All columns of ``docs`` with ``label`` and ``score`` added, one row for each.

    ``und`` with score 0 for a null text, one without a letter, and where nothing was
    learned. The score is the share by which the best estimate is below the second
    best, 1 with one language; the first name wins a tie. Columns of the two names in
    ``docs`` are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(label, score)
    place = kept.columns.index(text)
    coders: list[TextCoder] = []

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        if not coders:
            coders.append(TextCoder(known.letters))
        sample_bits = np.log2(np.maximum(2, np.array(known.sizes, float)))[:, None]
        for batch in trimmed(batches):
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in text_slices(batch.column(place), BATCH_BYTES):
                codes, sizes = coders[0].codes([text or "" for text in batch.column(place).slice(a, b - a).to_pylist()])
                letters = np.bincount(np.repeat(np.arange(b - a), sizes), codes > 0, b - a)
                if not known.languages:
                    continue
                bits = count_phrases(codes, sizes, known.steps) * sample_bits / np.maximum(1, sizes)
                best = bits.argmin(axis=0)
                ordered = np.sort(bits, axis=0)
                second = ordered[1] if len(known.languages) > 1 else np.full(b - a, np.inf)
                certain = np.where(second > 0, 1 - ordered[0] / np.maximum(second, 1e-12), 0.0)
                for n in np.flatnonzero(letters):
                    names[a + n], scores[a + n] = known.languages[best[n]], certain[n]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, label, score])

    schema = kept.select("*", F.lit("").alias(label), F.lit(0.0).alias(score)).schema
    for field in schema.fields:
        field.nullable = True
    return kept.mapInArrow(predict, schema)
