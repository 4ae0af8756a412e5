"""Token counts of every prefix of a text, by dynamic programming.

One pass over a word (see ``pieces``) leaves the exact number of tokens of each of
its prefixes. Words are segmented alone, so the count of any prefix of a text is
the sum over its whole words plus an entry of the word that it ends in. Questions
about truncation and budgets are look-ups in these tables; nothing is encoded again.
"""

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import keeps, text_slices, trimmed, whole_text
from harbor.llm.pieces import BYTE_PAIR, MARK, PieceModel, piece_model
from harbor.llm.recent import KnownRows
from harbor.llm.side_by_side import SideBySide

BATCH_BYTES = 2_000_000  # text that is worked on at once


class PrefixCounts:
    """Tables of prefix counts of words, those that come back remembered."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.side_by_side = SideBySide(model) if model.kind == BYTE_PAIR else None
        self.words = KnownRows(self._tables)

    def _tables(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        listed = words.to_numpy(zero_copy_only=False).tolist()
        if self.side_by_side:
            return self.side_by_side.prefix_counts(listed)
        tables = [self.model.lattice(word)[1] for word in listed]
        return np.fromiter(chain.from_iterable(tables), np.int32, sum(map(len, tables))), np.array(list(map(len, tables)), np.int64)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of texts as they stand in the marked text, the texts in the order in which these are, and where the words of each end, from 0 on.

        Texts that ``PieceModel.words`` cuts at blanks and line feeds alone are cut by Arrow, and come first.
        """
        plain = np.zeros(len(texts), bool)
        if self.model.by_word and self.model.by_line and self.model.prefix:
            odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.starts_with(texts, " "))
            plain = ~np.asarray(pc.or_(odd, pc.equal(texts, "")))
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(plain)), " ", " " + MARK), "\n", " \n ")
        cut = pc.split_pattern(pc.binary_join_element_wise(MARK, marked, ""), " ")
        others = [self.model.words(text) for text in texts.filter(pa.array(~plain)).to_pylist()]
        rest = pa.array(list(map(self.model.marked, chain.from_iterable(others))), cut.type.value_type)
        counts = np.append(np.diff(np.asarray(cut.offsets)), list(map(len, others))).astype(np.int64)
        return pa.concat_arrays([cut.values, rest]), np.argsort(~plain, kind="stable"), np.append(0, np.cumsum(counts))

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, Callable[[int], list[list[int]]]]:
        """The number of tokens of each text, and what gives the tables of one of them:
        for each of its words the number of tokens of its prefixes of 0, 1, ... characters."""
        words, order, ends = self._split(texts)
        coded = words.dictionary_encode()
        places = self.words.of(coded.dictionary)
        values, begins, numbers = self.words.values, self.words.begins[places], np.asarray(coded.indices)
        stops = begins + self.words.sizes[places]
        sums = np.append(0, np.cumsum(values[stops - 1].astype(np.int64)[numbers]))
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))

        def tables(n: int) -> list[list[int]]:
            own = numbers[ends[where[n]] : ends[where[n] + 1]]
            return [values[begin:stop].tolist() for begin, stop in zip(begins[own].tolist(), stops[own].tolist(), strict=True)]

        return np.diff(sums[ends])[where], tables

    def tables(self, texts: list[str]) -> list[list[list[int]]]:
        """The tables of each text."""
        return list(map(self.totals(pa.array(texts, pa.string()))[1], range(len(texts))))

    def counts(self, tables: list[list[int]]) -> list[int]:
        """The number of tokens of every prefix of a text, of 0, 1, ... all its characters."""
        out, before = [], 0
        for table in tables:
            out.extend(before + n for n in table[1:])
            before += table[-1]
        return [0] + out[len(self.model.prefix) :]

    def cut(self, tables: list[list[int]], budget: int) -> int:
        """The length of the longest prefix of at most ``budget`` tokens, of a text that has more."""
        sums = list(accumulate(table[-1] for table in tables))
        whole = bisect_right(sums, budget)  # words that fit whole
        left = budget - (sums[whole - 1] if whole else 0)
        within = max(i for i, n in enumerate(tables[whole]) if n <= left)
        length = sum(len(table) - 1 for table in tables[:whole]) + within
        return max(0, length - len(self.model.prefix))


_counters: dict[str, PrefixCounts] = {}
keeps("counts", lambda: (_counters.clear(), piece_model.cache_clear()))


def prefix_counter(path: str) -> PrefixCounts:
    """One per worker process and model."""
    if path not in _counters:
        _counters[path] = PrefixCounts(piece_model(path))
    return _counters[path]


def count_tokens(
    docs: DataFrame, model: str, limit: int, doc_id: str = "doc_id", text: str = "text", prefixes: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the longest prefix of at most ``limit`` tokens.

    ``prefixes=True`` adds ``prefix_tokens``, the counts of all prefixes. A null text is
    empty and has no tokens; rows repeat as they come; no row moves.
    """
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fitting_chars", pa.int64())]
    kinds += [("prefix_tokens", pa.list_(pa.int32()))] * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in trimmed(batches, "counts"):
            totals, cuts, prefix_counts = [], [], []
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(a, b - a)
                sums, tables = counter.totals(texts)
                totals += sums.tolist()
                lengths = pc.utf8_length(texts).to_pylist()
                cuts += [size if total <= limit else counter.cut(tables(n), limit) for n, (size, total) in enumerate(zip(lengths, sums.tolist(), strict=True))]
                if prefixes:
                    prefix_counts += [counter.counts(tables(n)) for n in range(len(texts))]
            columns = [
                batch.column(0), batch.column(2), pa.array(totals, pa.int64()),
                pa.array([total > limit for total in totals], pa.bool_()), pa.array(cuts, pa.int64()),
            ]
            if prefixes:
                columns.append(pa.array(prefix_counts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    body = whole_text(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return rows.mapInArrow(count, schema + ", prefix_tokens array<int>" * prefixes)
