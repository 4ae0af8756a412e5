"""What a worker remembers of the words it has met."""

from collections.abc import Callable, Iterable
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa

REMEMBERED = 120_000  # words of a generation; two are held
LONGEST = 64  # longer words are forgotten after use
NUMBERS_OF_A_WORD = 16  # on average, that are kept of the words in ``KnownRows``


class RecentWords:
    """Values of words, made once while they keep coming back.

    Words live in two generations. A full generation becomes the old one; a word
    that is met again moves to the new one, the others go with the old.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[Any]], size: int = REMEMBERED):
        self.make, self.size = make, size
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.long: list[str] = []

    def of(self, texts: list[list[str]]) -> list[list[Any]]:
        """The value of every word of every text."""
        for word in self.long:
            self.new.pop(word, None)
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        known = self.new
        values = [list(map(known.get, words)) for words in texts]
        gaps = [[at for at, value in enumerate(found) if value is None] for found in values]
        unknown = {words[at] for words, places in zip(texts, gaps, strict=True) for at in places}
        again = {word: self.old[word] for word in unknown if word in self.old}
        unknown = [word for word in unknown if word not in again]
        known.update(again)
        known.update(zip(unknown, self.make(unknown), strict=True))
        self.long = [word for word in unknown if len(word) > LONGEST]
        for words, found, places in zip(texts, values, gaps, strict=True):
            for at in places:
                found[at] = known[words[at]]
        return values

    def coded(self, texts: list[list[str]]) -> tuple[np.ndarray, list[Any]]:
        """Every word of every text in a row as a number, and the value of each number. A word is looked up once."""
        words = [word for text in texts for word in text]
        numbers = {word: number for number, word in enumerate(dict.fromkeys(words))}
        [values] = self.of([list(numbers)])
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), values


class KnownRows:
    """A row of numbers for every word, made once while the word keeps coming back. All rows stand in one array.

    ``make`` gives the rows of new words in a row, and their lengths. When there are too many words or numbers, those
    words stay that came back since this was last so, as far as they take half of the room.
    """

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], size: int = 2 * REMEMBERED, dtype: type = np.int32):
        self.make, self.size, self.dtype = make, size, dtype
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros(0, self.dtype)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back = np.zeros(0, bool)  # words that came back

    def _turn(self) -> None:
        stay = np.flatnonzero(self.back)
        if len(stay) > self.size // 2 or self.sizes[stay].sum() > NUMBERS_OF_A_WORD * self.size // 2:
            return self._forget()
        words = list(self.place)
        self.place = {words[at]: n for n, at in enumerate(stay.tolist())}
        self.values = in_rows(self.values, self.begins[stay], self.sizes[stay])
        self.sizes = self.sizes[stay]
        self.begins, self.back = np.cumsum(self.sizes) - self.sizes, np.zeros(len(stay), bool)

    def of(self, words: pa.Array) -> np.ndarray:
        """The place of each of the distinct ``words`` in ``begins`` and ``sizes``, true until the next call."""
        if len(self.place) > self.size or len(self.values) > NUMBERS_OF_A_WORD * self.size:
            self._turn()
        known = len(self.place)
        listed = words.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.place.get, listed, repeat(-1)), np.int64, len(listed))
        self.back[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            values, sizes = self.make(words.take(pa.array(new)))
            self.place.update(zip(map(listed.__getitem__, new.tolist()), range(known, known + len(new)), strict=True))
            self.begins = np.concatenate([self.begins, len(self.values) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.values = np.concatenate([self.values, values], dtype=self.dtype)
            self.back = np.concatenate([self.back, np.zeros(len(new), bool)])
            found[new] = known + np.arange(len(new))
        return found


def in_rows(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` from ``begins`` on, one after another."""
    places = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
    places += np.arange(len(places))
    return values[places]
