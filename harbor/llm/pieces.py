"""Segmentation of text by a SentencePiece model, in one pass over each word.

An Aho-Corasick automaton over the pieces reads a word; its output links give all
pieces that end at a position. Each of them extends the best segmentation of the
prefix before it (Viterbi). What "best" means depends on the model:

* unigram: the greatest sum of piece scores, the longer last piece on a tie;
* byte pair: merging is local, so a segmentation is the one that merging makes
  exactly when no two neighbours in it would have merged otherwise. A piece may
  follow another only if merging their joined text gives just these two. Every
  prefix then has a single path, the library's own result for that prefix.

Either way the pass leaves the exact number of tokens of every prefix.
"""

import re
from functools import cache

import sentencepiece

MARK = "▁"  # stands for a blank inside pieces
UNIGRAM, BYTE_PAIR = 1, 2
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
REMEMBERED_PAIRS = 200_000
PAIR = 1 << 24  # above all ids
UNMARKED = "\ud800"  # no valid text holds it
LINE_FEED = f" {UNMARKED}\n {UNMARKED}"  # a line feed as a word between words


def _fields(data: bytes) -> dict[int, list]:
    """Fields of a serialised protocol buffer message by number."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


class PieceModel:
    """Pieces of a model file and segmentation by them.

    Models with a normalisation table, unused or user-defined pieces, or without byte
    fallback are refused: their texts would need rules that are not built here.
    """

    def __init__(self, proto: bytes):
        import ahocorasick

        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        message = _fields(proto)
        trainer, normalizer = _fields(message[2][0]), _fields(message[3][0])
        self.kind = trainer.get(3, [UNIGRAM])[0]
        if self.kind not in (UNIGRAM, BYTE_PAIR) or normalizer.get(2, [b""])[0] or normalizer.get(4, [1])[0]:
            raise ValueError("only unigram and byte-pair models that leave texts as they are")
        self.prefix = MARK if normalizer.get(3, [1])[0] else ""
        kinds = [_fields(piece).get(3, [1])[0] for piece in message[1]]  # 1 ordinary, 2 unknown, 3 control, 6 byte
        if set(kinds) - {1, 2, 3, 6} or kinds.count(6) != 256:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces")
        size = len(kinds)
        self.text = [library.id_to_piece(i) for i in range(size)]
        self.score = [library.get_score(i) for i in range(size)]
        self.length = [len(piece) for piece in self.text]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if kinds[i] == 6}
        self.piece_id = {self.text[i]: i for i in range(size) if kinds[i] == 1}
        self.decoded = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, k in zip(self.text, kinds, strict=True)]
        self.unknown_score = min(self.score[i] for i in self.piece_id.values()) - 10
        # Words can be segmented alone if no piece has a mark after another character.
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece in self.piece_id)
        self.by_line = not any("\n" in piece for piece in self.piece_id)
        self.automaton = ahocorasick.Automaton()
        self.longer = ahocorasick.Automaton()  # without single characters: merging leaves one alone only where no longer piece ends
        for piece, number in self.piece_id.items():
            self.automaton.add_word(piece, number)
            if len(piece) > 1:
                self.longer.add_word(piece, number)
        self.automaton.make_automaton()
        self.longer.make_automaton()
        self.apart: dict[int, bool] = {}

    # Characters outside the vocabulary are held as -1 - ord: below all ids, and none is 0.
    def _string(self, token: int) -> str:
        return self.text[token] if token >= 0 else chr(-1 - token)

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the best-scored neighbours first, the left ones on a tie."""
        parts = list(text)
        while True:
            scores = [
                (self.score[self.piece_id[a + b]], -at)
                for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                if a + b in self.piece_id
            ]
            if not scores:
                return parts
            at = -max(scores)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def left_apart(self, left: int, token: int) -> bool:
        """Whether merging leaves ``left`` and ``token`` as they are; 0 for ``left`` is the begin of a word."""
        parts = [self._string(left)] * (left != 0) + [self._string(token)]
        return self.merged("".join(parts)) == parts

    def _apart(self, left: int, token: int) -> bool:
        if len(self.apart) >= REMEMBERED_PAIRS:
            self.apart.clear()
        known = self.apart[left * PAIR + token] = self.left_apart(left, token)
        return known

    def lattice(self, word: str, every: bool = True) -> tuple[list[int], list[int]]:
        """For every prefix of ``word``, by its length: its last token and its number of tokens.

        Without ``every``, prefixes that the whole word does not build on may be left out.
        """
        return self._merge_lattice(word, every) if self.kind == BYTE_PAIR else self._score_lattice(word)

    def _merge_lattice(self, word: str, every: bool) -> tuple[list[int], list[int]]:
        size, known, length = len(word), self.apart.get, self.length
        last, count = [0] * (size + 1), [0] * (size + 1)
        for at, token in (self.automaton if every else self.longer).iter(word):  # by place, longer pieces first
            end = at + 1
            if last[end]:
                continue
            begin = end - length[token]
            left = last[begin]
            if begin and not left:
                self._fill(word, begin, last, count)
                left = last[begin]
            apart = known(left * PAIR + token)
            if apart is None:
                apart = self._apart(left, token)
            if apart:
                last[end] = token
                count[end] = count[begin] + 1
        if size and not last[size]:
            self._fill(word, size, last, count)
        return last, count

    def _fill(self, word: str, end: int, last: list[int], count: list[int]) -> None:
        """Prefixes up to ``end`` that no longer piece ends have a single character last, by its id or, outside the vocabulary, as its bytes.

        Every prefix has one path, so nothing needs to be tried.
        """
        place = end
        while place > 1 and not last[place - 1]:
            place -= 1
        for place in range(place, end + 1):
            char = word[place - 1]
            token = self.piece_id.get(char)
            if token is None:
                last[place], count[place] = -1 - ord(char), count[place - 1] + len(char.encode())
            else:
                last[place], count[place] = token, count[place - 1] + 1

    def _score_lattice(self, word: str) -> tuple[list[int], list[int]]:
        size, length, score = len(word), self.length, self.score
        last, count = [0] * (size + 1), [0] * (size + 1)
        best: list[float | None] = [0.0] + [None] * size
        settled = 0
        for at, token in self.automaton.iter(word):
            end = at + 1
            while settled < at:
                settled += 1
                self._settle(word, settled, last, count, best)
            begin = end - length[token]
            total = best[begin] + score[token]
            if best[end] is None or total > best[end]:
                last[end], count[end], best[end] = token, count[begin] + 1, total
        while settled < size:
            settled += 1
            self._settle(word, settled, last, count, best)
        return last, count

    def _settle(self, word: str, end: int, last: list[int], count: list[int], best: list) -> None:
        """Let a character outside the vocabulary end a prefix, as its bytes, where that is best or the only way."""
        char = word[end - 1]
        if best[end] is None or char not in self.piece_id:
            total = best[end - 1] + self.unknown_score
            if best[end] is None or total > best[end]:
                last[end], count[end], best[end] = -1 - ord(char), count[end - 1] + len(char.encode()), total

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word as it stands in the marked text."""
        last, _ = self.lattice(word, every=False)
        out: list[int] = []
        end = len(word)
        while end:
            token = last[end]
            if token < 0:
                out.extend(self.byte_id[byte] for byte in reversed(chr(-1 - token).encode()))
                end -= 1
            else:
                out.append(token)
                end -= self.length[token]
        out.reverse()
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text: cut before each mark that follows another character, the first mark left out.

        A word that has no mark in front begins with UNMARKED. Where no piece holds a line feed, nothing
        joins across one, and it is a word of its own.
        """
        if not text:
            return []
        if self.by_word and self.prefix and "  " not in text and MARK not in text and text[0] != " ":
            return (text.replace("\n", LINE_FEED) if self.by_line else text).split(" ")
        marked = self.prefix + text.replace(" ", MARK)
        parts = WORDS.findall(marked) if self.by_word else [marked]
        return [word[1:] if word[0] == MARK else UNMARKED + word for word in parts]

    @staticmethod
    def marked(word: str) -> str:
        """A word of ``words`` as it stands in the marked text."""
        return word[1:] if word[:1] == UNMARKED else MARK + word

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def piece_model(path: str) -> PieceModel:
    """One model per worker process."""
    with open(path, "rb") as file:
        return PieceModel(file.read())
