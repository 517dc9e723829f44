"""The text rules and merges of a word-end byte-pair vocabulary (a tokenizers JSON file).

``Vocabulary`` is read on the driver and travels in the task closure; its size
is that of the file, whatever the corpus.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import regex

# Fixed values of the file's format: white space and the order of the word patterns.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(f"[{SPACE}]+")


def chunks(text: str) -> list[str]:
    """The runs between white space; no word crosses them, so a text is the words of its chunks."""
    if _SEPARATORS.search(text):  # str.split() takes these for white space, the format doesn't
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    name: str
    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    word_end: str = "</w>"
    alphabet: list[str] = field(default_factory=byte_alphabet)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return cls(
            name=path,
            ids=model["vocab"],
            ranks={m: i for i, m in enumerate(merges)},
            special={t["content"]: t["id"] for t in spec["added_tokens"]},
            word_end=model["end_of_word_suffix"],
        )

    def splitter(self):
        """A function from a text, or a chunk, to its words; a special string is one of its own."""
        words = regex.compile(WORD).findall
        marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

        def plain(text: str) -> list[str]:
            if not text.isascii():
                # Letters are lowered one by one, so a capital sigma never takes its final form.
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return words(text.lower())

        def split(text: str) -> list[str]:
            if not any(m in text for m in self.special):
                return plain(text)
            out, at = [], 0
            for m in marks.finditer(text):
                out += plain(text[at : m.start()])
                out.append(m.group())
                at = m.end()
            return out + plain(text[at:])

        return split

    def symbols(self, word: str) -> list[str]:
        """The start symbols: one per UTF-8 byte, the last with the word end."""
        out = [self.alphabet[b] for b in word.encode("utf-8")]
        out[-1] += self.word_end
        return out

    def merge(self, word: str) -> tuple[list[str], list[int], int]:
        """Start symbols as merged in place, the chain of followers, and the number of merges.

        A heap holds (rank, place) of adjacent pairs; the lowest rank, leftmost
        first, is popped and its two nodes of the linked list become one.  An
        entry whose pair has changed meanwhile no longer has its rank and is left out.
        """
        sym, ranks = self.symbols(word), self.ranks
        n = len(sym)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [
            (r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j < 0 or ranks.get((sym[i], sym[j])) != rank:
                continue
            sym[i] += sym[j]
            sym[j] = None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return sym, after, merges

    def count(self, word: str) -> int:
        """Tokens of a word: start symbols less merges, without any identifier."""
        if word in self.special:
            return 1
        return len(word.encode("utf-8")) - self.merge(word)[2]

    def encode(self, word: str) -> list[int]:
        """The ids of a word."""
        if word in self.special:
            return [self.special[word]]
        return [self.ids[s] for s in self.merge(word)[0] if s is not None]

    def piece_rows(self) -> list[tuple[int, str]]:
        """(id, piece) of every entry."""
        return [(i, p) for p, i in {**self.ids, **self.special}.items()]
