"""Token ids of many texts at once: pieces are found with numpy and each different piece is encoded once by the tokenizer."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .vectext import hashes

LIMIT = 0x250  # texts with any code point from here on, or any in _ODD, go to the tokenizer whole
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def _class(c: int) -> int:
    x = chr(c)
    if x in "\t\n\r ":
        return _SPACE
    kind = unicodedata.category(x)
    if kind[0] in "CZ" or x == "İ":  # rare white space and controls; a letter that is two in lower case
        return _ODD
    return {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)


_CLASS = np.array([*map(_class, range(LIMIT)), _ODD], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if c != 0x130 else c for c in range(LIMIT)] + [0xFFFF], np.uint16)


def differ(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Which of the non-empty pieces a[from:to] are not b[from:to]."""
    out = a_to - a_from != b_to - b_from
    use = np.flatnonzero(~out)
    n = (a_to - a_from)[use]
    if not len(use):
        return np.flatnonzero(out)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum()))
    same = a[place + np.repeat(a_from[use] - first, n)] == b[place + np.repeat(b_from[use] - first, n)]
    out[use] = ~np.logical_and.reduceat(same, first)
    return np.flatnonzero(out)


class Encoder:
    """For tokenizers that lower-case, drop white space, and split into letters, single digits and other characters.

    encode() gives what the tokenizer gives for each whole text: pieces of such a split are encoded independently, so that
    the ids of a text are those of its pieces. Texts in which the split isn't certain (contractions, special tokens, code
    points beyond Latin) are encoded whole. Known pieces are found by hash and compared as text.
    """

    def __init__(self, definition: str, most_pieces: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.most = most_pieces
        self.forget()

    def forget(self) -> None:
        """The pieces known so far: sorted hashes, where the ids of each begin and end in a row of ids, and the same of its text."""
        self.text, self.text_begin, self.text_end = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known, self.begin, self.end, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16 if len(self.last) <= 1 << 16 else np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, names: np.ndarray, pieces: list[str], step: int = 500) -> None:
        """Encodes pieces, many in one text with spaces between, and adds them to the known ones; names: their hashes."""
        parts = [pieces[i : i + step] for i in range(0, len(pieces), step)]
        all_ids, sizes = [], []
        for part, ids in zip(parts, self.whole([" ".join(p) for p in parts]), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a vocabulary whose ids don't tell where pieces end
                each = self.whole(part)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            all_ids.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        ends = np.cumsum(np.concatenate(sizes)) + len(self.ids)
        at = np.searchsorted(self.known, names)
        self.begin = np.insert(self.begin, at, np.concatenate([[len(self.ids)], ends[:-1]]))
        self.end, self.known = np.insert(self.end, at, ends), np.insert(self.known, at, names)
        self.ids = np.concatenate([self.ids, *all_ids]).astype(self.ids.dtype)
        ends = np.cumsum([len(x) for x in pieces]) + len(self.text)
        self.text_begin = np.insert(self.text_begin, at, np.concatenate([[len(self.text)], ends[:-1]]))
        self.text_end = np.insert(self.text_end, at, ends)
        self.text = np.concatenate([self.text, np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        plain = np.array(["'" not in t and not any(s in t for s in self.special) for t in texts], bool)
        units = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        units = np.minimum(units, LIMIT)
        kind = _CLASS[units]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        odd = np.flatnonzero(kind == _ODD)
        plain[np.searchsorted(first, odd, "right") - 1] = False
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kind))
        of = np.searchsorted(first, starts, "right") - 1
        use = (kind[starts] != _SPACE) & plain[of]
        starts, ends, of = starts[use], ends[use], of[use]
        del kind, new, use
        lower = _LOWER[units]
        h = hashes(lower, starts, ends)
        different, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.forget()
        where = np.searchsorted(self.known, different)
        fresh = np.ones(len(different), bool)
        fresh[where < len(self.known)] = self.known[where[where < len(self.known)]] != different[where < len(self.known)]
        if fresh.any():
            text = lower.astype("<u2").tobytes().decode("utf-16-le")  # one unit each, so that places stay
            self.learn(different[fresh], [text[a:b] for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)])
            where = np.searchsorted(self.known, different)
        # hashes are no proof: a text with a piece that isn't the one known by its hash is encoded whole
        plain[of[differ(lower, starts, ends, self.text, self.text_begin[where][inverse], self.text_end[where][inverse])]] = False
        n = (self.end[where] - self.begin[where])[inverse]
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.begin[where][inverse] - (np.cumsum(n) - n), n)]
        counts = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, x in zip(rest.tolist(), self.whole([texts[i] for i in rest]), strict=True):
            parts[i], counts[i] = x, len(x)
        return np.concatenate(parts), counts
