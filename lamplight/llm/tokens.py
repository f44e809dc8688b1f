"""Token ids of whole texts with a given tokenizer file, each distinct stretch between spaces encoded once.

The tokenizer drops white space and no token crosses it, so a text's ids are those of its stretches in order. A process
keeps the ids of about ``KEPT`` stretches from batch to batch, those met last; others are forgotten and encoded anew.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from lamplight.functions.memory import kept
from lamplight.llm.hashing import Hashes

KEPT = 250_000
#: A word of small Latin letters (a to z, ß to ö, ø to ÿ as UTF-8) and the marks after it: the tokenizer cuts it between letters
#: and marks and nowhere else. Marks that may begin something longer (apostrophes, special tokens) are left out.
_MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+[" + re.escape(_MARKS) + rb"]*")
_TOGETHER = 64
#: Characters of texts that are worked on together.
TOGETHER = 1 << 21
#: Of these, bytes that are hashed, stretches that are compared and texts that are encoded at a time: what is made of them on the way
#: is many times as much.
HASHED, COMPARED, ENCODED = 1 << 18, 1 << 15, 64


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        # The same model for words that are lower-cased and cut apart already.
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.encode_words = bare.encode_batch_fast
        # A word's last token, and no other, carries the mark of a word's end.
        ending = bare.get_vocab()
        self.ends = np.zeros(max(ending.values()) + 1, bool)
        self.ends[[i for token, i in ending.items() if token.endswith("</w>")]] = True
        # Two generations: what is met moves to the younger, which becomes the elder when it is full.
        self.known: dict[bytes, bytes] = {b"": b""}
        self.elder: dict[bytes, bytes] = {}

    def _learn_words(self, words: list[bytes]) -> None:
        joined = [b" ".join(words[i : i + _TOGETHER]).decode() for i in range(0, len(words), _TOGETHER)]
        ids = np.fromiter(chain.from_iterable(_coded(self.encode_words, joined)), "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):
            raise RuntimeError("a word's tokens don't end with one end mark")
        data, start = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist()):
            self.known[word] = data[start:stop]
            start = stop

    def _recall(self, stretches: list[bytes]) -> list[bytes]:
        """Moves what is known of these to the younger generation; returns the others."""
        known, elder = self.known, self.elder
        absent = [stretch for stretch in stretches if stretch not in known]
        if not elder:
            return absent
        known.update({stretch: elder[stretch] for stretch in absent if stretch in elder})
        return [stretch for stretch in absent if stretch not in elder]

    def _meet(self, fresh: list[bytes]) -> None:
        known, simple = self.known, _SIMPLE.fullmatch
        odd, words, marked = [], [], []
        for stretch in fresh:
            if not simple(stretch):
                odd.append(stretch)
            elif len(letters := stretch.rstrip(_MARKS)) < len(stretch):
                marked.append((stretch, letters, stretch[len(letters) :]))
            else:
                words.append(stretch)
        # Words without marks are new, since the stretches are; those before marks and the marks may be known.
        parts = {part for _, *both in marked for part in both}.difference(words)
        self._learn_words(words + self._recall(list(parts)))
        for stretch, letters, marks in marked:
            known[stretch] = known[letters] + known[marks]
        texts = [stretch.decode("utf-8", "surrogatepass") for stretch in odd]
        for stretch, ids in zip(odd, _coded(self.encode, texts)):
            known[stretch] = array("I", ids).tobytes()

    @staticmethod
    def _plain(text: str) -> str:
        """Lower-cased where each character's lower case and normal form are its own and no special token can arise."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids, unsigned 32-bit, about ``TOGETHER`` characters of texts at a time."""
        out, at, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER:
                out += self._ids(texts[at : i + 1])
                at, size = i + 1, 0
        return out + self._ids(texts[at:])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The texts are put in a row, a space after each; equal stretches are found by their hashes and compared byte by
        byte, and the ids of the different ones are dealt out to where they stand.
        """
        coded = [self._plain(text).encode("utf-8", "surrogatepass") for text in texts]
        whole = b" ".join([*coded, b""]).replace(b"\n", b" ")
        if not whole:
            return []
        data = np.frombuffer(whole, np.uint8)
        stops = np.flatnonzero(data == 32)
        starts = np.r_[0, stops[:-1] + 1]
        _, at, place = np.unique(_hashes(data, starts, stops), return_index=True, return_inverse=True)
        stretches = [whole[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())]
        others = _unlike(data, starts, stops, at[place])
        if len(others):  # equal hashes, other bytes: these get entries of their own
            own: dict[bytes, int] = {}
            for i in others.tolist():
                stretch = whole[starts[i] : stops[i]]
                place[i] = own.setdefault(stretch, len(stretches))
                if own[stretch] == len(stretches):
                    stretches.append(stretch)
        fresh = self._recall(stretches)
        if fresh:
            self._meet(fresh)
        parts = list(map(self.known.__getitem__, stretches))
        if len(self.known) > KEPT // 2:
            self.known, self.elder = {b"": b""}, self.known
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        begin = np.cumsum(size) - size
        own = size[place]
        after = np.cumsum(own)
        ids = flat[np.repeat(begin[place] - after + own, own) + np.arange(after[-1])]
        # A text's last stretch ends where its own space stands.
        ends = np.cumsum([len(c) + 1 for c in coded]) - 1
        last = after[np.searchsorted(stops, ends)]
        return np.split(ids, last[:-1])


def _coded(encode: Callable, texts: list[str]) -> Iterator[list[int]]:
    """The ids of each text, ``ENCODED`` texts at a time."""
    for at in range(0, len(texts), ENCODED):
        for coded in encode(texts[at : at + ENCODED], add_special_tokens=False):
            yield coded.ids


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hashes of the stretches, about ``HASHED`` bytes at a time: a hash does not tell where its stretch lies."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, base + HASHED, "right")))
        out[at:to] = Hashes(data[base : stops[to - 1]]).of(starts[at:to] - base, stops[at:to] - base)
        at = to
    return out


def _unlike(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The stretches whose bytes are not those of the stretch they are said to be like."""
    size = stops - starts
    same = size == size[like]
    asked = np.flatnonzero(same & (like != np.arange(len(like))))
    # Whole words are compared at once, the last one reaching back over the one before it.
    wide = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1)) if len(data) >= 8 else None
    bad = [np.flatnonzero(~same)]
    for long in (False, True):
        those = asked[(size[asked] >= 8) == long]
        step = 8 if long else 1
        for at in range(0, len(those), COMPARED):
            part = those[at : at + COMPARED]
            count = -(-size[part] // step)
            row = np.repeat(part, count)
            inner = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
            if long:
                inner = np.minimum(inner, size[row] - 8)
            a, b = starts[row] + inner, starts[like[row]] + inner
            if len(a):
                differ = (wide[a] != wide[b]).any(1) if long else data[a] != data[b]
                bad.append(np.unique(row[differ]))
    return np.concatenate(bad)


#: The work that encoders are kept for.
WORK = "tokens"


def encoder(path: str) -> Encoder:
    """One encoder a process and file, kept until the process turns to other work."""
    encoders = kept(WORK)
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]
