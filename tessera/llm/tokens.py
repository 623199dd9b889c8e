"""Token ids by a vocabulary file of the ``tokenizers`` library, with the ids of each distinct word kept.

Both kinds of file that are used here cut a text at white space before they
look at anything else, so a text's ids are those of its words one after the
other. Encoding each distinct word once gives the same ids as encoding the
texts, at a fraction of the time. Words are looked up as strings, so two words
never pass for one another.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from array import array
from operator import attrgetter

import numpy as np

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Ends each document.
END_ID = 2
#: Words whose ids a Python worker keeps, and the longest word that is kept: together a bound on memory.
KEPT_WORDS, LONGEST_KEPT = 1_000_000, 48
#: Words that are looked up first.
HOT_WORDS = 30_000
#: Texts of so many characters are encoded together.
_TOGETHER = 1 << 21
#: White space to Python's str only; white space beside the space and the line feed, of the first 256 characters and all.
_PYTHON_ONLY = b"\x1c\x1d\x1e\x1f"
_OTHER = b"\t\x0b\x0c\r\x85\xa0" + _PYTHON_ONLY
_PYTHON_ONLY_OF_ALL = re.compile("[\x1c-\x1f]")
_OTHER_OF_ALL = re.compile("[^\\S \n]|[\x1c-\x1f]")
#: Signs that end words: no letter, no digit, no white space.
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x100)) if not c.isalnum() and not c.isspace() and c.isprintable())

_ID = attrgetter("id")
#: The characters that byte-level models write bytes as.
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _KEPT)}
_SPACE, _LINE = chr(_BYTES[0x20]), chr(_BYTES[0x0A])


def _mapped(words: str) -> str:
    """Words of letters, a line each, as byte-level models write them."""
    return words.replace("\n", _LINE) if words.isascii() else words.encode().decode("latin-1").translate(_BYTES)


def _latin(text: str) -> bytes | None:
    """``text`` if all its characters are below 256, where letters, lower case and white space are the same to all."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class Encoder:
    """``encode(texts)``: each text's ids as little-endian unsigned 32-bit integers, without special tokens.

    ``ids`` holds the ids of words: for a vocabulary that drops white space
    those of the word alone, otherwise those of the word with the one space
    before it; there a word behind a line feed goes by both together.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = str(self.tokenizer.pre_tokenizer)
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.spaced = pre.startswith("ByteLevel") and "use_regex=True" in pre and "add_prefix_space=False" in pre
        self.by_words = self.spaced or "use_regex=False" in pre and "Split" in pre
        # the strings of special tokens are cut out before anything else, so a text with one is encoded as it is
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.model.tokenize(_LINE)[0].id.to_bytes(4, "little")
        self.kept_words, self.ids, self.hot, self.tails = kept_words, {}, {}, {"": b""}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str], before: str) -> list[bytes]:
        """The ids of words of Latin letters, with ``before`` before each, which reach the model as one piece."""
        tokenize, flat, at = self.tokenizer.model.tokenize, array("I"), [0]
        for m in _mapped("\n".join(stems)).split(_LINE) if stems else []:
            flat.extend(map(_ID, tokenize(before + m)))
            at.append(len(flat))
        raw, at = np.array(flat).astype("<u4").tobytes(), [4 * x for x in at]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learned(self, words: list[str], space: bool) -> dict[str, bytes]:
        """The ids of new words, with a space before each or not.

        Signs behind the letters are a piece of their own, as both patterns cut
        there. Words of anything else go through the whole library.
        """
        stems = [w.rstrip(_SIGNS) for w in words]
        each = {s for s in set(stems) if s.isalpha()}
        letters = "".join(each)
        if _latin(letters) is None or self.lowers and letters != letters.lower():
            each = {s for s in each if _latin(s) is not None and not (self.lowers and s != s.lower())}
        of = {}
        if space or not self.spaced:  # a stem may be known as a word
            get = self.ids.get
            of = {s: ids for s, ids in zip(each, map(get, each)) if ids is not None}
            each = each.difference(of)
        ascii_ = [s for s in each if s.isascii()]
        for order in (ascii_, list(each.difference(ascii_))):
            of.update(zip(order, self._stems(order, _SPACE if space else "")))
        signs = [w[len(s) :] for w, s in zip(words, stems)]
        if new := [t for t in set(signs).difference(self.tails) if t]:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
                new = [t for t in set(signs) if t]
            self.tails.update(zip(new, self._direct(new)))
        tails, rest = self.tails, []
        out = {w: of[s] + tails[t] for w, s, t in zip(words, stems, signs) if s in of}
        if len(out) < len(words):
            rest = [w for w in words if w not in out]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            out.update(zip(part, self._direct([" " + w for w in part] if space else part)))
        return out

    def _words(self, text: str, latin: bytes | None) -> list[str] | None:
        """The words that ``text`` is looked up by; None where white space is not as simple as that."""
        if any(s in text for s in self.special):
            return None
        drop = _OTHER if self.spaced else _PYTHON_ONLY
        if latin is not None and len(latin.translate(None, drop)) < len(latin) or latin is None and (_OTHER_OF_ALL if self.spaced else _PYTHON_ONLY_OF_ALL).search(text):
            return None
        if not self.spaced:
            return (text if latin is None or not self.lowers else text.lower()).split()
        words = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        return None if "" in words or "\n" in words else words

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Python's search for cycles would look through all words time and again; here are none."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encoded([t or "" for t in texts])
        finally:
            if on:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._direct(texts)
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if (words := self._words(t, _latin(t))) is None:
                out[i] = self._direct([t])[0]
                continue
            held.append((i, words))
            size += len(t)
            if size >= _TOGETHER:
                self._together(held, out)
                held, size = [], 0
        if held:
            self._together(held, out)
        return out

    def _together(self, held: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Look words up among the hot ones, which fit in a core's cache, then among all, then learn what is left."""
        hot, get = self.hot.get, self.ids.get
        found, open_, new = [list(map(hot, words)) for _, words in held], [], set()
        for (_, words), ids in zip(held, found):
            at = [k for k, x in enumerate(ids) if x is None]
            rest = [words[k] for k in at]
            got = list(map(get, rest))
            if len(self.hot) < HOT_WORDS:
                self.hot.update((w, x) for w, x in zip(rest, got) if x is not None)  # seen before: common words come first
            left = []
            for k, w, x in zip(at, rest, got):
                if x is None:
                    left.append(k)
                    new.add(w)
                else:
                    ids[k] = x
            open_.append(left)
        learned: dict[str, bytes] = {}
        if new and self.spaced:
            learned = self._learned([w for w in new if w[0] != "\n"], True)
            learned |= {"\n" + w: self.line + ids for w, ids in self._learned([w[1:] for w in new if w[0] == "\n"], False).items()}
        elif new:
            learned = self._learned(list(new), False)
        for (i, words), ids, at in zip(held, found, open_):
            for k in at:
                ids[k] = learned[words[k]]
            whole = b"".join(ids)
            out[i] = whole[len(self.line) :] if self.spaced else whole  # a line feed was put before the first word
        if len(self.ids) + len(learned) > self.kept_words:
            self.ids.clear()  # what is common is hot, or soon known again
        if len(self.hot) > self.kept_words:
            self.hot.clear()
        if learned and max(map(len, learned)) > LONGEST_KEPT:
            learned = {w: x for w, x in learned.items() if len(w) <= LONGEST_KEPT}
        self.ids.update(learned)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, Encoder] = {}
common.KEPT.append(_ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One for each file in a Python worker, as loading takes a moment and the kept words help the next task."""
    common.used_by("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
