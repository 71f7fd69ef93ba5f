"""Whole texts to token ids with the tokenizers library, word by word from a bounded memo."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np

#: Letters of ASCII and Latin-1, then ASCII punctuation but the apostrophe: such a word is one
#: letter run and one punctuation run to the pre-tokenizer, and lower-casing maps letter by letter.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


_ID = attrgetter("id")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others move past 255."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(moved)}}


class WordEncoder:
    """Ids of a text, as the library's ``encode(text, add_special_tokens=False)`` gives them.

    No token of this kind of vocabulary crosses white space, so a text's ids are those of its
    words in turn.  Ids of words are kept in a memo of two halves of about ``cap`` words each.
    """

    def __init__(self, path: str, cap: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = _byte_chars()

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        plain = run if run.isascii() else "".join(map(self.chars.__getitem__, run.encode()))
        return array("I", map(_ID, self.model.tokenize(plain))).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.islower() and word.isalpha():
            return self._run(word)
        m = _SIMPLE.fullmatch(word)
        if m is None:
            return self._whole(word)
        letters, marks = m.groups()
        return self._known(letters.lower()) + (self._known(marks) if marks else b"")

    def _known(self, run: str) -> bytes:
        # a letter run is a word too; a run of marks can't be mistaken for one
        ids = self.words.get(run) or self.old.get(run)
        if ids is None:
            ids = self.words[run] = self._run(run)
        return ids

    def forget(self) -> None:
        """Empty the memo: a worker that goes on with other work doesn't keep it."""
        self.words, self.old = {}, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > self.cap:
            # the words in use move on from the older half as they come up again
            self.old, self.words = self.words, {}
        memo = self.words
        found = list(map(memo.get, words))
        if None in found:
            old = self.old
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = memo.get(w)
                    if ids is None:
                        ids = old.get(w)
                        if ids is None:
                            ids = self._word(w)
                        memo[w] = ids
                    found[i] = ids
        return np.frombuffer(b"".join(found), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each path and Python worker; a task empties its memo at its end."""
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
