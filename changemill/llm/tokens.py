"""Ids of whole texts by a file of the tokenizers library, inside Arrow tasks.

The file's text (a few MB, whatever the data) is read on the driver and travels with the tasks.
Where the pre-tokenizer drops white space, the words between blanks and line feeds are encoded
independently of each other, so equal words are encoded once and their ids joined as bytes.
The file must be of that kind (its pre-tokenizer keeps letters and signs apart, too).

The file's added tokens (``<|endoftext|>``) are either text like any other or, as is the library's
default, cut out of the raw text first: each is one id, and what lies between is encoded alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Words whose ids a worker remembers; beyond it only those of the texts at hand stay. Speed only.
MEMO_WORDS = 600_000
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*(</w>)?$")


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class WordIds:
    """Encoder of one tokenizers file: texts to little-endian 32-bit ids.

    ``added``: the file's added tokens have ids of their own, as by the library's default; without
    it they are encoded as text.
    """

    def __init__(self, spec: str, added: bool = False):
        self.spec, self.added = spec, added
        self.key = f"{hashlib.sha256(spec.encode()).hexdigest()}-{added}"
        self.memo: dict[str, bytes] = {}
        self.model = None
        self.lowers = '"Lowercase"' in spec
        self.own = _added_tokens(spec) if added else {}
        longest_first = sorted(self.own, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if self.own else None

    @classmethod
    def load(cls, path: str, added: bool = False) -> WordIds:
        with open(path, encoding="utf-8") as file:
            return cls(file.read(), added)

    def __reduce__(self):
        return _again, (self.key, self.spec, self.added)

    def _model(self):
        if self.model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(self.spec)
            self.model.encode_special_tokens = True
            self.closes = self.flags(lambda token: token.endswith("</w>"))
        return self.model

    def _encode_each(self, words: list[str]) -> None:
        found = self._model().encode_batch_fast(words, add_special_tokens=False)
        self.memo.update(zip(words, [pack_ids(e.ids) for e in found], strict=True))

    def _encode_joined(self, words: list[str]) -> None:
        """Words of letters, many in one call: the last id of each, and no other, closes a word."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            found = self._model().encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(some):
                self._encode_each(some)
                continue
            raw = ids.tobytes()
            self.memo.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))

    def _learn(self, missing: list[str]) -> None:
        """Remember the words' ids. A comma or full stop after an ASCII letter is a pre-token of
        its own, so the word before it is looked up or encoded alone."""
        memo = self.memo
        ends = [w for w in missing if w[-1:] in (",", ".") and w[-2:-1].isascii() and w[-2:-1].isalpha()]
        plain = set(missing).difference(ends)
        plain.update(w[:-1] for w in ends if w[:-1] not in memo)
        plain.update(c for c in ",." if c not in memo)
        letters = [w for w in plain if w.isalpha()]
        self._encode_joined(letters)
        others = list(plain.difference(letters))
        for at in range(0, len(others), 4096):
            self._encode_each(others[at : at + 4096])
        memo.update((w, memo[w[:-1]] + memo[w[-1]]) for w in ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text; equal words of the texts are encoded once."""
        if self.cut is None:
            return self._encode_plain(texts)
        found = [[] if all(t not in text for t in self.own) else self.cut.findall(text) for text in texts]
        if not any(found):
            return self._encode_plain(texts)
        parts = [self.cut.split(text) if hits else [text] for text, hits in zip(texts, found, strict=True)]
        ids = iter(self._encode_plain([part for some in parts for part in some]))
        return [next(ids) + b"".join(self.own[token] + next(ids) for token in hits) for hits in found]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if self.lowers:  # bytes.lower() changes A-Z only
            texts = [text.encode().lower().decode() for text in texts]
        split = [text.replace("\n", " ").split(" ") for text in texts]
        memo = self.memo
        missing = list({word for words in split for word in words}.difference(memo))
        if len(memo) + len(missing) > MEMO_WORDS:
            # What these texts use stays known: frequent words are in most slices.
            used = {word for words in split for word in words}.difference(missing)
            kept = {word: memo[word] for word in used}
            memo.clear()
            memo.update(kept)
        self._learn(missing)
        find = memo.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def flags(self, test: Callable[[str], object]) -> np.ndarray:
        """For each id: does its text pass the test?"""
        vocabulary = json.loads(self.spec)["model"]["vocab"]
        highest = max([*vocabulary.values(), *(t["id"] for t in json.loads(self.spec)["added_tokens"])])
        flags = np.zeros(highest + 1, dtype=bool)
        flags[[i for token, i in vocabulary.items() if test(token)]] = True
        return flags

    def sentence_ends(self) -> np.ndarray:
        """Flag of each id: does its text end a sentence?"""
        return self.flags(_SENTENCE_END.search)


def _added_tokens(spec: str) -> dict[str, bytes]:
    """Packed id of each added token. Only tokens that match the raw text as it stands are known here."""
    found = json.loads(spec)["added_tokens"]
    for token in found:
        if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} does not match raw text as it stands")
    return {token["content"]: pack_ids([token["id"]]) for token in found}


_KNOWN: dict[str, WordIds] = {}


def _again(key: str, spec: str, added: bool) -> WordIds:
    """One encoder a worker and file, so that its memory lasts over tasks."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = WordIds(spec, added)
    return _KNOWN[key]
