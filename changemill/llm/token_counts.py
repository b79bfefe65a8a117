"""Token counts of every prefix of a text, by prefix dynamic programming over byte-pair merges.

The last token of each prefix of a pre-token is found from shorter prefixes: it is the one vocabulary
entry that ends the prefix and keeps apart from the last token of what lies before it (encoded together, the
two stay two). One more than the count before it is the count of the prefix. A pre-token of n bytes
takes n steps of at most the longest entry's length each, whatever the number of prefixes.

Counts are kept as steps, the difference of each code point's prefix to the one before: one byte a
code point, joined from the steps of a text's words. The store answers how many tokens any prefix
has and which prefix keeps a budget, without encoding again. Prefixes count as the library encodes
them by themselves, so a word cut in two is closed at the cut.

The file must be of the tokenizers library, byte-level, with word ends, white space dropped. Its text
is read on the driver and travels with the tasks (a few MB, whatever the data).
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.llm.common import slices, whole

#: Words whose steps, prefixes of pre-tokens whose last tokens, and pairs of tokens whose verdicts a
#: worker remembers; beyond it the memory starts anew. Prefixes up to so many bytes. Speed only.
MEMO_WORDS = 400_000
MEMO_PREFIXES = 600_000
MEMO_PAIRS = 1_000_000
LONGEST_PREFIX = 24
STORE = "struct<total:bigint,width:int,steps:binary>"
#: Words whose letter case and pre-tokens are a matter of single code points: printable ASCII and Latin letters.
_LATIN = regex.compile(r"[!-~À-ÖØ-öø-įı-ɏ]+").fullmatch
_NEVER = 1 << 60
_COUNT = (1 << 32) - 1
#: Runs without the white space of Unicode's property, which is the library's.
_DARK = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@cache
def _joining() -> frozenset[str]:
    """Code points that canonical composition may join to one before them."""
    found = {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)}
    for code in range(0x300, 0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def sections(text: str) -> list[str]:
    """Parts of a text that are composed by themselves."""
    joins, starts = _joining(), [0]
    starts += [i for i in range(1, len(text)) if text[i] not in joins and not unicodedata.combining(text[i])]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


class PrefixCounts:
    """Steps of the token counts of prefixes for one tokenizers file."""

    def __init__(self, spec: str):
        self.spec, self.key = spec, hashlib.sha256(spec.encode()).hexdigest()
        self.memo: dict[str, bytes | list[int]] = {}
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}
        self.model = None

    @classmethod
    def load(cls, path: str) -> PrefixCounts:
        if not path.endswith(".json"):
            raise ValueError(f"not a file of the tokenizers library: {path}")
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def __reduce__(self):
        return _again, (self.key, self.spec)

    # ---- The vocabulary, once a worker ----

    def _prepare(self) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(self.spec)
        model, split = spec["model"], (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        end = model["end_of_word_suffix"]
        plain = model["continuing_subword_prefix"] in (None, "") and not model["dropout"] and not model["ignore_merges"]
        if not end or not plain or split.get("behavior") != "Removed" or not split["invert"]:
            raise ValueError("the file is not byte-level with word ends")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("an added token does not match raw text as it stands")
        self.model = Tokenizer.from_str(self.spec)
        self.find_all = regex.compile(split["pattern"]["Regex"]).findall
        self.added = [t["content"] for t in spec["added_tokens"]]
        longest_first = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.cut = regex.compile("|".join(longest_first)) if self.added else None
        # The byte alphabet as the library writes it.
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.raw_of: dict[str, int] = {}
        for code in [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]:
            written = signs.pre_tokenize_str(chr(code))[0][0]
            self.raw_of.update(zip(written, chr(code).encode(), strict=True))
        vocabulary = model["vocab"]
        rank = {}
        made = {}
        for at, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = vocabulary[left], vocabulary[right]
            whole_id = vocabulary[left + right]
            rank[ids] = at
            if whole_id in made:
                raise ValueError("an entry is made by two merges")
            made[whole_id] = (*ids, at)
        self.rank, self.made = rank, made
        grows = all(made[part][2] < at for a, b, at in made.values() for part in (a, b) if part in made)
        if not grows:
            raise ValueError("an entry is merged before its parts")
        #: A tree of the entries' bytes from the last to the first. A node is the next nodes by byte, and the
        #: ids of the entry that begins there without and with a word end, -1 for none.
        self.endings: list = [{}, -1, -1]
        self.spines: dict[int, tuple] = {}
        for token, i in vocabulary.items():
            bare = token.removesuffix(end)
            if not bare or not all(c in self.raw_of for c in bare) or (len(bare) > 1 and not self._stays(i)):
                continue
            node = self.endings
            for c in reversed(bare):
                node = node[0].setdefault(self.raw_of[c], [{}, -1, -1])
            node[1 if bare == token else 2] = i
        gc.freeze()  # the tables stay: looking through them again and again takes longer than the work

    def _stays(self, token: int) -> bool:
        """Is the entry the encoding of its own text? Its two parts must meet as one merge."""
        if token not in self.made:
            return False
        left, right, at = self.made[token]
        return not self._apart(left, right, before=at)

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Entries at one side of a token's merge tree from the leaf up, each with the rank that ends it."""
        known = self.spines.get(2 * token + right)
        if known is None:
            chain, ends = [token], _NEVER
            found = [(token, ends)]
            while chain[-1] in self.made:
                left_part, right_part, at = self.made[chain[-1]]
                chain.append(right_part if right else left_part)
                found.append((chain[-1], at))
            known = self.spines[2 * token + right] = tuple(reversed(found))
        return known

    def _apart(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Do two tokens stay two when their texts are encoded together?

        At each moment one entry of the left one's right side faces one of the right one's left side. They merge
        if their rank comes before both are merged away; of equal ranks the left place goes first.
        """
        xs, ys = self._spine(left, True), self._spine(right, False)
        i = j = 0
        find = self.rank.get
        while True:
            x, x_end = xs[i]
            y, y_end = ys[j]
            at = find((x, y))
            if at is not None and at < x_end and at <= y_end:
                return False
            if x_end == y_end == _NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self._apart(left, right)
        return known

    # ---- Pre-tokens, words, texts ----

    def _prefix(self, raw: bytes, i: int, before: list[int]) -> int:
        """State of the prefix of ``i`` bytes: its last token (and one) and count where the word goes on, and its
        count where it is closed, 32 bits each in one integer.

        The entries that end here are found byte by byte backwards; the longest are tried first, and one fits.
        """
        nodes, pairs = self.endings[0], self.pairs.get
        opened, closed = [], []
        for at in range(i - 1, -1, -1):
            node = nodes.get(raw[at])
            if node is None:
                break
            nodes, open_token, closed_token = node
            if open_token >= 0:
                opened.append((before[at], at, open_token))
            if closed_token >= 0:
                closed.append((before[at], at, closed_token))
        state = 0
        for last, at, token in reversed(opened):
            fits = not at or pairs((last >> 64) << 20 | token)
            if fits is None:
                fits = self.fits(last >> 64, token)
            if fits:
                state = token << 64 | ((last >> 32 & _COUNT) + 1) << 32
                break
        for last, at, token in reversed(closed):  # none inside of a code point
            fits = not at or pairs((last >> 64) << 20 | token)
            if fits is None:
                fits = self.fits(last >> 64, token)
            if fits:
                return state | (last >> 32 & _COUNT) + 1
        return state

    def _counts(self, raw: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token's bytes, closed by the word end, that ends with a code point.
        Prefixes that pre-tokens share are worked out once."""
        known, before, n = self.prefixes, [0], len(raw)
        for i in range(1, min(n, LONGEST_PREFIX) + 1):
            head = raw[:i]
            state = known.get(head)
            if state is None:
                if len(known) >= MEMO_PREFIXES:
                    known.clear()
                state = known[head] = self._prefix(raw, i, before)
            before.append(state)
        for i in range(LONGEST_PREFIX + 1, n + 1):
            before.append(self._prefix(raw, i, before))
        if raw.isascii():
            return [state & _COUNT for state in before[1:]]
        return [state & _COUNT for i, state in enumerate(before) if i and (i == n or raw[i] & 0xC0 != 0x80)]

    def _piece(self, piece: str) -> list[int]:
        """Counts of the prefixes of a pre-token. A contraction is one only as a whole."""
        if piece[0] == "'" and len(piece) > 1 and len(pieces := self.find_all(piece[:-1])) != 1:
            before = self._joined(pieces)
            return [*before, self._counts(piece.encode())[-1]]
        return self._counts(piece.encode())

    def _joined(self, pieces: list[str]) -> list[int]:
        out = self._piece(pieces[0]) if pieces else []
        for piece in pieces[1:]:
            base = out[-1]
            out += [base + c for c in self._piece(piece)]
        return out

    def _by_library(self, text: str) -> list[int]:
        """Counts at each code point of a composed text without white space, with the library's own letter
        cases and pre-tokens."""
        low = self.model.normalizer.normalize_str(text)
        out: list[int] = []
        for _, (start, stop) in self.model.pre_tokenizer.pre_tokenize_str(low):
            base = out[-1] if out else 0
            out += [base + c for c in self._piece(low[start:stop])]
        if len(low) != len(text):  # a code point whose lower case is longer counts at its last one
            ends = np.cumsum([len(self.model.normalizer.normalize_str(c)) for c in text])
            out = [out[e - 1] for e in ends.tolist()]
        return out

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a text without added tokens. Inside a sequence that composition
        joins no prefix ends: there the count is that of the last prefix before it."""
        if self.model is None:
            self._prepare()
        if word.isascii() and word.isalpha():
            return self._counts(word.lower().encode())
        if _LATIN(word):
            return self._joined(self.find_all(word.lower()))
        out, at = [], 0
        for part in _DARK.finditer(word):
            base = out[-1] if out else 0
            out += [base] * (part.start() - at)  # white space
            out += [base + c for c in self._composed(part[0])]
            at = part.end()
        return out + [out[-1] if out else 0] * (len(word) - at)

    def _composed(self, word: str) -> list[int]:
        if unicodedata.is_normalized("NFC", word):
            return self._by_library(word)
        parts = sections(word)
        composed = [unicodedata.normalize("NFC", p) for p in parts]
        found = self._by_library("".join(composed))
        out, at, before = [], 0, 0
        for part, short in zip(parts, composed, strict=True):
            at += len(short)
            out += [before] * (len(part) - 1) + [found[at - 1]]
            before = found[at - 1]
        return out

    def _steps(self, word: str) -> bytes | list[int]:
        """Steps of a word: bytes where each fits into one."""
        found = self.counts(word)
        steps = list(map(sub, found, [0, *found]))
        if not steps or (min(steps) >= 0 and max(steps) < 128):
            return bytes(steps)
        return bytes([s & 255 for s in steps]) if -128 <= min(steps) and max(steps) < 128 else steps

    def _plain(self, text: str) -> list[bytes | list[int]]:
        """Steps of the words and of the blanks between them."""
        memo, out = self.memo, []
        for word in text.replace("\n", " ").split(" "):
            steps = memo.get(word)
            if steps is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                steps = self._steps(word)
                if len(word) <= 64:
                    memo[word] = steps
            out.append(steps)
        return out

    def text(self, text: str) -> tuple[int, int, bytes]:
        """Tokens of a whole text, bytes of a step, and the steps of its code points."""
        if self.model is None:
            self._prepare()
        if not any(token in text for token in self.added):
            words = self._plain(text)
            try:
                steps = b"\0".join(words)
                return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64)), 1, steps
            except TypeError:  # a step that one byte does not hold
                wide = _wide(words)
        else:
            wide = self._with_added(text)
        total = int(wide.sum())
        if len(wide) == 0 or -128 <= wide.min() <= wide.max() < 128:
            return total, 1, wide.astype(np.int8).tobytes()
        return total, 4, wide.astype("<i4").tobytes()

    def _with_added(self, text: str) -> np.ndarray:
        """Steps of a text with added tokens. A prefix that ends inside of one has its beginning as text."""
        out, at = [], 0
        for hit in [*self.cut.finditer(text), None]:
            part = text[at : hit.start() if hit else len(text)]
            out.append(_wide(self._plain(part)))
            if hit is None:
                break
            head = part[max(part.rfind(" "), part.rfind("\n")) + 1 :]
            base = (self.counts(head) or [0])[-1]
            counts = [base, *[self.counts(head + hit[0][:k])[-1] for k in range(1, len(hit[0]))], base + 1]
            out.append(np.diff(counts))
            at = hit.end()
        return np.concatenate(out).astype(np.int64)


def _wide(words: list[bytes | list[int]]) -> np.ndarray:
    found = []
    for word in words:
        found.append(np.frombuffer(word, np.int8).astype(np.int64) if isinstance(word, bytes) else np.array(word, np.int64))
        found.append(np.zeros(1, np.int64))
    return np.concatenate(found[:-1])


_KNOWN: dict[str, PrefixCounts] = {}


def _again(key: str, spec: str) -> PrefixCounts:
    """One counter a worker and file, so that its memory lasts over tasks."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = PrefixCounts(spec)
    return _KNOWN[key]


def prefix_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "prefix_counts") -> DataFrame:
    """``df`` with the token counts of all prefixes of its whole texts in column ``out`` (a store, see
    below), which replaces a column of that name in any letter case.

    A null or empty text has no prefix but the empty one and a total of 0; repeated rows and equal
    keys each keep their own; texts of any length take work in proportion; other columns stay; an empty table
    gives an empty one. A store is a struct: ``total`` tokens of the text, ``width`` bytes of a step,
    ``steps``, a signed little-endian integer a code point.
    """
    counter = PrefixCounts.load(tokenizer)

    @F.arrow_udf(STORE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [counter.text(t) for part in slices(batch) for t in part.to_pylist()]
            totals, widths, steps = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(totals, pa.int64()), pa.array(widths, pa.int32()), pa.array(steps, pa.binary())]
            yield pa.StructArray.from_arrays(columns, ["total", "width", "steps"])

    return df.withColumn(out, run(whole(text)))


def _counts_of(store: dict) -> np.ndarray:
    steps = np.frombuffer(store["steps"], np.int8 if store["width"] == 1 else "<i4")
    return np.cumsum(steps, dtype=np.int64)


@F.arrow_udf(T.LongType())
def _at(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for stores, lengths in batches:
        out = []
        for store, n in zip(stores.to_pylist(), lengths.to_pylist(), strict=True):
            if store is None or n is None:
                out.append(None)
                continue
            counts = _counts_of(store)
            n = min(n, len(counts))
            out.append(int(counts[n - 1]) if n > 0 else 0)
        yield pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def _within(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for stores, budgets in batches:
        out = []
        for store, budget in zip(stores.to_pylist(), budgets.to_pylist(), strict=True):
            if store is None or budget is None or budget < 0:
                out.append(None)
                continue
            fit = np.flatnonzero(_counts_of(store) <= budget)
            out.append(int(fit[-1]) + 1 if len(fit) else 0)
        yield pa.array(out, pa.int64())


def total(store: str = "prefix_counts") -> Column:
    """Tokens of the whole text."""
    return F.col(store)["total"]


def count_at(store: str, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` code points (of all, if there are fewer); null of a null."""
    return _at(F.col(store), _long(n_chars))


def longest_within(store: str, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null of a null or negative
    budget. Counts may fall as a prefix grows (a longer word can be one token), so all prefixes are asked."""
    return _within(F.col(store), _long(budget))


def truncate(df: DataFrame, budget: Column | int, text: str = "text", store: str = "prefix_counts") -> DataFrame:
    """``df`` with its texts cut to the longest prefix within the budget; a null text stays null."""
    keep = longest_within(store, budget).cast("int")
    return df.withColumn(text, F.substr(F.col(text), F.lit(1), keep))


def _long(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")
