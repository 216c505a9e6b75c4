"""Token ids by a bounded cache of encoded words.

For a tokenizer that drops white space and never merges across it, the ids of a text are those of its words one after the
other. So each worker encodes a word once while it stays in its cache; the cache is an aid only and forgets rare words.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np

_SPACE = "\t-\r \x85\xa0  -     　"
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Items of a text: a Latin word up to plain punctuation, that punctuation at a word's end, or else all up to white space.
#: The tokenizer's own rules part texts at all these places too.
ITEM = re.compile(f"[{_LATIN}]+(?=[{_SPACE}.,!?]|$)|[.,!?]+(?=[{_SPACE}]|$)|[^{_SPACE}]+")
#: Latin words of items parted by blanks.
PLAIN = re.compile(f"(?<![^ ])[{_LATIN}]+(?![^ ])")
#: Plain punctuation that ``ITEM`` parts from the Latin word before it; its first sign, one pattern for each, as searches for
#: one sign and constants put in place are the fastest.
CLINGING = [(p, re.compile(f"{re.escape(p)}(?<=[{_LATIN}]{re.escape(p)})(?=[.,!?]*(?:[{_SPACE}]|$))")) for p in ".,!?"]
#: Signs that a tokenizer may lower otherwise than ``str.lower``, or join with a sign beside them first.
_UNSURE = re.compile("[\u0130\u0250-\U0010ffff]")
#: Items that a worker holds: some 250 bytes each.
CACHE_ITEMS = 800_000
#: Signs at which ``str.split`` parts texts and ``ITEM`` does not.
_SEPARATOR = re.compile("[\x1c-\x1f]")


#: Texts that a tokenizer must part as ``ITEM`` does to be asked for single items; others are asked for whole texts.
PROBES = ("Two words, and more... Done! Was it? don't \"quoted\" (so) 12.5% #tag a_b", " lead\ttab\nline  two  blanks \xa0 end ", "Ünïcödé straße. 日本語テキスト。 mixed日本 🎉!? x.y.z", "a,b;c:d e.f, g", "")


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of whole texts, by the ``tokenizers`` library."""

    def __init__(self, path: str, cache_items: int = CACHE_ITEMS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_items // 2
        # two generations: what is used again moves to the young one, the rest is forgotten with the old one
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values(), default=0)
        self.ends = np.zeros(self.largest + 1, bool)
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # a tokenizer that lowers all letters itself gives the same ids for words that are lowered, and cached, before
        signs = [x for x in map(chr, range(0x21, 0x250)) if not _UNSURE.match(x)] + [t.upper() for t in PROBES]
        self.lowers = self._whole(signs) == self._whole([x.lower() for x in signs])
        self.apart = all(self._whole([t])[0] == b"".join(self._whole(part)) for t in PROBES for part in (ITEM.findall(t), self.items(t)))
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def items(self, text: str) -> list[str]:
        """Parts of a text whose ids are the text's, one after the other; in lower case where that cannot change them."""
        if _SEPARATOR.search(text):
            return ITEM.findall(text)
        if self.lowers and not _UNSURE.search(text):
            low = text.lower()
            text = text if any(x in low for x in self.special) else low
        for sign, clinging in CLINGING:
            if sign in text:
                text = clinging.sub(" " + sign, text)
        return text.split()

    def _learn(self, items: list[str]) -> None:
        plain, rest = [], []
        for x in items:
            (plain if x.isalpha() else rest).append(x)
        for i in range(0, len(plain), 1000):
            part = PLAIN.findall(" ".join(plain[i : i + 1000]))
            if len(part) < len(plain[i : i + 1000]):  # letters of other scripts
                rest += set(plain[i : i + 1000]).difference(part)
            if not part:
                continue
            (coded,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.asarray(coded.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # not a tokenizer that marks each word's end
                rest += part
                continue
            data, at = ids.tobytes(), 0
            for x, end in zip(part, (4 * cuts).tolist(), strict=True):
                self.young[x] = data[at:end]
                at = end
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for x, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[x] = np.asarray(coded.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.apart:
            return self._whole([t or "" for t in texts])
        split = [self.items(t) if t else [] for t in texts]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing = []
        for x in set().union(*split).difference(self.young):
            if (known := self.old.get(x)) is None:
                missing.append(x)
            else:
                self.young[x] = known
        self._learn(missing)
        of = self.young.__getitem__
        return [b"".join(map(of, items)) for items in split]


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, with its cache, kept for the worker's next tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def forget() -> None:
    """Drops the worker's tokenizers with their caches and hands the memory back, before tasks that need none of them."""
    if _LOADED:
        _LOADED.clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory else
            trim(0)
