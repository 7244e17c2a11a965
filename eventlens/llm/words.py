"""Normalised words of a text, as a word-level BPE file of the ``tokenizers`` library cuts them.

The file's normaliser (NFC, white space, lower case) and its split pattern never look across white space, so a text can be
cut there into windows. Words are looked up in a bounded cache; only new ones are encoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import regex

#: White space as the file's patterns understand it (fixed values); Python also counts the four separators.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
#: A text of other letters needs Unicode's classes; for these (Latin-1 and common punctuation) plain ones give the same words, faster.
_OTHER = re.compile("[^\x00-\x1b\x20-\xff\u2010-\u2027\u20ac]")
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: The split pattern that ``_LATIN`` stands for (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words longer than this are not kept in a cache.
LONG_WORD = 200


class WordFile:
    """What a tokenizer file says about normalising and cutting words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        kinds = [n["type"] for n in (self.file["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: expected the normalisers NFC, Replace, Lowercase; found {kinds}")
        split = self.file["pre_tokenizer"]["pretokenizers"][0]
        pattern = split["pattern"]["Regex"]
        self._words, self._latin = regex.compile(pattern.replace("\\s", SPACE)), pattern == PATTERN
        self.added = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case; each letter by itself, so a sigma has one form everywhere."""
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, text) in order; added tokens are found before normalising."""
        if self._added is None or not any(a in text for a in self.added):
            yield False, text
            return
        for k, part in enumerate(self._added.split(text)):
            if part:
                yield k % 2 == 1, part

    def words(self, text: str) -> list[str]:
        """The words of a normalised text."""
        return (_LATIN if self._latin and not _OTHER.search(text) else self._words).findall(text)


def windows(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in windows of about ``size`` code points, cut before white space (where no word, mark or added token can continue)."""
    start = 0
    while len(text) - start > size:
        m = _SPACES.search(text, start + size)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


class Cache(dict):
    """word -> value, computed on a miss. Two generations of at most ``bound`` words, so memory stays bounded and frequent words stay."""

    def __init__(self, make: Callable[[str], object], bound: int = 150_000):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
