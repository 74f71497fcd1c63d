"""Token ids of whole texts by a word-end BPE file, through a cache of distinct pre-tokens.

The library encodes every distinct pre-token; texts are cut into pre-tokens here.
Cutting follows the file's own normaliser and splitter: for texts of common Latin
characters with an equal expression in the ``regex`` module, for any other text with
the library's normaliser and splitter themselves.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import regex

#: Characters for which lower-casing, NFC, white space, letters and digits are the same in both libraries (NFC leaves them as they are).
_COMMON = regex.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ɏ‐-―‘-‧€]*")
#: The file's splitter as the re module writes it, right for those characters.
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FIND = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
#: Entries of each of a worker's caches; beyond it one starts anew.
CACHE = 300_000


class PreTokenizer:
    """Cuts texts into the pre-tokens of a tokenizers file; special strings inside texts are pre-tokens of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if len(splits) != 1 or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end BPE file: " + path)
        pattern = splits[0]["pattern"]["Regex"]
        self._common = pattern == _SPLITTER
        self._full = Tokenizer.from_file(path)
        self._split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self._model = self._full.model
        #: The byte-level alphabet: printable Latin-1 characters stand for their own bytes, the rest for 256 and up.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        self._letters = [chr(b if b in plain else next(others)) for b in range(256)]
        self._special_ids = {a["content"]: a["id"] for a in spec["added_tokens"]}
        special = [a["content"] for a in spec["added_tokens"]]
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and self._special.search(text):
            return [w for k, part in enumerate(self._special.split(text)) for w in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._common and _COMMON.fullmatch(text):
            return _FIND(text.lower())
        return [piece for piece, _ in self._split.pre_tokenize_str(self._full.normalizer.normalize_str(text))]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token, by the library's model."""
        tokenize, letters = self._model.tokenize, self._letters
        return [[self._special_ids[w]] if w in self._special_ids else [t.id for t in tokenize(w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]))] for w in words]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self._pre = PreTokenizer(path)
        self._known = _Ids(self._pre.encode)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self._pre(text)))


class _Ids(dict):
    """Pre-token to ids."""

    def __init__(self, encode):
        self._encode, self._older = encode, {}

    def __missing__(self, token: str) -> bytes:
        if (ids := self._older.get(token)) is None:
            ids = array("I", self._encode([token])[0]).tobytes()
        if len(self) > CACHE:
            self._older = dict(self)
            self.clear()
        self[token] = ids
        return ids
