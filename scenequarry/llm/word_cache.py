"""Exact token ids of whole texts, with the ids of repeated words remembered.

Natural text repeats its words. A pre-tokenizer that never looks across a
single space lets a text be encoded word by word, and each distinct word needs
the tokenizer only once per worker. A new word is cut by the pre-tokenizer's
own pattern and its parts, which repeat even more, go to the tokenizer's model.
Words beyond printable Latin-1 and texts whose white space is irregular go to
the tokenizer in one piece, as do all texts of a tokenizer of unknown make, so
the ids always equal those of encoding the text whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Callable
from functools import cache

import regex

from .shared import held

#: The pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Marks that are pre-tokens of their own after letters.
MARKS = ".,;:!?"

_beyond = re.compile("[^\0-\xff]").search


def cached_encoder(path: str, special_as_text: bool = False) -> "WordCache":
    """This worker's encoder for ``path``."""
    return held((WordCache, path, special_as_text), lambda: WordCache(path, special_as_text))


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: those of
    Latin-1 that print stand for themselves, the others follow from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class _Words(dict):
    """Ids by word; an unknown word is looked up in the last generation or encoded."""

    def __init__(self, encoder: "WordCache", older: dict):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            e, core = self.encoder, word[:-1]
            if e.plain and _letters(word):
                ids = e.letters(word)
            elif e.plain and word[-1:] in MARKS and _letters(core):
                ids = self[core] + e.part(word[-1])
            else:
                ids = e.word(word)
        if len(word) <= self.encoder.longest:
            self[word] = ids
        return ids


class _Irregular(Exception):
    """A text's white space doesn't let it be cut at every single space."""


class WordCache:
    """Encode texts to little-endian unsigned 32-bit ids.

    ``special_as_text``: the strings of special tokens within a text count as
    ordinary text; else, as in the library by default, they become those
    tokens, and a text that holds one is encoded whole. ``limit`` bounds the words remembered, none of which is
    longer than ``longest``: at the limit a new generation starts, and words
    still in use move over from the last one.
    """

    def __init__(self, path: str, special_as_text: bool = False, limit: int = 500_000, longest: int = 200):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.limit, self.longest = limit, longest
        with open(path, encoding="utf-8") as f:
            self.kind, pattern = _kind(json.load(f))
        self.words, self.parts = _Words(self, {}), {}
        if self.kind == "dropped":
            self.words[""] = b""
        self.pattern = regex.compile(pattern) if pattern else None
        added = [] if special_as_text else list(self.tokenizer.get_added_tokens_decoder().values())
        any_case = re.I if any(t.normalized for t in added) else 0
        self.added = re.compile("|".join(re.escape(t.content) for t in added), any_case).search if added else lambda text: None
        self.plain = self.pattern is not None
        self.shown = dict(enumerate(byte_alphabet()))
        self.careful = re.compile(r"(?<=\S)(?= \S)")

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in encoded]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self.whole(texts)
        gc.disable()  # a collection would walk all the words, which form no cycles
        try:
            cut = self._dropped if self.kind == "dropped" else self._joined
            return [self.whole([t])[0] if self.added(t) else cut(t) for t in texts]
        finally:
            gc.enable()

    def _known(self) -> _Words:
        if len(self.words) > self.limit:
            self.words = _Words(self, dict(self.words))
        if len(self.parts) > self.limit:
            self.parts.clear()
        return self.words

    def _dropped(self, text: str) -> bytes:
        return b"".join(map(self._known().__getitem__, text.replace("\n", " ").split(" ")))

    def _joined(self, text: str) -> bytes:
        first, *pieces = text.replace("\n", " \n").split(" ")
        if not pieces:
            return self.chunk(text)
        try:
            if not _clean(first):
                raise _Irregular
            return self.chunk(first) + b"".join(map(self._known().__getitem__, pieces))
        except _Irregular:
            return b"".join(self.whole(self.careful.split(text)))

    def letters(self, word: str) -> bytes:
        """Ids of a word of Latin-1 letters, which is one pre-token."""
        dropped = self.kind == "dropped"
        shown = word.lower() if dropped else word
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.shown)
        return _packed(self.model.tokenize(shown if dropped else self.shown[32] + shown))

    def word(self, word: str) -> bytes:
        if self.kind == "dropped":
            return self.chunk(word) if word else b""
        if not _clean(word[1:] if word[:1] == "\n" else word):
            raise _Irregular
        return self.chunk(word if word[0] == "\n" else " " + word)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text that stands alone: a word with at most one space or line break before it."""
        word = chunk[1:] if chunk[:1] in (" ", "\n") else chunk
        if self.pattern is None or not (word.isascii() or max(word) <= "\xff"):
            return self.whole([chunk])[0]
        shown = chunk.lower() if self.kind == "dropped" else chunk
        if word.isalpha() and chunk[0] != "\n":
            cut = (shown,)
        elif word.isprintable():
            cut = self.pattern.findall(shown)
        else:
            return self.whole([chunk])[0]
        return b"".join(map(self.part, cut))

    def part(self, part: str) -> bytes:
        """Ids of one pre-token, given to the model in the byte alphabet."""
        if part in self.parts:
            return self.parts[part]
        ids = _packed(self.model.tokenize(part.encode().decode("latin-1").translate(self.shown)))
        if len(part) <= self.longest:
            self.parts[part] = ids
        return ids


@cache
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def _packed(tokens: list) -> bytes:
    return _packer(len(tokens))(*[t.id for t in tokens])


def _letters(word: str) -> bool:
    return word.isalpha() and (word.isascii() or not _beyond(word))


def _clean(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def _kind(spec: dict) -> tuple[str, str]:
    """How far the pre-tokenizer looks, and its pattern: 'joined' keeps a space with the
    word after it, 'dropped' discards white space and lowers case, 'whole' stands for any other."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
        return "joined", BYTE_LEVEL_PATTERN
    cut, *rest = pre.get("pretokenizers") or [{}]
    pattern = (cut.get("pattern") or {}).get("Regex", "")
    dropped = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and r"[^\s" in pattern
    bytes_after = [p.get("type") for p in rest] == ["ByteLevel"] and not rest[0].get("use_regex", True) and not rest[0].get("add_prefix_space")
    lowered = [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    return ("dropped", pattern) if dropped and bytes_after and lowered else ("whole", "")
