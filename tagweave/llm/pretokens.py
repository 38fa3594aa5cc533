"""Cutting a text into the pieces inside which byte-level BPE merges."""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tokenizers import pre_tokenizers

#: Below this code point all Unicode versions in use agree on letters, numbers and spaces.
_SETTLED = 0x530
#: A text of more characters is cut piece by piece and never held as one list of words.
_LONG = 1_000_000
_BLOCK = 200_000


@dataclass(frozen=True)
class Special:
    """An added token inside a text; unlike any piece of the text itself."""
    content: str


def _ranges(kind: str) -> str:
    points = [c for c in range(_SETTLED) if unicodedata.category(chr(c)).startswith(kind)]
    runs = [list(g) for _, g in itertools.groupby(points, key=lambda c, n=itertools.count(): c - next(n))]
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


@functools.cache
def _fast() -> tuple[re.Pattern, re.Pattern]:
    letter, number, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    pieces = (f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
              f"|[{space}]+(?![^{space}])|[{space}]+")
    return re.compile(pieces), re.compile(f"[^\\x00-\\u{_SETTLED - 1:04x}]")


def added_tokens(model: dict) -> dict[str, int]:
    """Added tokens of a tokenizer file; they are found in raw text before it is cut."""
    found = {}
    for token in model.get("added_tokens", []):
        if any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take white space or need a normaliser are not supported")
        found[token["content"]] = token["id"]
    return found


def check_supported(model: dict) -> None:
    """Only plain byte-level BPE without a normaliser or prefix space is handled; anything else raises."""
    pre = model.get("pre_tokenizer") or {}
    kind = model["model"]
    if (model.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or kind.get("type") != "BPE" or kind.get("dropout")
            or kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix") or kind.get("ignore_merges")):
        raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")


def splitter(specials: dict[str, int]) -> Callable[[str], Iterator[list]]:
    """A function from a text to lists of its pieces, in order; added tokens come as `Special`."""
    pieces, late = _fast()
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    marks = (re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
             if specials else None)

    def plain(text: str) -> Iterator[list]:
        if not text.isascii() and late.search(text):
            yield [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        elif len(text) <= _LONG:
            yield pieces.findall(text)
        else:
            found = (m.group() for m in pieces.finditer(text))
            while block := list(itertools.islice(found, _BLOCK)):
                yield block

    def split(text: str) -> Iterator[list]:
        if marks is None or not marks.search(text):
            yield from plain(text)
            return
        for i, part in enumerate(marks.split(text)):
            if i % 2:
                yield [Special(part)]
            elif part:
                yield from plain(part)
    return split


def load(content: str) -> dict:
    model = json.loads(content)
    check_supported(model)
    return model


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes take the letters from U+0100 on.
    """
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
