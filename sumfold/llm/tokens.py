"""Token ids by the ``tokenizers`` library, with a bounded memory of pre-tokens already seen.

A byte-pair model encodes every pre-token by itself, so a text's ids are the ids of its
pre-tokens one after another. We cut the pre-tokens with the tokenizer file's own pattern and ask
the library's model only for those not met before; words repeat, so most of the merging is
saved. Texts for which this cutting might differ from the library's go through the library
whole. ``tests/llm/test_tokens.py`` holds the two ways against each other.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import regex

#: Pre-tokens a worker remembers, and the longest that it remembers, in characters.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 48

# White space, letters and numbers up to U+00FF, and white space beyond.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WIDE_SPACE = _SPACE + r"  -     　"


def _byte_alphabet() -> dict[int, str]:
    """Byte value to the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, self.entries, self.cache = self.whole.model, entries, {}
        self.alphabet = _byte_alphabet()
        self.marks = [t["content"] for t in spec.get("added_tokens") or []]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind, self.settled = None, set()
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
            parts = " ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
        elif norm is not None and _lowers(norm) and _splits(pre):
            self.kind = "lower"
            parts = "[{L}]+|[{N}]|[^{S}{L}{N}]+"
        if self.kind:
            cut = "'(?:[stmd]|re|ve|ll)|" + parts
            self.narrow = re.compile(cut.format(S=_SPACE, L=_LETTER, N=_NUMBER)).findall
            self.wide = regex.compile(cut.format(S=_WIDE_SPACE, L=r"\p{L}", N=r"\p{N}")).findall

    def _pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of ``text``, or None if the library has to cut it."""
        if self.kind is None or any(m in text for m in self.marks):
            return None
        if text.isascii():
            return self.narrow(text.lower() if self.kind == "lower" else text)
        if self.kind == "lower":
            # the library lowers character by character; only a capital sigma (and the dotted I) differ by context
            if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
                return None
            text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text) if self._settled(text) else None
        return self.narrow(text)

    def _settled(self, text: str) -> bool:
        """Whether all characters have had their general category for long, so that libraries agree on it."""
        new = set(text) - self.settled
        known = {c for c in new if (x := unicodedata.ucd_3_2_0.category(c)) != "Cn" and x[0] == unicodedata.category(c)[0]}
        self.settled |= known
        return len(known) == len(new)

    def _ids_of(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text; null and empty have none."""
        if not text:
            return b""
        pieces = self._pieces(text)
        if pieces is None:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self._ids_of(p)
                if len(cache) < self.entries and len(p) <= CACHE_CHARS:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode_all(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        return map(self.encode, texts)


def _lowers(norm: dict) -> bool:
    steps = [s.get("type") for s in norm.get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"]


def _splits(pre: dict) -> bool:
    steps = pre.get("pretokenizers") or [{}]
    # Fixed value: the pattern of files of this kind.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return steps[0].get("type") == "Split" and steps[0].get("pattern", {}).get("Regex") == pattern and steps[0].get("invert") and steps[-1].get("type") == "ByteLevel"


_encoders: dict[str, Encoder] = {}


def public_path(name: str) -> str:
    """Where the box keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file: an absolute path, or the name of a public tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path if path.startswith("/") else public_path(path))
    return _encoders[path]
