"""Pre-tokens of byte-level BPE, and a bounded cache of what each of them gives."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes, about, that a worker's cache of pieces takes at most. Only speed depends on it.
CACHE_BYTES = 192 << 20
#: What an entry takes besides its piece's characters, about.
ENTRY_BYTES = 200

#: Below this, all Unicode versions agree on what is a letter, a number and white space.
_SURE = 0x2B0
_UNSURE = re.compile(f"[^\x00-{chr(_SURE - 1)}]")


def _members(kind: str) -> str:
    """The characters below _SURE of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(_SURE) if unicodedata.category(chr(c))[0] == kind)


class Splitter:
    """Cuts texts by a pattern. The public byte-level pattern is also compiled for the standard library, its classes spelt
    out, which cuts texts of sure characters alike and in less than half the time."""

    def __init__(self, pattern: str):
        import public_tokenizers

        self.any = regex.compile(pattern).findall
        self.sure = None
        if pattern == public_tokenizers.PATTERN:
            space = "\t-\r \x85\xa0"
            letters, numbers = _members("L"), _members("N")
            spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
            for name, members in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", space), (r"\S", "^" + space)):
                spelt = spelt.replace(name, f"[{members}]")
            self.sure = re.compile(spelt).findall

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.sure is None or _UNSURE.search(text) else self.sure(text)


class Cache:
    """piece -> value, never None, found for many missing pieces at once. When half of the bytes are taken, what was not
    used since the last time goes."""

    def __init__(self, find, most: int = CACHE_BYTES):
        self.find, self.most = find, most
        self.known: dict = {}
        self.old: dict = {}
        self.held = 0

    def values(self, pieces: list[str]) -> list:
        """The value of each of pieces, in order."""
        out = list(map(self.known.get, pieces))
        at, i = [], -1
        try:
            while True:
                i = out.index(None, i + 1)
                at.append(i)
        except ValueError:
            pass
        if at:
            missing = dict.fromkeys(map(pieces.__getitem__, at))
            new = [p for p in missing if p not in self.old]
            found = dict(zip(new, self.find(new), strict=True)) if new else {}
            for p in missing:
                missing[p] = found[p] if p in found else self.old[p]
            for i in at:
                out[i] = missing[pieces[i]]
            self.known.update(missing)
            self.held += sum(map(len, missing)) + ENTRY_BYTES * len(missing)
            if self.held > self.most // 2:
                self.old, self.known, self.held = self.known, {}, 0
        return out

    def forget(self) -> None:
        self.known, self.old, self.held = {}, {}, 0

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """For lists of pieces, each one's values joined."""
        flat = self.values(list(itertools.chain.from_iterable(split)))
        ends = list(itertools.accumulate(map(len, split)))
        return [b"".join(flat[a:b]) for a, b in zip([0, *ends], ends)]


def packed(lists: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    data = np.fromiter(itertools.chain.from_iterable(lists), "<u4").tobytes()
    ends = [4 * n for n in itertools.accumulate(map(len, lists))]
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class HubTokenizer:
    """A byte-level BPE of the tokenizers library, by pre-token: equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser, prefix space or own pattern is needed")
        import public_tokenizers

        self.split = Splitter(public_tokenizers.PATTERN)
        self.letters = dict(enumerate(byte_letters()))
        getattr(self.library.model, "_resize_cache", lambda n: None)(0)  # pieces come once each; its own cache only costs
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must be plain strings")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.ids = Cache(self._encode)

    def piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """The ids that the library's model gives each pre-token."""
        tokenize, letters, added = self.library.model.tokenize, self.letters, self.added
        return [[added[p]] if p in added else [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return packed(self.piece_ids(pieces))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of text in order; a special string, which the library takes as one token, is one of them."""
        if self.special is not None and any(x in text for x in self.added):
            parts = self.special.split(text)
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _UNSURE.search(text) is None:
            return self.split.sure(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]  # by the library's own tables

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; the library encodes each pre-token that isn't known."""
        return self.ids.joined([self.pieces(t) for t in texts])


@functools.lru_cache(maxsize=4)
def hub_tokenizer(file: str) -> HubTokenizer:
    """One for each file and worker process."""
    return HubTokenizer(file)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable and not a space, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
