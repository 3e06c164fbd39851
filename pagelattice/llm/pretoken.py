"""Splitting texts into the pre-tokens of a tokenizer file, and encoding each distinct one once.

The merges of a BPE tokenizer never cross a pre-token, so a text's ids are those of its pre-tokens one after the other.
Texts of Latin-1 characters, which NFC leaves as they are, are split by one compiled pattern; all others go through the
library's own normalizer and splitter. Special strings in a text stay whole, as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np

#: Letters and digits among the lower-case characters up to U+00FF, by Unicode category.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
#: The byte mapping: printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_WIDE = re.compile("[^\x00-\xff]")


class PreTokens:
    """Pre-tokens of texts, and the ids of a pre-token, for a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not parts or parts[0]["type"] != "Split" or not parts[0]["invert"]:
            raise ValueError("the file's pre-tokenizer isn't a pattern of pre-tokens followed by a byte mapping")
        rx = parts[0]["pattern"]["Regex"]
        self._split = pre_tokenizers.Split(Regex(rx), "removed", invert=True)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        self._fast = rx == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and kinds == ["NFC", "Replace", "Lowercase"]
        special = [x["content"] for x in spec["added_tokens"]]
        self._whole = {x["content"]: [x["id"]] for x in spec["added_tokens"]}
        plain = [x["type"] for x in parts] == ["Split", "ByteLevel"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        self._model = self.tok.model.tokenize if plain else None
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def of(self, text: str) -> list[str]:
        if self._special and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self._special.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._fast and (text.isascii() or not _WIDE.search(text)):
            return _FAST.findall(text.lower())
        return [x for x, _ in self._split.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.ids(pieces)]

    def ids(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pre-tokens. Where the splitter is followed by the byte mapping alone, the library's model takes the
        mapped pre-token as it is; the way through normalizer and splitter would find the same one again."""
        if self._model is None:
            return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        model, whole = self._model, self._whole
        return [whole[x] if x in whole else [t.id for t in model(x.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES))] for x in pieces]


class Encoder:
    """Ids of texts, with the ids of up to `limit` distinct pre-tokens kept; beyond that the store starts anew."""

    def __init__(self, path: str, limit: int = 500_000):
        self.pre, self.limit = PreTokens(path), limit
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str | None, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        got = self.pre.ids(new)
        k, sizes = len(self.at), np.fromiter(map(len, got), np.int64, len(got))
        n = int(sizes.sum())
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(new) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(got), np.uint32, n)
        self.size[k : k + len(new)] = sizes
        self.start[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(new, range(k, k + len(new)), strict=True))
        self.used += n

    def encode_all(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of some texts; all that is new in them is encoded at once."""
        if len(self.at) > self.limit:
            self._reset()
        split = [self.pre.of(t) for t in texts]
        if end is not None:
            split = [[*p, None] for p in split]
            if None not in self.at:
                k = len(self.at)
                self.at[None] = k
                self.start[k], self.size[k], self.flat[self.used] = self.used, 1, end
                self.used += 1
        pieces = list(chain.from_iterable(split))
        rows = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int32, len(pieces))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([pieces[k] for k in missing])))
            rows[missing] = [self.at[pieces[k]] for k in missing]
        sizes = self.size[rows]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[rows] - (ends - sizes), sizes) + np.arange(total, dtype=np.int32)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, text: str, end: int | None = None) -> np.ndarray:
        return self.encode_all([text], end)[0]
