"""Token ids of whole texts by a public tokenizer file, at the speed of a dictionary look-up per word.

A text is cut at spaces where the tokenizer is certain to cut as well. A plain word (Latin letters, then
perhaps punctuation) is looked up by its letters and by its punctuation, each of which the file's own
model has tokenized once; any other word goes through the whole tokenizer. The ids of words are kept as
packed bytes. Where the file holds a byte-level vocabulary whose ids are its merge order, texts of Latin
letters go through ``tiktoken`` with that vocabulary, which gives the same ids sooner; other texts, for
which the two libraries' tables of letters may differ by their Unicode version, do not. The result is
that of the ``tokenizers`` library for the whole text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

#: Behind a word's letters these make one piece of their own, whichever of them and however many.
PUNCTUATION = ".,!?;:*#$%&|"
#: Fixed value: where byte-level BPE cuts a text before merging.
BYTE_LEVEL_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond Latin letters and general punctuation the word path decides.
_FAR = re.compile("[^\x00-\u024f\u2010-\u2027]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is visible, else the next free code from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Made(dict):
    """Values that are made when their key is first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


class WordTokenizer:
    """``encode(texts)`` gives per text the ids as packed unsigned integers of ``width`` bytes.

    leading_space: the tokenizer puts a space in front of a word into the word's first token
    (byte-level BPE) rather than dropping white space and case. A text that holds the string of an added
    token goes through the library as a whole, which gives that token's id. Each cache holds at most ``cache_size`` entries and starts anew beyond that.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        one = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        self.leading_space = one("a b") != one("a") + one("b")
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.cache_size = cache_size
        self.words: dict[str, bytes] = {} if self.leading_space else _Made(self._word)
        self.heads: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.shown = _Made(lambda code: "".join(self.letters[b] for b in chr(code).encode()))
        sample = " Ábc, x.\nDéf!! ß" if self.leading_space else "Ábc, x. Déf!! ß"
        self.plain = True
        by_piece = b"".join(self._plain_word(w, " " if i and self.leading_space else "") or b"?" for i, w in enumerate(sample.split(" ")) if w)
        if self.leading_space:
            sample = sample[1:]
            by_piece = b"".join(self._plain_word(w, " " if i else "") or b"?" for i, w in enumerate(sample.split(" ")))
        self.plain = by_piece == self.pack(one(sample))
        self.fast = self._same_vocabulary(path) if self.leading_space else None

    def _same_vocabulary(self, path: str):
        """A faster encoder of the file's vocabulary, if the file is of the kind it can express."""
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model = file["model"]
        if file.get("normalizer") or model.get("end_of_word_suffix") or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            return None
        back = {c: b for b, c in self.letters.items()}
        special = {t["content"] for t in file["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        import tiktoken

        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pack(self, ids) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            mapped = piece if piece.isascii() and piece.isalpha() else piece.translate(self.shown)
            found = self.pieces[piece] = self.pack([t.id for t in self.tokenizer.model.tokenize(mapped)])
        return found

    def _plain_word(self, word: str, prefix: str) -> bytes | None:
        """The ids of a word of the plain kind, else None."""
        out = b""
        for k, line in enumerate(word.split("\n") if "\n" in word else (word,)):
            core = line.rstrip(PUNCTUATION)
            if not core.isalpha() or not (core.isascii() or max(core) < "ɐ"):
                return None
            tail = line[len(core) :]
            if not self.leading_space:
                core = core.lower()
                if not core.isascii() and not (core.isalpha() and unicodedata.is_normalized("NFC", core)):
                    return None
            elif k:
                out += self._piece("\n")
            else:
                core = prefix + core
            out += self._piece(core)
            if tail:
                out += self._piece(tail)
        return out

    def _word(self, key: str) -> bytes:
        """The ids of a word where white space goes; the usual case without the steps of _plain_word."""
        core = key.rstrip(PUNCTUATION)
        low = core.lower()
        found = self.pieces.get(low)
        if found is None and self.plain and core.isalpha() and (core.isascii() or max(core) < "ɐ" and low.isalpha() and unicodedata.is_normalized("NFC", low)):
            found = self._piece(low)
        if found is not None:
            if len(core) == len(key):
                return found
            tail = self.pieces.get(key[len(core) :])
            if tail is not None:
                return found + tail
        found = self._plain_word(key, "") if self.plain else None
        return self.pack(self._batch([key], add_special_tokens=False)[0].ids) if found is None else found

    def _learn(self, cache: dict[str, bytes], keys, prefix: str) -> None:
        other = []
        for key in keys:
            found = self._plain_word(key, prefix) if self.plain else None
            if found is None:
                other.append(key)
            else:
                cache[key] = found
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            for key, found in zip(part, self._batch([prefix + k for k in part], add_special_tokens=False)):
                cache[key] = self.pack(found.ids)

    def _cut(self, text: str) -> list[str]:
        if not self.leading_space:
            return text.replace("\n", " ").split(" ")
        parts = text.split(" ")
        if "  " in text or text[:1].isspace() or text[-1:].isspace() or " \n" in text or "\n " in text:
            return self._merged(parts)
        if not text.isascii() or "\t" in text or "\r" in text:
            for p in parts:
                if p and (p[0].isspace() or p[-1].isspace()):
                    return self._merged(parts)
        return parts

    @staticmethod
    def _merged(parts: list[str]) -> list[str]:
        """Parts whose border touches more white space belong to one piece."""
        out = [parts[0]]
        for p in parts[1:]:
            before = out[-1]
            if not p or p[0].isspace() or not before or before[-1].isspace():
                out[-1] = f"{before} {p}"
            else:
                out.append(p)
        return out

    def encode(self, texts: list[str], at_once: int = 2_000_000):
        """Yields per text its packed ids; about ``at_once`` characters are cut at a time."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(t or "")
            if size >= at_once:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if self.added.search(t)} if self.added else ()
        if whole:
            rest = iter(self._ordinary([t for k, t in enumerate(texts) if k not in whole]))
            return [self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if k in whole else next(rest) for k, t in enumerate(texts)]
        return self._ordinary(texts)

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        """Of texts without the string of an added token."""
        if self.fast:
            out = [None if _FAR.search(t) else self.pack(self.fast(t)) for t in texts]
            rest = iter(self._by_words([t for t, x in zip(texts, out) if x is None]))
            return [next(rest) if x is None else x for x in out]
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        for cache in (self.words, self.heads, self.pieces):
            if len(cache) > self.cache_size:
                cache.clear()
        if not self.leading_space:  # one pass: no word depends on its place
            known = self.words.__getitem__
            return [b"".join(map(known, self._cut(t))) for t in texts]
        cut = [self._cut(t) for t in texts]
        heads = {p[0] for p in cut}.difference(self.heads)
        self._learn(self.heads, heads, "")
        fresh: set[str] = set()
        for p in cut:
            fresh.update(p[1:])
        fresh.difference_update(self.words)
        self._learn(self.words, fresh, " ")
        word, head = self.words.__getitem__, self.heads
        return [head[p[0]] + b"".join(map(word, p[1:])) for p in cut]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def forget(path: str) -> None:
    """A worker that has done with encoding gives the memory of its words back."""
    _LOADED.pop(path, None)
