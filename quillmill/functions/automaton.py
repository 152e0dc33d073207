"""Finding many phrases at once: an automaton over words, whose steps are a table.

A text is cut into words (runs of letters, digits and underscores) and single other characters. A phrase that must not
start or end inside a word can only stand where such a cut is, so the automaton steps from word to word, and phrases that share a
beginning share states. Where no step fits it falls back to the longest beginning that still fits, so a text is read once, whatever the number of phrases.
"""

from __future__ import annotations

from collections import deque
from functools import cached_property

import numpy as np
import regex

from quillmill.functions.targets import FOLDED_FROM, FOLDED_TO

CUT = regex.compile(r"[\p{L}\p{Nd}_]+|.", regex.DOTALL)
_TABLE = {ord(a): b for a, b in zip(FOLDED_FROM, FOLDED_TO)} | {ord(a): None for a in FOLDED_FROM[len(FOLDED_TO) :]}
_ODD = regex.compile(f"[{regex.escape(FOLDED_FROM)}]")


def folded(text: str) -> str:
    """One form for all cases; two texts that match in any case have the same."""
    low = text.lower()
    return low.translate(_TABLE) if _ODD.search(low) else low


def cut(text: str) -> list[str]:
    return CUT.findall(folded(text))


class Automaton:
    """States, steps and fallbacks for phrases, numbered as given; plain arrays, so they can be sent to all tasks."""

    def __init__(self, phrases: list[str]):
        vocabulary: dict[str, int] = {}
        steps: dict[int, int] = {}
        ends: dict[int, list[int]] = {}
        children: list[list[tuple[int, int]]] = [[]]
        for k, phrase in enumerate(phrases):
            state = 0
            for w in cut(phrase):
                key = state << 32 | vocabulary.setdefault(w, len(vocabulary))
                if key not in steps:
                    steps[key] = len(children)
                    children[state].append((key & 0xFFFFFFFF, len(children)))
                    children.append([])
                state = steps[key]
            if state:
                ends.setdefault(state, []).append(k)
        fall, link = [0] * len(children), [0] * len(children)
        waiting = deque(child for _, child in children[0])
        while waiting:  # by the number of words behind the start, so fallbacks of shorter beginnings are known
            state = waiting.popleft()
            for w, child in children[state]:
                back = fall[state]
                while back and back << 32 | w not in steps:
                    back = fall[back]
                fall[child] = steps.get(back << 32 | w, 0)
                link[child] = fall[child] if fall[child] in ends else link[fall[child]]
                waiting.append(child)
        self.words = list(vocabulary)
        self.keys, self.next = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        self.fall, self.link = np.array(fall, np.int32), np.array(link, np.int32)
        self.end_states = np.array([s for s, ks in ends.items() for _ in ks], np.int32)
        self.end_phrases = np.array([k for ks in ends.values() for k in ks], np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    @cached_property
    def _ready(self):
        ends: dict[int, list[int]] = {}
        for s, k in zip(self.end_states.tolist(), self.end_phrases.tolist()):
            ends.setdefault(s, []).append(k)
        steps = dict(zip(self.keys.tolist(), self.next.tolist()))
        return {w: i for i, w in enumerate(self.words)}, steps, self.fall.tolist(), self.link.tolist(), ends

    def find(self, text: str) -> set[int]:
        """Numbers of the phrases that stand in a text, in any case and not inside a word."""
        vocabulary, steps, fall, link, ends = self._ready
        out: set[int] = set()
        seen: set[int] = set()
        state = 0
        for w in cut(text):
            word = vocabulary.get(w)
            if word is None:
                state = 0
                continue
            while (step := steps.get(state << 32 | word)) is None and state:
                state = fall[state]
            state = at = step or 0
            while at and at not in seen:  # what ends here, and shorter phrases that end here too
                seen.add(at)
                if at in ends:
                    out.update(ends[at])
                at = link[at]
        return out


class Targets:
    """Phrases in an order of replacement, each with what replaces it, and which of them can matter for a text.

    Beside the phrases in a text these are the ones that may match where something was put in: such a match holds a word of
    what was put in, or the character at its start or end if that belongs to no word, or has no word at all. That is followed up
    through what those put in. Where what is put in can make one word with its neighbours, all phrases can matter.
    """

    def __init__(self, values: list[str], tokens: list[str]):
        self.automaton = Automaton(values)
        self.tokens = tokens
        self.traits: dict[str, list[str]] = {t: _traits(t) for t in dict.fromkeys(tokens)}
        named = {x for traits in self.traits.values() for x in traits}
        self.touched: dict[str, list[int]] = {}
        self.glue: set[int] = set()
        for k, (v, t) in enumerate(zip(values, tokens)):
            mine = set(cut(v))
            for x in (mine if any(map(_is_word, mine)) else mine | {""}) & named:
                self.touched.setdefault(x, []).append(k)
            if not t or any(_is_word(t[i]) and not _is_word(v[i]) for i in (0, -1) if v):
                self.glue.add(k)
        self.n = len(values)

    def matter(self, text: str, always: bool = False) -> list[int]:
        """``always``: as if anything might be put in, for when other phrases are kept elsewhere."""
        out = self.automaton.find(text)
        waiting, done = list(out), set()
        if always:
            out = out.union(*self.touched.values())
        while waiting:
            for x in self.traits[self.tokens[waiting.pop()]]:
                if x not in done:
                    done.add(x)
                    new = [k for k in self.touched.get(x, ()) if k not in out]
                    out.update(new)
                    waiting += new
        return list(range(self.n)) if self.glue and (always or self.glue & out) else sorted(out)


def _is_word(piece: str) -> bool:
    return len(piece) > 1 or piece == "_" or piece.isalpha() or piece.isdecimal()


def _traits(token: str) -> list[str]:
    pieces = cut(token)
    return sorted({"", *(w for w in pieces if _is_word(w)), *(w for w in (pieces[:1] + pieces[-1:]))})
