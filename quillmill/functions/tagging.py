"""Labelling of token sequences: a linear-chain model over hashed features, its perceptron steps and Viterbi decoding.

Tags are those of persons and places: outside, begin and inside of each. All weights are whole numbers, so sums do not
depend on their order and a model is the same wherever it is fitted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

TAGS = ("O", "B-PERSON", "I-PERSON", "B-LOCATION", "I-LOCATION")
KINDS = ("PERSON", "LOCATION")
#: Rows of the weights; features of one hash share a row.
BUCKETS = 1 << 16
#: Words around a token whose features count.
AROUND = (-2, -1, 0, 1, 2)
TOKEN = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]|\n")
#: A full stop behind these ends no sentence.
SHORT = frozenset("mr mrs ms miss dr prof hon jr sr st no vs v inc co ltd vol ave rd".split())
SHAPES = ("border", "lower", "Title", "UPPER", "Initial", "mixed", "number", "stop", "comma", "mark")
#: Forbidden steps weigh so much less than any sum of weights.
NEVER = -(1 << 50)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in TOKEN.finditer(text))


def shape(word: str) -> int:
    if word == "":
        return 0
    if word.isalpha() or "'" in word or "’" in word:
        if word.islower():
            return 1
        if len(word) == 1:
            return 4
        if word.istitle() or (word[0].isupper() and ("'" in word or "’" in word)):
            return 2
        return 3 if word.isupper() else 5
    if word.isdigit():
        return 6
    return {".": 7, ",": 8}.get(word, 9 if len(word) == 1 else 5)


def features(word: str) -> list[str]:
    """What is known of a word by itself; an empty one is the border of a sentence."""
    low = word.lower()
    return [f"w={low}", f"s={SHAPES[shape(word)]}", f"p={low[:3]}", f"e={low[-3:]}", f"f={low[-2:]}"]


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@lru_cache(maxsize=100_000)
def word_rows(word: str) -> list[list[int]]:
    """Rows of the weights for a word, at each place in :data:`AROUND`."""
    mine = features(word)
    return [[_bucket(f"{at}{f}") for f in mine] for at in AROUND]


def shape_row(before: int, here: int, behind: int) -> int:
    return _bucket(f"{SHAPES[before]} {SHAPES[here]} {SHAPES[behind]}")


def sentence_rows(words: list[str]) -> list[list[int]]:
    """Rows of the weights for each token of a sentence."""
    padded = ["", "", *words, "", ""]
    rows, shapes = [word_rows(w) for w in padded], [shape(w) for w in padded]
    out = []
    for i in range(2, len(words) + 2):
        mine = [r for k, at in enumerate(AROUND) for r in rows[i + at][k]]
        out.append([*mine, shape_row(shapes[i - 1], shapes[i], shapes[i + 1])])
    return out


def steps() -> np.ndarray:
    """``[from, to]`` before anything is learnt, the last row from the start; inside follows its own kind only."""
    out = np.zeros((len(TAGS) + 1, len(TAGS)), dtype=np.int64)
    for i, a in enumerate((*TAGS, "O")):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[1:] != b[1:]:
                out[i, j] = NEVER
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The tags of the best path of each sequence; ``scores`` has the sequences one behind the other.

    All sequences move on together, longest first, so the number of array operations is the length of the longest.
    """
    n, k = scores.shape
    tags = np.zeros(n, dtype=np.int64)
    if not n:
        return tags
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    best = scores[begins[: active[0]]] + step[k]
    back, last = [], np.zeros((len(lengths), k), dtype=np.int64)
    last[: active[0]] = best
    for t in range(1, longest):
        m = active[t]
        ways = best[:m, :, None] + step[:k]
        back.append(ways.argmax(axis=1).astype(np.int8))
        best = np.take_along_axis(ways, back[-1][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[begins[:m] + t]
        last[:m] = best
    here = last.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        tags[begins[:m] + t] = here[:m]
        if t:
            here[:m] = back[t - 1][np.arange(m), here[:m]]
    return tags


class Model:
    """Weights of rows and of steps from tag to tag."""

    def __init__(self, rows: np.ndarray, step: np.ndarray):
        self.rows, self.step = rows, step
        self._forget()
        self.triples = np.stack([self.rows[shape_row(a, b, c)] for a in range(10) for b in range(10) for c in range(10)])

    def __getstate__(self):
        return self.rows, self.step

    def __setstate__(self, state):
        self.__init__(*state)

    #: Words that a worker remembers (about 400 bytes each); a full memory starts anew.
    MEMORY = 300_000
    #: Tokens tagged at once, which bounds what a worker holds however many texts it gets; a longer sentence goes by itself.
    AT_ONCE = 100_000

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.shapes = np.zeros((1024, len(AROUND), len(TAGS)), np.int64), np.zeros(1024, np.int64)

    def _places(self, words: list[str]) -> np.ndarray:
        """Numbers of words, whose summed weights at each place around are in ``table``."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.MEMORY:
            self._forget()
            new = set(words)
        if new:
            at, end = len(self.known), len(self.known) + len(new)
            listed = sorted(new)
            if end > len(self.table):  # at least twice as large, so that a growing table is seldom copied
                room = max(end, 2 * len(self.table)) - len(self.table)
                self.table, self.shapes = (np.concatenate([old, np.zeros((room, *old.shape[1:]), np.int64)]) for old in (self.table, self.shapes))
            # the memory of word_rows is for the fit; here a word is asked for once
            self.table[at:end] = self.rows[np.array([word_rows.__wrapped__(w) for w in listed])].sum(axis=2)
            self.shapes[at:end] = [shape(w) for w in listed]
            self.known |= {w: at + i for i, w in enumerate(listed)}
        return np.array([self.known[w] for w in words], dtype=np.int64)

    def scores(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Scores of all tags for the tokens of sentences, one sentence behind the other."""
        # two borders between any two sentences
        at = np.arange(len(words)) + 2 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        numbers = self._places([*words, ""])
        ids = np.full(len(words) + 2 * (len(lengths) + 1), numbers[-1])
        ids[at] = numbers[:-1]
        out = sum(self.table[ids[at + o], k] for k, o in enumerate(AROUND))
        s = self.shapes[ids]
        return out + self.triples[100 * s[at - 1] + 10 * s[at] + s[at + 1]]

    def tag(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        return viterbi(self.scores(words, lengths), lengths, self.step)

    def entities(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """``(kind, start, end)`` of each text's entities; sentences of about ``AT_ONCE`` tokens are tagged together."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        words, places, lengths, owners = [], [], [], []

        def flush() -> None:
            if not words:
                return
            counts = np.array(lengths)
            tags = self.tag(words, counts)
            owner = np.repeat(np.array(owners), counts)
            for i in np.flatnonzero(tags % 2 == 1).tolist():  # where an entity begins
                j = i + 1
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                out[owner[i]].append((KINDS[tags[i] // 2], places[i][0], places[j - 1][1]))
            for full in (words, places, lengths, owners):
                full.clear()

        for k, text in enumerate(texts):
            for sentence in sentences(text or ""):
                if len(words) + len(sentence) > self.AT_ONCE:
                    flush()
                words += [text[a:b] for a, b in sentence]
                places += sentence
                lengths.append(len(sentence))
                owners.append(k)
        flush()
        return out


def sentences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans by sentence: to the end of a line, or behind a mark that ends one and is followed by white space."""
    mine = []
    for a, b in tokens(text):
        if text[a] == "\n":
            if mine:
                yield mine
            mine = []
            continue
        mine.append((a, b))
        if b - a == 1 and text[a] in ".!?" and (b == len(text) or text[b].isspace()):
            word = text[slice(*mine[-2])] if len(mine) > 1 else ""
            if text[a] != "." or (word.lower() not in SHORT and not (len(word) == 1 and word.isupper())):
                yield mine
                mine = []
    if mine:
        yield mine


def learn(lines: list[tuple[list[str], list[str]]], rows: np.ndarray, step: np.ndarray, unit: int) -> tuple[dict, dict, int]:
    """One pass of the structured perceptron from given weights: what changed, the sum over all lines of what had changed, and the lines.

    Keys are (row, tag), and (-1 - from, to) for steps.
    """
    rows, step = rows.copy(), step.copy()
    change: dict[tuple[int, int], int] = {}
    late: dict[tuple[int, int], int] = {}
    for n, (words, named) in enumerate(lines):
        mine = sentence_rows(words)
        gold = [TAGS.index(t) for t in named]
        length = np.array([len(words)])
        guess = viterbi(np.stack([rows[r].sum(axis=0) for r in mine]), length, step).tolist()
        if guess == gold:
            continue
        before = (len(TAGS), len(TAGS))
        for r, pair in zip(mine, zip(gold, guess)):
            for b, t, sign in ((before[0], pair[0], unit), (before[1], pair[1], -unit)):
                keys = [(-1 - b, t)]
                step[b, t] += sign
                if pair[0] != pair[1]:
                    keys += [(x, t) for x in r]
                    np.add.at(rows, (r, t), sign)
                for key in keys:
                    change[key] = change.get(key, 0) + sign
                    late[key] = late.get(key, 0) + n * sign
            before = pair
    total = len(lines)
    return change, {k: total * v - late[k] for k, v in change.items()}, total
