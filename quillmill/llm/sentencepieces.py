"""SentencePiece encoding by suffix-array matching, and decoding.

The words of a batch that the worker has not met yet are laid end to end as one text. A suffix array of
it, sorted as deep as the longest piece, lets one vectorised binary search per piece find the range of
suffixes that start with the piece: its occurrences. They become edges, sorted by position, and are
relaxed word by word: for a unigram model by the best sum of scores from left to right, for a BPE model
by taking, among edges that join two neighbouring pieces, the best score first and the leftmost of equals.
Characters that no piece covers become bytes where the model has byte pieces, else the unknown piece.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.functions.once import once
from quillmill.llm.shared import small_batches

SPACE = "▁"
#: Words of more characters are merged one by one with a heap.
LONG = 60
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """The vocabulary of a model file, and what encoding and decoding need of it."""

    def __init__(self, path: str, cache_size: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        score = [model.get_score(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if byte[i]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        usable = [i for i in range(size) if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bpe = _is_bpe(path)
        self._start([self.text[i] for i in usable], [score[i] for i in usable], usable, cache_size)

    @classmethod
    def of(cls, pieces: dict[str, float], bpe: bool, unknown: int = 0) -> Pieces:
        """A vocabulary given in full, for tests: ids count from 1 in the order given."""
        self = cls.__new__(cls)
        self.normalize, self.text, self.unknown, self.bpe = lambda t: SPACE + t.replace(" ", SPACE), ["<unk>", *pieces], unknown, bpe
        self.bytes, self.byte_of, self.silent = {}, {}, set()
        self._start(list(pieces), list(pieces.values()), list(range(1, len(pieces) + 1)), 1000)
        return self

    def _start(self, texts: list[str], scores: list[float], ids: list[int], cache_size: int) -> None:
        self.cache_size, self.words = cache_size, {}
        self.lone = {t: i for t, i in zip(texts, ids) if len(t) == 1}
        self.depth = max(map(len, texts), default=1)
        self.score = dict(zip(ids, scores))
        #: equal scores have equal ranks, the best score rank 0
        self.rank_of = np.zeros(max(ids, default=0) + 1, np.int64)
        self.rank_of[ids] = np.unique(-np.array(scores), return_inverse=True)[1]
        self.order = np.array(ids)
        self.lengths = np.array([len(t) for t in texts])
        self.codes = np.zeros((len(texts), self.depth), np.int64)
        for k, t in enumerate(texts):
            self.codes[k, : len(t)] = [ord(c) + 1 for c in t]
        pairs = {x for t in texts for x in zip(t, t[1:])}
        #: behind a letter these are a certain border, as no piece holds such a pair
        self.tails = "".join(c for c in ".,!?;:*#$%&|" if not any(a.isalpha() and b == c for a, b in pairs))
        self.newline_alone = not any("\n" in x for x in pairs)
        self.parts: dict[str, bytes] = {}
        self._common(texts, ids)
        #: a border inside a run of pieces is one before a space mark unless a piece has one inside
        self.by_word = all(SPACE not in t[1:] or not t.strip(SPACE) for t in texts)

    # ---- encoding

    def chunks(self, normal: str) -> list[str]:
        if not self.by_word:
            return [normal] if normal else []
        if normal.startswith(SPACE) and SPACE * 2 not in normal:
            return normal.split(SPACE)[1:]
        return _CHUNK.findall(normal)

    def encode(self, texts: list[str | None], at_once: int = 2_000_000):
        """Yields per text its ids as packed little-endian unsigned 32-bit integers."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(t or "")
            if size >= at_once:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut, marked = [], []
        for t in texts:
            normal = self.normalize(t) if t else ""
            plain = self.by_word and normal.startswith(SPACE) and SPACE * 2 not in normal
            cut.append(self.chunks(normal))
            marked.append(plain)
        if len(self.words) > self.cache_size:
            self.words.clear()
        fresh: set[str] = set()
        for c, plain in zip(cut, marked):
            fresh.update(c if plain else map(_odd, c))
        self._learn([w for w in fresh if w not in self.words])
        word = self.words.__getitem__
        return [b"".join(map(word, c if plain else map(_odd, c))) for c, plain in zip(cut, marked)]

    def _common(self, texts: list[str], ids: list[int]) -> None:
        """Numbers of one byte for the characters of most pieces, and the search keys of the pieces made of these alone."""
        often: dict[str, int] = {}
        for t in texts:
            for c in t:
                often[c] = often.get(c, 0) + 1
        chosen = sorted(often, key=lambda c: (-often[c], c))[:250]
        self.number = np.full(0x110002, 251, np.uint8)  # 251: any other character
        self.number[0] = 0
        for k, c in enumerate(chosen, 1):
            self.number[ord(c) + 1] = k
        codes = np.where(self.codes > 0, self.number[self.codes], 0)
        whole = np.flatnonzero(~(codes == 251).any(1) & (self.lengths <= 16))
        self.all_short = bool((self.lengths <= 16).all())
        self.c_length, self.c_id = self.lengths[whole], np.array(ids)[whole] if len(whole) else np.zeros(0, np.int64)
        padded = np.zeros((len(whole), 16), np.uint8)
        wide = min(16, codes.shape[1])
        padded[:, :wide] = codes[whole][:, :wide]
        inside = np.arange(16) < self.c_length[:, None]
        key = lambda x: np.ascontiguousarray(x).view(">u8").astype(np.uint64)
        low, high = key(padded), key(np.where(inside, padded, 255))
        self.c_low, self.c_high, self.c_low2, self.c_high2 = low[:, 0].copy(), high[:, 0].copy(), low[:, 1].copy(), high[:, 1].copy()

    def _learn(self, words: list[str]) -> None:
        """``words``: as after their space mark, or a whole chunk behind ``\\0``.

        A word is cut at certain borders, so that its letters are looked up whatever stands behind them.
        """
        if len(self.parts) > self.cache_size:
            self.parts.clear()
        cut: list[list[str]] = []
        fresh: set[str] = set()
        tails = self.tails
        for w in words:
            word = w[1:] if w[:1] == "\0" else SPACE + w
            if self.newline_alone and "\n" in word:
                out = []
                for k, line in enumerate(word.split("\n")):
                    if k:
                        out.append("\n")
                    if line:
                        out += self._tail(line, tails)
            else:
                out = self._tail(word, tails)
            cut.append(out)
            fresh.update(out)
        new = [x for x in fresh if x not in self.parts]
        for at in range(0, len(new), 8_000):
            part = new[at : at + 8_000]
            self.parts.update(zip(part, self.match(part)))
        ready = self.parts.__getitem__
        for w, parts in zip(words, cut):
            self.words[w] = ready(parts[0]) if len(parts) == 1 else b"".join(map(ready, parts))

    @staticmethod
    def _tail(word: str, tails: str) -> list[str]:
        core = word.rstrip(tails)
        if len(core) == len(word) or not core or not core[-1].isalpha():
            return [word]
        return [core, word[len(core) :]]

    def match(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        text = "\0".join(words) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        bounds = np.cumsum([len(w) + 1 for w in words]) - 1
        code[bounds] = 0  # no character of a piece
        small = self.number[code]
        start, end, piece = self._edges_common(small) if self.all_short and not (small == 251).any() else self._edges(code)
        long = np.diff(bounds, prepend=-1) > LONG
        out: list[bytes | None] = [None] * len(words)
        one_by_one = range(len(words))
        if self.bpe:
            self._merge(words, bounds, long, start, end, piece, out)
            one_by_one = np.flatnonzero(long).tolist()
        if len(one_by_one):
            order = np.lexsort((end, start))
            start, end, piece = start[order], end[order], piece[order]
            relax = self._bpe if self.bpe else self._unigram
            for k in one_by_one:
                first = int(bounds[k - 1]) + 1 if k else 0
                at, upto = np.searchsorted(start, [first, bounds[k]])
                edges = zip((start[at:upto] - first).tolist(), (end[at:upto] - first).tolist(), piece[at:upto].tolist())
                out[k] = array("I", relax(words[k], list(edges))).tobytes()
        return out

    def _merge(self, words, bounds, skip, start, end, piece, out) -> None:
        """BPE of all words at once: in each round every word takes its best edge between two neighbours, the leftmost of equals."""
        n = int(bounds[-1]) + 1
        found = np.full((n, self.depth + 1), -1, np.int32)
        found[start, end - start] = piece
        word = np.repeat(np.arange(len(words)), np.diff(bounds, prepend=-1))
        live = np.ones(n, bool)
        live[bounds] = False
        live &= ~skip[word]
        begin = np.flatnonzero(live)
        size = np.ones(len(begin), np.int64)
        owner = word[begin]
        never = np.int64(1) << 40
        done = []
        while len(begin):
            both = size[:-1] + size[1:]
            joins = (owner[:-1] == owner[1:]) & (both <= self.depth)
            edge = np.full(len(begin), -1, np.int64)
            at = np.flatnonzero(joins)
            edge[at] = found[begin[at], both[at]]
            key = np.where(edge >= 0, self.rank_of[edge], never) * n + np.arange(len(begin))
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(key, heads)
            over = best >= never * n
            if over.any():
                gone = np.repeat(over, np.diff(np.append(heads, len(begin))))
                done.append((begin[gone], size[gone]))
                if over.all():
                    break
            at = best[~over] % n
            size[at] += size[at + 1]
            keep = np.ones(len(begin), bool)
            keep[at + 1] = False
            if over.any():
                keep &= ~gone
            begin, size, owner = begin[keep], size[keep], owner[keep]
        if not done:
            return
        begin, size = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(begin)
        begin, size = begin[order], size[order]
        owner, ids = word[begin], found[begin, size]
        cut = np.searchsorted(owner, np.arange(len(words) + 1))
        packed = ids.astype("<u4").tobytes()
        bare = np.zeros(len(words), bool)
        bare[owner[ids < 0]] = True
        limits = (4 * cut).tolist()
        for k in range(len(words)):
            if not skip[k]:
                out[k] = packed[limits[k] : limits[k + 1]]
        for k in np.flatnonzero(bare).tolist():
            first = int(bounds[k - 1]) + 1 if k else 0
            at = slice(cut[k], cut[k + 1])
            s = (begin[at] - first).tolist()
            parts = zip(s, [x + y for x, y in zip(s, size[at].tolist())], ids[at].tolist())
            out[k] = array("I", self._plain(words[k], list(parts))).tobytes()

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces: start, end, id.

        The suffix array is sorted as deep as the longest piece. Characters are numbered anew, so several fit
        into one sort key, and so do those of the pieces; a search for a piece is one for its keys.
        """
        n = len(code)
        # numbers from 1 for the characters that occur; 0 ends a word and fills keys below, the top value above
        there = np.zeros(max(int(code.max()), int(self.codes.max(initial=0))) + 1, bool)
        there[code] = True
        there[0] = False
        renumber = np.cumsum(there)
        kinds = int(renumber[-1])
        bits = next(b for b in (8, 16, 21) if kinds + 2 < 1 << b)
        width = 64 // bits
        number = np.where(there, renumber, 0).astype(np.uint64)
        text = np.concatenate([number[code], np.zeros(width * -(-self.depth // width), np.uint64)])

        def keys(rows: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rows), np.uint64)
            for column in range(rows.shape[1]):
                out = (out << np.uint64(bits)) | rows[:, column]
            return out

        levels = -(-self.depth // width)
        windows = np.lib.stride_tricks.sliding_window_view(text, width)
        first = keys(windows[:n])
        packed = [first] + [keys(windows[level * width : level * width + n]) for level in range(1, levels)]
        suffix = np.lexsort(packed[::-1]) if levels > 1 else np.argsort(first, kind="stable")
        packed = [p[suffix] for p in packed]
        # a piece with a character that does not occur has no occurrence
        codes = np.where(self.codes > 0, number[np.minimum(self.codes, len(number) - 1)], 0)
        possible = np.flatnonzero(((codes > 0) == (self.codes > 0)).all(1))
        lengths = self.lengths[possible]
        top = np.uint64((1 << bits) - 1)
        padded = np.zeros((len(possible), levels * width), np.uint64)
        padded[:, : self.depth] = codes[possible]
        inside = np.arange(levels * width) < lengths[:, None]
        lows, highs = np.where(inside, padded, 0), np.where(inside, padded, top)
        low = np.searchsorted(packed[0], keys(lows[:, :width]), "left")
        high = np.searchsorted(packed[0], keys(highs[:, :width]), "right")
        for level in range(1, levels):
            # only longer pieces look further, each inside the range of its first keys
            deep = np.flatnonzero((lengths > level * width) & (low < high))
            part = slice(level * width, (level + 1) * width)
            below, above = keys(lows[deep, part]), keys(highs[deep, part])
            for k, x, y in zip(deep.tolist(), below, above):
                run = packed[level][low[k] : high[k]]
                low[k], high[k] = low[k] + np.searchsorted(run, x, "left"), low[k] + np.searchsorted(run, y, "right")
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        start = suffix[place]
        return start, start + lengths[which], self.order[possible][which]

    def _edges_common(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a text of one-byte numbers, with the keys of the pieces at hand."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(24, np.uint8)])
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8]).view(">u8").ravel().astype(np.uint64)
        first, second = keys[:n], keys[8 : n + 8]
        suffix = np.argsort(first)
        ordered = first[suffix]
        # equal first halves are put in order by their second halves
        tied = np.zeros(n, bool)
        same = ordered[1:] == ordered[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        suffix[at] = suffix[at][np.lexsort((second[suffix[at]], ordered[at]))]
        low, high = np.searchsorted(ordered, self.c_low, "left"), np.searchsorted(ordered, self.c_high, "right")
        deep = np.flatnonzero((self.c_length > 8) & (low < high))
        for k in deep.tolist():
            run = second[suffix[low[k] : high[k]]]
            low[k], high[k] = low[k] + np.searchsorted(run, self.c_low2[k], "left"), low[k] + np.searchsorted(run, self.c_high2[k], "right")
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        start = suffix[place]
        return start, start + self.c_length[which], self.c_id[which]

    def _plain(self, word: str, parts: list[tuple[int, int, int]]) -> list[int]:
        """Ids of parts (start, end, piece or -1); what has no piece becomes bytes or unknown."""
        out, gap = [], False
        for s, e, p in parts:
            if p >= 0:
                out.append(p)
                gap = False
            elif self.bytes:
                out += [self.bytes[b] for b in word[s:e].encode()]
            elif not gap:  # a run of unknown characters is one unknown piece
                out.append(self.unknown)
                gap = True
        return out

    def _unigram(self, word: str, edges: list[tuple[int, int, int]]) -> list[int]:
        n, worst = len(word), min(self.score.values(), default=0.0) - 10
        best, back = [-np.inf] * (n + 1), [None] * (n + 1)
        best[0], at = 0.0, 0
        for s in range(n):
            single = False
            while at < len(edges) and edges[at][0] == s:
                _, e, p = edges[at]
                at += 1
                single |= e == s + 1
                v = best[s] + self.score[p]
                if v > best[e]:
                    best[e], back[e] = v, (s, e, p)
            if not single and best[s] + worst > best[s + 1]:
                best[s + 1], back[s + 1] = best[s] + worst, (s, s + 1, -1)
        parts = []
        while n:
            parts.append(back[n])
            n = back[n][0]
        return self._plain(word, parts[::-1])

    def _bpe(self, word: str, edges: list[tuple[int, int, int]]) -> list[int]:
        n = len(word)
        joined = {}
        for s, e, p in edges:
            joined[s, e] = p
        score = self.score
        right, left = list(range(1, n + 1)), list(range(-1, n))  # borders around each piece by its start
        heap = [(-score[joined[s, s + 2]], s, s + 1, s + 2) for s in range(n - 1) if (s, s + 2) in joined]
        heapq.heapify(heap)
        while heap:
            _, s, m, e = heapq.heappop(heap)
            if right[s] != m or m >= n or right[m] != e:
                continue
            right[s] = e
            right[m] = -1
            if e < n:
                left[e] = s
            if s and (p := left[s]) >= 0 and (k := joined.get((p, e))) is not None:
                heapq.heappush(heap, (-score[k], p, s, e))
            if e < n and (k := joined.get((s, right[e]))) is not None:
                heapq.heappush(heap, (-score[k], s, e, right[e]))
        parts, s = [], 0
        while s < n:
            parts.append((s, right[s], joined.get((s, right[s]), -1)))
            s = right[s]
        return self._plain(word, parts)

    # ---- decoding

    def decode(self, ids) -> str:
        """Pieces end to end; bytes that are no character become U+FFFD each; marks become spaces, the first one goes."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.text[i])
        if run:
            out.append(_characters(bytes(run)))
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")


def _odd(chunk: str) -> str:
    return "\0" + chunk


def _characters(run: bytes) -> str:
    """Bytes as UTF-8, with one replacement character for every byte outside a whole character."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _is_bpe(path: str) -> bool:
    """Field 3 of the trainer's part (field 2) of the model file: 2 stands for BPE, 1, the default, for unigram."""
    with open(path, "rb") as f:
        data = f.read()

    def fields(buf: bytes):
        at = 0

        def varint():
            nonlocal at
            value = shift = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(buf):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                size = varint()
                yield tag >> 3, buf[at : at + size]
                at += size
            else:
                at += {1: 8, 5: 4}[kind]

    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1) == 2


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per Python worker and model."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(df, model_path: str, text_col: str = "text", ids_col: str = "ids"):
    """``df`` with the ids of the whole text as packed little-endian unsigned 32-bit integers (binary).

    A null or empty text has no ids. Rows and all other columns stay; a column named like ``ids_col`` is replaced.
    """

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(pieces(model_path).encode(texts.to_pylist())), pa.binary())

    small_batches(df.sparkSession)
    # computed once, though a decoder and a checksum may both use the ids
    return once(df.withColumn(ids_col, run(F.col(text_col))), **{ids_col: F.col(ids_col)})


def decode(df, model_path: str, ids_col: str = "ids", text_col: str = "decoded"):
    """``df`` with the text of the packed ``ids_col``; null ids give an empty text. Rows and other columns stay."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        p = pieces(model_path)
        return pa.array([p.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in ids.to_pylist()], pa.string())

    return df.withColumn(text_col, run(F.col(ids_col)))
