"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list decides how far text that is still to come can reach back into what has been read:
`sufficient_lookahead` follows chains of merges of rising rank, each of which can take a token from the one before,
and adds up how far they lead to the left. Tokens that end more than this before the end of the buffer are stable and
leave the transducer at once, so that a word of any length takes constant memory. Decoding feeds the bytes of each id to
an incremental UTF-8 state machine, which holds back unfinished sequences only.

Defined results: a null text is the empty text; an empty text has no ids; other columns are never read. Equal rows
give equal results, ids (also null or repeated ones) pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfix.llm.common import appended

#: Unicode's White_Space, which the vocabulary's \s means.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed values, of Unicode 16 as the library's regular expressions know it: letters and numbers that came after Unicode 15.1.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 "
    "13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Marks that came too late for the library's composition tables, which pass over nothing there; and the sign of a composition that they lack.
NEW_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF "
    "11930"
)
#: Capitals that came after Unicode 15.1 (the library's tables are of Unicode 17 here), and how far away or which their small letters are.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def code_points(ranges: str) -> set[int]:
    return {c for x in ranges.split() for c in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1)}


def _class(kind: str, new: str) -> str:
    """The members of a character class: those of the installed regex package, less what its newer tables add and with what they lack."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    want = {c for c in every if unicodedata.category(c)[0] == kind} | set(map(chr, code_points(new)))
    have = set(regex.findall(rf"\p{{{kind}}}", every))
    less = "".join(map(regex.escape, sorted(have - want)))
    return rf"[\p{{{kind}}}--[{less}]]" + "".join(sorted(want - have)) if less else rf"\p{{{kind}}}" + "".join(sorted(want - have))


LETTER, NUMBER = _class("L", NEW_LETTERS), _class("N", NEW_NUMBERS)
#: Fixed value: the vocabulary's pattern of words (contractions, letters, one digit, other signs).
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{WHITE}{LETTER}{NUMBER}]+")
#: The same for lower-case text of characters below 256, as one table of single characters (faster).
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-zA-Z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
SPACES = regex.compile(rf"[{WHITE}]+")
LETTERS, SIGNS = regex.compile(rf"(?V1)[{LETTER}]+"), regex.compile(rf"(?V1)[^{WHITE}{LETTER}{NUMBER}]+")
_MARKS = re.compile("([" + "".join(map(chr, sorted(code_points(NEW_MARKS)))) + "])")
_CAPITALS = re.compile("[" + "".join(map(chr, sorted(NEW_CAPITALS))) + "]")


def composed(text: str) -> str:
    """Composed as the library does it: nothing is composed or put in order across marks that its tables lack."""
    if text.isascii():
        return text
    if _MARKS.search(text):
        return "".join(unicodedata.normalize("NFC", x) for x in _MARKS.split(text))
    return unicodedata.normalize("NFC", text)


def lowered(text: str) -> str:
    """Lower case, letter by letter."""
    if text.isascii():
        return text.lower()
    if _CAPITALS.search(text):
        text = text.translate(NEW_CAPITALS)
    return text.replace("Σ", "σ").lower()


END = "</w>"
#: Characters of text that are read at once, words that stay memoised (and the most symbols of one), symbols between flushes.
PIECE, MEMO, MEMO_LEN, FLUSH = 1 << 16, 200_000, 32, 2048
SLICE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width=len) -> int:
    """Symbols before the end of what has been read from which on tokens may still change.

    What comes later first shows as a merge across the end, whose left part starts less than the longest token before
    it. A merge m that does or doesn't happen changes whether its left part and its product stand at its left edge;
    only merges of higher rank can notice. They go on to the left if their right part is one of these two, or stay at the
    edge if their left part is. The longest such walk, found from the last rank to the first, bounds the effect.
    """
    onward: dict[str, int] = {}  # of a token at the edge: how far a change of it can lead to the left
    reach = longest = 0
    for left, right in reversed(merges):
        product = left + right
        walk = max(onward.get(left, 0), onward.get(product, 0))
        reach, longest = max(reach, walk), max(longest, width(product))
        onward[right] = max(onward.get(right, 0), width(left) + walk)
        onward[left] = max(onward.get(left, 0), walk)
    return reach + longest


class Vocabulary:
    """The merge list, the ids and what follows from them, of a file in the tokenizers format with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.symbols = byte_symbols()
        self.lookahead = sufficient_lookahead(pairs, lambda t: len(t.removesuffix(END)))
        n = 1 + max([*self.ids.values(), *self.added.values()])
        self.strings = [""] * n
        for t, i in [*self.ids.items(), *self.added.items()]:
            self.strings[i] = t
        self.decimals = [str(i) for i in range(n)]
        self.shown = [t.encode() for t in self.strings]
        back = {c: b for b, c in enumerate(self.symbols)}
        special = set(self.added.values())
        self.raw = [t.encode() if i in special else bytes(back[c] for c in t.removesuffix(END) if c in back) + b" " * t.endswith(END) for i, t in enumerate(self.strings)]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        # for whole short words, resolved together: ids of bytes (plain, then at a word's end), and the merges by their pair
        self.byte_ids = np.array([[self.ids.get(c + e, -1) for c in self.symbols] for e in ("", END)], np.int64)
        made = [(self.ids[a], self.ids[b], r, self.ids[a + b]) for (a, b), r in self.ranks.items() if a in self.ids and b in self.ids and a + b in self.ids]
        self.span = n
        keys = np.array([a * n + b for a, b, _, _ in made], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([m[2] for m in made], np.int64)[order], 1 << 40)
        self.pair_products = np.append(np.array([m[3] for m in made], np.int64)[order], -1)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in pair_keys, or the last place."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merged_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Whole words of up to MEMO_LEN bytes, all merged at once: each round does the first merge of lowest rank in every word."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat, width = np.frombuffer(b"".join(data), np.uint8), int(sizes.max())
        cols = np.arange(width)
        row, col = np.repeat(np.arange(len(data)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((len(data), width + 1), -1, np.int64)
        ids[row, col] = self.byte_ids[(col == sizes[row] - 1).astype(np.int64), flat]
        at = np.full((len(data), width), len(self.pair_keys) - 1)
        pair = col < sizes[row] - 1
        at[row[pair], col[pair]] = self._lookup(ids[row[pair], col[pair]], ids[row[pair], col[pair] + 1])
        done, active = ids.copy(), np.arange(len(data))
        while len(active):
            ranks = self.pair_ranks[at]
            j = ranks.argmin(axis=1)
            rows = np.arange(len(active))
            go = ranks[rows, j] < 1 << 40
            if not go.all():
                done[active[~go]] = ids[~go]
                active, ids, at, j = active[go], ids[go], at[go], j[go]
                rows = np.arange(len(active))
                if not len(active):
                    break
            product = self.pair_products[at[rows, j]]
            take = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width)
            ids = np.concatenate([np.take_along_axis(ids, take, axis=1), np.full((len(active), 1), -1)], axis=1)
            ids[rows, j] = product
            at = np.take_along_axis(at, np.minimum(take, width - 1), axis=1)
            at[rows, j] = self._lookup(product, ids[rows, j + 1])
            left = np.maximum(j - 1, 0)
            at[rows, left] = np.where(j > 0, self._lookup(ids[rows, left], product), at[rows, left])
        lens = (done >= 0).sum(axis=1)
        flat_ids = done[done >= 0].tolist()
        ends = np.cumsum(lens).tolist()
        return [tuple(flat_ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merged(self, parts: list[str]) -> list[str]:
        """All merges, lowest rank first and from the left within a rank."""
        if len(parts) > 64:
            return self._merged_long(parts)
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, none))
            if best not in ranks:
                break
            left, right = best
            out, i, n = [], 0, len(parts)
            while i < n:
                if parts[i] == left and i + 1 < n and parts[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap over a linked list, for long runs."""
        held: list[str | None] = list(parts)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        ranks = self.ranks
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if held[i] is None or j < 0 or ranks.get((held[i], held[j])) != rank:
                continue
            held[i], held[j] = held[i] + held[j], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get((held[i], held[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get((held[before[i]], held[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in held if x is not None]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordTransducer:
    """One word, pushed in pieces: push() and finish() return the ids that have become stable."""

    def __init__(self, v: Vocabulary, flush: int = FLUSH):
        self.v, self.flush, self.held = v, flush, []

    def push(self, piece: str) -> list[int]:
        symbols = self.v.symbols
        self.held += [symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        out: list[int] = []
        while len(self.held) > self.v.lookahead + self.flush:
            out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens, at, out = self.v.merged(list(self.held)), 0, []
        bound = len(self.held) - self.v.lookahead
        for t in tokens:
            if at + len(t) > bound:
                break
            at += len(t)
            out.append(self.v.ids[t])
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, []
        if not held:
            return []
        held[-1] += END
        return [i for t in self.v.merged(held) if (i := self.v.ids.get(t)) is not None]


def _cut(text: str, start: int, limit: int) -> int:
    """Where a piece may end: before white space, or at worst before a character that no composition reaches back from."""
    end = start + limit
    if end >= len(text):
        return len(text)
    for i in range(end, start + limit // 2, -1):
        if text[i].isspace() and not "\x1c" <= text[i] <= "\x1f":
            return i
    for i in range(end, len(text)):
        c = text[i]
        if c.isascii() or "㐀" <= c <= "鿿" or (c.isspace() and unicodedata.combining(c) == 0):
            return i
    return len(text)


class Encoder:
    """Texts to ids in bounded pieces. Whole short words are memoised; longer ones stream through a WordTransducer."""

    def __init__(self, v: Vocabulary, piece: int = PIECE, flush: int = FLUSH):
        self.v, self.piece, self.flush, self.memo = v, piece, flush, {}

    def word(self, w: str) -> Iterable[int]:
        ids = self.memo.get(w)
        if ids is None:
            t = WordTransducer(self.v, self.flush)
            ids = t.push(w) + t.finish()
        return ids

    def learn(self, words: set[str]) -> None:
        """Memoises the short ones of these words."""
        fresh = [w for w in words - self.memo.keys() if len(w) <= MEMO_LEN // 2 or len(w.encode("utf-8", "surrogatepass")) <= MEMO_LEN]
        if not fresh:
            return
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = [w for w in words if len(w.encode("utf-8", "surrogatepass")) <= MEMO_LEN]
        fresh.sort(key=len)  # words of like length share a matrix
        for start in range(0, len(fresh), 1 << 12):
            part = fresh[start : start + (1 << 12)]
            self.memo.update(zip(part, self.v.merged_words(part)))

    def whole(self, text: str) -> list[str] | None:
        """The words of a text that is read in one piece and holds no added token; None for any other."""
        if len(text) > self.piece or (self.v.split_added is not None and "<" in text and self.v.split_added.search(text)):
            return None
        low = lowered(composed(text))
        try:
            low.encode("latin-1")
        except UnicodeEncodeError:
            return WORDS.findall(low)
        return LATIN_WORDS.findall(low)

    def slice(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its lists of ids; the words of all are learned together."""
        split = [self.whole(t) for t in texts]
        self.learn(set().union(*(w for w in split if w is not None)))
        get = self.memo.get
        for text, words in zip(texts, split):
            if words is None:
                yield self.pieces(text)
            else:
                found = list(map(get, words))
                if None in found:
                    found = map(self.word, words)
                yield iter([list(itertools.chain.from_iterable(found))])

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Lists of ids whose concatenation encodes the text."""
        if self.v.split_added is None or "<" not in text:
            yield from self._segment(text)
            return
        for k, part in enumerate(self.v.split_added.split(text)):
            if k % 2:
                yield [self.v.added[part]]
            elif part:
                yield from self._segment(part)

    def _segment(self, text: str) -> Iterator[list[int]]:
        at, carried, open_run, word = 0, "", None, self.word
        while at < len(text):
            to = _cut(text, at, self.piece)
            raw, at = text[at:to], to
            ends = at >= len(text) or bool(SPACES.match(text[at]))  # no word goes on beyond this piece
            s = carried + lowered(SPACES.sub(" ", composed(raw)))
            carried, out, start = "", [], 0
            if open_run:
                kind, transducer = open_run
                m = kind.match(s)
                start = m.end() if m else 0
                out += transducer.push(s[:start])
                if start == len(s) and not ends:
                    yield out
                    continue
                out += transducer.finish()
                open_run = None
            found = WORDS.findall(s, start)
            if found and not ends and s.endswith(found[-1]):
                last = found.pop()
                kind = LETTERS if LETTERS.match(last) else SIGNS
                if len(last) < 16 or not kind.fullmatch(last):
                    carried = last
                    if found and found[-1][-1] == "'" and s.endswith(found[-1] + last):  # may become a contraction
                        carried = found.pop() + last
                else:
                    transducer = WordTransducer(self.v, self.flush)
                    self.learn(set(found))
                    for w in found:
                        out += word(w)
                    found = []
                    out += transducer.push(last)
                    open_run = (kind, transducer)
            self.learn(set(found))
            for w in found:
                out += word(w)
            yield out
        if open_run:
            yield open_run[1].finish()
        elif carried:
            yield [i for w in WORDS.findall(carried) for i in word(w)]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text or "") for i in ids]


class Decoder:
    """Ids to text, a piece at a time. form "shown": the vocabulary's strings with a space between, as the tokenizers library
    decodes a file that names no decoder; form "bytes": the bytes that the tokens stand for, word ends as spaces."""

    def __init__(self, v: Vocabulary, form: str = "shown"):
        self.of, self.between = (v.shown, b" ") if form == "shown" else (v.raw, b"")
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.of.__getitem__, ids))
        if not data and not ids:
            return ""
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        self.begun = False
        return self.machine.decode(b"", final=True)


def appended_ids(df: DataFrame, vocabulary_path: str, text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """All columns of df, and of each text encoded, and its ids decoded again: n_tokens, ids_sha256, decoded_sha256 (and ids, if kept)."""
    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        added = added.add("ids", T.ArrayType(T.IntegerType()))

    def make():
        v = vocabulary(vocabulary_path)
        enc = Encoder(v)

        def each(column: pa.Array) -> list[pa.Array]:
            counts, shas, texts, kept = [], [], [], []
            for lists in enc.slice([t or "" for t in column.to_pylist()]):
                h, d, dec, n, own = hashlib.sha256(), hashlib.sha256(), Decoder(v), 0, []
                for ids in lists:
                    if ids:
                        h.update(((" " if n else "") + " ".join(map(v.decimals.__getitem__, ids))).encode())
                        d.update(dec.push(ids).encode())
                        n += len(ids)
                        if keep_ids:
                            own += ids
                d.update(dec.finish().encode())
                counts.append(n)
                shas.append(h.hexdigest())
                texts.append(d.hexdigest())
                kept.append(own)
            return [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])]

        return each

    return appended(df, text_column, make, added, SLICE)


def encode_decode(df: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each row's id, n_tokens, ids_sha256, decoded_sha256 (and ids, if kept)."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return appended_ids(rows, vocabulary_path, "text", keep_ids).drop("text").withColumnRenamed("id", id_column)
