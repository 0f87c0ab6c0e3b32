"""Byte-level BPE with a minimal acyclic transducer for frequent words.

The vocabulary file of a public tokenizer is a parameter and is only read.  The
words (pre-tokens) most frequent in the corpus are compiled, with their ids,
into an automaton that shares prefixes and suffixes (Daciuk et al. 2000) and
whose arcs carry counts that sum to a word's number: a transducer from words to
rows of an id table.  The compiled form is a flat file that every worker maps
into memory.  Words outside it are merged exactly; results do not depend on the
lexicon.

Texts are encoded in groups of bounded size.  A group's new chunks (what stands
between two spaces) are cut into words, their distinct words walk through the
transducer a letter of all at a time, the unseen ones are merged a round of
merges of all at a time, and ids are put together by position in numpy.  A long
text is cut where a pre-token must start, so no group grows with a text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import tempfile
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEXICON_WORDS = 100_000  # bound on the broadcast lexicon
MEMO_CHUNKS = 400_000  # chunks after which a worker's memo starts anew
MATRIX_WORD, MATRIX_ROWS = 32, 8192  # bytes and words of a matrix of merges
TOGETHER, PIECE = 4_000_000, 500_000  # code points that are encoded together, and of a piece of a long text
LONG_WORD = 128  # bytes from which merges use a heap
COUNTED_AT_ONCE = 200_000  # words a task counts before it passes them on

# White space as the tokenizer's patterns know it.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the same where \s has that meaning
_POINTS = frozenset(".,;:!?")
_CUT = regex.compile(rf"\x20(?=[^{SPACE}])")  # a pre-token starts here


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file, by rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `sizes` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Numbers:
    """A number for each key, looked up many at a time; `none` for other keys.

    Open addressing with linear probing; keys are unlike and not negative.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int) -> None:
        self.none, self.shift = none, np.uint64(64 - max(4, int(len(keys) * 8).bit_length()))
        n = 1 << (64 - int(self.shift))
        self.mask = n - 1
        self.keys, self.values = np.full(n, -1, np.int64), np.full(n, none, np.int32)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(self.none))
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class Strings:
    """Byte strings by number, joined many at a time."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        each = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        self.sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings of the numbers in a row, and where each ends."""
        sizes = self.sizes[numbers]
        return memoryview(self.flat[ranges(self.starts[numbers], sizes)]), np.cumsum(sizes)


class Vocabulary:
    """Tokens, merges and special tokens of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        ids = told["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: as_bytes(t) for t, i in ids.items() if all(c in letters for c in t)}
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        self.rank: dict[int, int] = {}  # pair of ids -> rank
        self.made: list[int] = []  # rank -> id
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(ids[left] << 20 | ids[right], rank)
            self.made.append(ids[left + right])
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        self.pair_ranks = Numbers(pairs, np.fromiter(self.rank.values(), np.int64, len(pairs)), len(self.made))
        self.first_ids, self.made_ids = np.array(self.byte_id, np.int32), np.array(self.made, np.int32)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode("utf-8")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        first = self.first_ids.astype(np.int64)
        self.byte_ranks = self.pair_ranks.get((first[:, None] << 20 | first).reshape(-1)).astype(np.int32)  # of the pairs of bytes
        self.told = Strings({i: b",%d" % i for i in ids.values()} | {i: b",%d" % i for i in self.special.values()})
        self.decoded = Strings(self.bytes_of)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the best-ranked pair, leftmost first, until none."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        ids = [self.byte_id[b] for b in word]
        get, none, made = self.rank.get, len(self.made), self.made
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            new = made[best]
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return ids

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`merge` of each word: all ids, and where each word's start and how many they are.

        Words of like length share a matrix of ids (a column a word) and one of
        pair ranks; in a round each column merges its best-ranked, leftmost pair.
        """
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, at = [], 0

        def add(which: np.ndarray, ids: np.ndarray) -> None:
            nonlocal at
            starts[which] = at + np.arange(len(which)) * len(ids)
            sizes[which] = len(ids)
            flat.append(ids.T.reshape(-1))
            at += ids.size

        for k in np.flatnonzero(lengths > MATRIX_WORD).tolist():
            add(np.array([k]), np.array(self.merge(words[k]), np.int32)[:, None])
        for n in range(1, MATRIX_WORD + 1):
            rows = np.flatnonzero(lengths == n)
            for lo in range(0, len(rows), MATRIX_ROWS):
                mine = rows[lo : lo + MATRIX_ROWS]
                raw = np.frombuffer(b"".join([words[k] for k in mine.tolist()]), np.uint8).reshape(-1, n)
                for which, ids in self._merge_matrix(raw.T.astype(np.int32)):
                    add(mine[which], ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), starts, sizes

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """`merge` of each word."""
        flat, starts, sizes = self.merge_flat(words)
        return [flat[a : a + n].tolist() for a, n in zip(starts.tolist(), sizes.tolist())]

    def _merge_matrix(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, their ids) of a matrix of bytes, letter by word, as columns are done.

        Each column left merges one pair a round, so all have the same length.
        A pair is known by rank * 64 + place: the least is the best, leftmost one.
        """
        none = len(self.made)
        which = np.arange(raw.shape[1])
        ids = self.first_ids[raw]
        place = np.arange(MATRIX_WORD, dtype=np.int32)[:, None]
        pairs = (self.byte_ranks[raw[:-1] << 8 | raw[1:]] << 6) + place[: len(raw) - 1]
        while len(which):
            if len(ids) == 1:
                yield which, ids
                return
            best = pairs.min(axis=0)
            done = best >> 6 == none
            if done.any():
                yield which[done], ids[:, done]
                ids, pairs, which, best = ids[:, ~done], pairs[:, ~done], which[~done], best[~done]
                if not len(which):
                    return
            at, n = best & 63, len(ids) - 1
            column = np.arange(len(which))
            ids = np.where(place[:n] <= at, ids[:-1], ids[1:])
            ids[at, column] = new = self.made_ids[best >> 6]
            pairs = np.where(place[: n - 1] < at, pairs[:-1], pairs[1:] - 1)
            for left in (True, False):
                some = column[at > 0] if left else column[at < n - 1]
                first = at[some] - left
                known = self.pair_ranks.get((ids[first, some].astype(np.int64) << 20) | (new[some] if left else ids[first + 1, some]))
                pairs[first, some] = (known << 6) + first

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and links, for words where scans would be slow."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, made = self.rank.get, self.made
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            other = after[k]
            if ids[k] < 0 or other >= n or get(ids[k] << 20 | ids[other]) != rank:
                continue  # one of the two has been merged since
            ids[k], ids[other] = made[rank], -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                if (r := get(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := get(ids[before[k]] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]


# ---------------------------------------------------------------- transducer


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: list[list] = []  # [byte, state], by byte
        self.final = False
        self.number = -1
        self.words = 0

    def key(self) -> tuple:
        return (self.final, *((b, s.number) for b, s in self.arcs))


def compile_transducer(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Flat minimal automaton of (word, ids), the words unlike and not empty.

    Layout, little-endian 32-bit numbers: states, arcs, words, ids; per state
    its first arc and whether it ends a word; per arc its byte, target and the
    words that come before it from its state; per word where its ids start;
    the ids.
    """
    entries = sorted(entries)
    root, register = _State(), {}
    states: list[_State] = []
    path: list[_State] = [root]
    before = b""

    def freeze(down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            state = path.pop()
            known = register.get(state.key())
            if known is None:
                state.number = len(states)
                states.append(state)
                register[state.key()] = known = state
                state.words = state.final + sum(s.words for _, s in state.arcs)
            path[-1].arcs[-1][1] = known

    for word, _ in entries:
        common_part = len(os.path.commonprefix((word, before)))
        freeze(common_part)
        for b in word[common_part:]:
            state = _State()
            path[-1].arcs.append([b, state])
            path.append(state)
        path[-1].final = True
        before = word
    freeze(0)
    root.number = len(states)
    states.append(root)
    first, ends, arcs = [], [], []
    for s in states:
        first.append(len(arcs))
        ends.append(int(s.final))
        passed = int(s.final)
        for b, t in s.arcs:
            arcs.append((b, t.number, passed))
            passed += t.words
    first.append(len(arcs))
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
    flat = [i for _, ids in entries for i in ids]
    head = np.array([len(states), len(arcs), len(entries), len(flat)], "<u4")
    table = np.array(arcs, "<u4").reshape(-1, 3)
    return b"".join(x.astype("<u4").tobytes() for x in (head, np.array(first), np.array(ends), table[:, 0], table[:, 1], table[:, 2], starts, np.array(flat)))


class Transducer:
    """A compiled transducer, read in place from a buffer or a mapped file."""

    def __init__(self, buffer) -> None:
        n_states, n_arcs, n_words, n_ids = np.frombuffer(buffer, "<u4", 4).tolist()
        at, parts = 16, []
        for n in (n_states + 1, n_states, n_arcs, n_arcs, n_arcs, n_words + 1, n_ids):
            parts.append(memoryview(buffer)[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.ends, self.byte, self.target, self.passed, self.starts, self.ids = parts
        self.root, self.n_states, self.n_words = n_states - 1, n_states, n_words
        arrays = [np.frombuffer(p, "<u4").astype(np.int64) for p in parts]
        source = np.repeat(np.arange(n_states, dtype=np.int64), np.diff(arrays[0]))
        self.arcs = Numbers(source << 8 | arrays[2], np.arange(n_arcs), -1)
        self.arc_target, self.arc_passed = arrays[3], arrays[4]
        self.final = arrays[1] > 0
        self.id_starts, self.id_table = arrays[5], arrays[6].astype(np.int32)

    @classmethod
    def mapped(cls, compiled: bytes) -> Transducer:
        """Written to a file of this machine, mapped, and the name dropped."""
        with tempfile.TemporaryFile(prefix="promolith-lexicon-") as f:
            f.write(compiled)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        """The ids of `word`, or None if the lexicon has it not."""
        state, number = self.root, 0
        first, byte, target, passed = self.first, self.byte, self.target, self.passed
        for b in word:
            end = first[state + 1]
            lo = bisect_left(byte, b, first[state], end)
            if lo == end or byte[lo] != b:
                return None
            number += passed[lo]
            state = target[lo]
        if not self.ends[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, -1 for none, one letter of all words at a time."""
        out = np.full(len(words), -1, np.int64)
        if not self.n_words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(sizes) - sizes
        alive = np.flatnonzero(sizes > 0)
        at, left = at[alive], sizes[alive]
        state, number = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        while len(alive):
            arc = self.arcs.get(state << 8 | raw[at])
            known = arc >= 0
            if not known.all():
                alive, at, left, number, arc = alive[known], at[known], left[known], number[known], arc[known]
            state = self.arc_target[arc]
            number += self.arc_passed[arc]
            at += 1
            left -= 1
            ended = left == 0
            if ended.any():
                here = ended & self.final[state]
                out[alive[here]] = number[here]
                ended = ~ended
                alive, at, left, state, number = alive[ended], at[ended], left[ended], state[ended], number[ended]
        return out

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """`get` of each word."""
        return [None if k < 0 else self.ids[self.starts[k] : self.starts[k + 1]].tolist() for k in self.numbers(words).tolist()]


# ------------------------------------------------------------------ encoding


def segments(text: str, vocabulary: Vocabulary) -> Iterator[tuple[bool, str]]:
    """(is a special token, text) in order; empty parts are left out."""
    if vocabulary.special_split is None or not any(s in text for s in vocabulary.special):
        if text:
            yield False, text
        return
    for k, part in enumerate(vocabulary.special_split.split(text)):
        if part:
            yield bool(k % 2), part


def pieces(text: str, vocabulary: Vocabulary, most: int = PIECE) -> Iterator[tuple[bool, str]]:
    """`segments`, long ones cut where a pre-token starts, so each piece can be encoded apart."""
    for special, part in segments(text, vocabulary):
        at = 0
        while len(part) - at > most and not special:
            m = _CUT.search(part, at + most)
            if m is None:
                break
            yield False, part[at : m.start()]
            at = m.start()
        yield special, part[at:]


def _no_plain_cut(text: str) -> bool:
    """Whether some space is followed by white space or by nothing."""
    marks = _SPACES_ASCII if text.isascii() else _SPACES
    return text[-1:] == " " or any(m in text for m in marks)


# as pairs, for a search that is faster than a pattern's
_SPACES = [" " + chr(c) for c in range(0x3001) if chr(c).isspace()]
_SPACES_ASCII = [s for s in _SPACES if s.isascii()]


def chunks(text: str) -> list[str]:
    """Pieces that can be encoded apart; all but the first start with a space.

    A space before something that is no white space always starts a new
    pre-token, so the text may be cut there.
    """
    parts = text.split(" ")
    if not _no_plain_cut(text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p  # this space is followed by white space or nothing
    return out


def words_in(chunk: str) -> list[str]:
    """Pre-tokens of a chunk that comes after a space."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in _POINTS and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return PRETOKEN.findall(" " + chunk)


class _Slots(dict):
    """Numbers keys as they come; the new ones are told in `new`."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Encodes texts through the transducer and exact merges."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer | None = None, memo: int = MEMO_CHUNKS) -> None:
        self.vocabulary, self.transducer, self.memo = vocabulary, transducer, memo
        self.misses = 0
        self._forget()

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        if self.transducer is not None:
            ids = self.transducer.get(raw)
            if ids is not None:
                return ids
        self.misses += 1
        return self.vocabulary.merge(raw)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, word by word."""
        ids: list[int] = []
        for special, part in segments(text, self.vocabulary):
            if special:
                ids.append(self.vocabulary.special[part])
            else:
                ids += [i for w in PRETOKEN.findall(part) for i in self.word(w)]
        return ids

    def words_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of each word, where its own start, how many they are."""
        if self.transducer is None:
            self.misses += len(words)
            return self.vocabulary.merge_flat(words)
        row, t = self.transducer.numbers(words), self.transducer
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen, unseen = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        starts[seen], sizes[seen] = t.id_starts[row[seen]], np.diff(t.id_starts)[row[seen]]
        self.misses += len(unseen)
        flat, starts[unseen], sizes[unseen] = self.vocabulary.merge_flat([words[k] for k in unseen.tolist()])
        starts[unseen] += len(t.id_table)
        return np.concatenate([t.id_table, flat]), starts, sizes

    def encode_parts(self, parts: list[tuple[bool, str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts (is a special token, text) in a row, and where each part's end."""
        keys: list = []  # a chunk after a space as it is; (is special, text) for the rest
        part_ends = []
        for special, part in parts:
            if special:
                keys.append((True, part))
            else:
                got = chunks(part)
                if got[0]:
                    keys.append((False, got[0]))
                keys += got[1:]
            part_ends.append(len(keys))
        if len(self.slots) > self.memo:
            self._forget()
        which = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        self._learn(self.slots.new)
        sizes = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.array(part_ends, np.int64)]
        return self.pool[ranges(self.starts[which], sizes)], ends

    def _forget(self) -> None:
        self.slots = _Slots()
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: list) -> None:
        """Put the ids of new keys into the pool, all words at a stroke."""
        words: dict = {}
        of, count = [], []  # words of each key, and how many
        for key in keys:
            if key.__class__ is str:
                if key.isalpha():
                    of.append(words.setdefault(" " + key, len(words)))
                    count.append(1)
                    continue
                got = words_in(key)
            else:
                got = [key] if key[0] else PRETOKEN.findall(key[1])
            of += [words.setdefault(w, len(words)) for w in got]
            count.append(len(got))
        special = [(k, w[1]) for w, k in words.items() if w.__class__ is tuple]
        flat, starts, sizes = self.words_flat([b"" if w.__class__ is tuple else w.encode("utf-8") for w in words])
        for k, text in special:
            starts[k], sizes[k] = len(flat), 1
            flat = np.append(flat, np.int32(self.vocabulary.special[text]))
        of, count = np.array(of, np.int64), np.array(count, np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes[of])])[np.concatenate([[0], np.cumsum(count)])]
        keys.clear()
        self.starts = np.concatenate([self.starts, edges[:-1] + len(self.pool)])
        self.sizes = np.concatenate([self.sizes, np.diff(edges)])
        self.pool = np.concatenate([self.pool, flat[ranges(starts[of], sizes[of])]])

    def encode_groups(self, texts: list[str], most: int = TOGETHER, piece: int = PIECE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(number of the text of each piece, ids, where each piece ends), about `most` code points at a time.

        Pieces come in order; an empty text has none.
        """
        owners, group, size = [], [], 0
        for k, text in enumerate(texts):
            for part in pieces(text, self.vocabulary, piece):
                owners.append(k)
                group.append(part)
                size += len(part[1])
                if size >= most:
                    yield (owners, *self.encode_parts(group))
                    owners, group, size = [], [], 0
        if group:
            yield (owners, *self.encode_parts(group))

    def encode_many(self, texts: list[str], most: int = TOGETHER, piece: int = PIECE) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, ids, ends in self.encode_groups(texts, most, piece):
            for k, part in zip(owners, np.split(ids, ends[:-1])):
                out[k].append(part)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


@functools.lru_cache(1)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


_STATE: dict = {}


def worker_encoder(path: str, digest: str, broadcast) -> Encoder:
    """This worker's encoder; kept between its tasks."""
    if _STATE.get("key") != (path, digest):
        _STATE.update(key=(path, digest), encoder=Encoder(vocabulary_at(path), Transducer.mapped(broadcast.value)))
    return _STATE["encoder"]


# --------------------------------------------------------------------- Spark


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = vocabulary_at(path)
    counts: Counter = Counter()  # of pre-tokens
    after: Counter = Counter()  # of chunks after a space

    def told():
        get = counts.get
        for chunk, n in after.items():
            if chunk.isalpha():
                chunk = " " + chunk
                counts[chunk] = get(chunk, 0) + n
            else:
                for w in words_in(chunk):
                    counts[w] = get(w, 0) + n
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        after.clear()
        return out

    for (texts,) in common.columns(batches):
        for text in texts:
            for special, part in pieces(text, vocabulary):
                if not special:
                    got = chunks(part)
                    if got[0]:
                        counts.update(PRETOKEN.findall(got[0]))
                    after.update(got[1:])
            if len(counts) + len(after) > COUNTED_AT_ONCE:
                yield told()
    yield told()


def word_counts(df: DataFrame, vocabulary: str, text_col: str = common.TEXT) -> DataFrame:
    """word, n: how often each pre-token stands in the whole table."""
    common.ship(df.sparkSession)
    text = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.mapInArrow(lambda b: _count(b, vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, vocabulary: str | None = None, words: int = LEXICON_WORDS, text_col: str = common.TEXT) -> bytes:
    """The compiled transducer of the `words` most frequent pre-tokens.

    Counts cover every document; only the bounded top comes to the driver.
    Pre-tokens of over 64 characters are left to the merges.
    """
    vocabulary = vocabulary or default_vocabulary()
    top = common.most_frequent(word_counts(df, vocabulary, text_col).filter(F.length("word").between(1, 64)), "word", "n", words)
    raw = [word.encode("utf-8") for word, _ in top]
    return compile_transducer(zip(raw, vocabulary_at(vocabulary).merge_many(raw)))


def _encode(batches: Iterator[pa.RecordBatch], path: str, digest: str, broadcast) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(path, digest, broadcast)
    vocabulary = encoder.vocabulary
    for doc_ids, texts in common.columns(batches, 4096):
        n = [0] * len(texts)
        ids_sha, text_sha = ([hashlib.sha256() for _ in texts] for _ in range(2))
        for owners, ids, ends in encoder.encode_groups(texts):
            told, told_ends = vocabulary.told.join(ids)
            back, back_ends = vocabulary.decoded.join(ids)
            at = told_at = back_at = 0
            for k, end in zip(owners, ends.tolist()):
                if end == at:
                    continue
                told_end, back_end = int(told_ends[end - 1]), int(back_ends[end - 1])
                ids_sha[k].update(told[told_at if n[k] else told_at + 1 : told_end])  # no comma before the first
                # pieces end where a pre-token does, so each is whole characters
                text_sha[k].update(bytes(back[back_at:back_end]).decode("utf-8", "replace").encode("utf-8"))
                n[k] += end - at
                at, told_at, back_at = end, told_end, back_end
        hexes = lambda hashes: pa.array([h.hexdigest() for h in hashes], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), hexes(ids_sha), hexes(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(df: DataFrame, vocabulary: str | None = None, words: int = LEXICON_WORDS, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both.

    Special-token strings in a text become their ids, as the library does by
    default.  An empty or null text has no tokens and the digests of "".
    """
    spark = df.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    compiled = build_lexicon(df, vocabulary, words, text_col)
    broadcast, digest = spark.sparkContext.broadcast(compiled), hashlib.sha256(compiled).hexdigest()[:16]
    return common.id_text(df, id_col, text_col).mapInArrow(lambda b: _encode(b, vocabulary, digest, broadcast), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(df: DataFrame, vocabulary: str | None = None, words: int = LEXICON_WORDS, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """doc_id, ids (array of int): the ids themselves."""
    spark = df.sparkSession
    common.ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    compiled = build_lexicon(df, vocabulary, words, text_col)
    broadcast, digest = spark.sparkContext.broadcast(compiled), hashlib.sha256(compiled).hexdigest()[:16]

    def run(batches):
        encoder = worker_encoder(vocabulary, digest, broadcast)
        for ids, texts in common.columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encoder.encode_many(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, vocabulary: str | None = None, id_col: str = common.ID, ids_col: str = "ids") -> DataFrame:
    """doc_id, text: bytes that are no UTF-8 become U+FFFD; null ids: empty."""
    common.ship(df.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        bytes_of = vocabulary_at(vocabulary).bytes_of
        for ids, rows in common.columns(batches):
            texts = [b"".join(bytes_of[i] for i in r or []).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
