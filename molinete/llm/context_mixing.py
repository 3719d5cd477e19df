"""A language model by logistic mixing of hashed-context bit predictors: codes, counts, mixing, bits."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np

#: Slots (as powers of two) of the hashed tables: of the last landmark and the last two words; of the bytes before in a spelled word.
WORD_BITS, BYTE_BITS = 20, 20
#: How many bytes back the contexts inside a spelled word reach.
BYTES_BACK = (3, 5)
TABLES = (1 << WORD_BITS, 1 << WORD_BITS, *(1 << BYTE_BITS for _ in BYTES_BACK))
OFFSETS = tuple(int(x) for x in np.concatenate([[0], np.cumsum(TABLES)]))
#: Words that are turned into bits at a time.
WORDS = 1 << 15
#: Bits that weights are fitted on before they move; bits of a text that are coded before its own move; how many frequent words are landmarks.
SEGMENT, SHORT, LANDMARKS = 4096, 128, 1024
#: Odds are kept to 1/1024 and, mixed, to 1/64; beyond +-9 they are held.
_SCALE, _FINE, _MOST = np.float32(1 / 4096), 64, 9
_LEVELS = 2 * _FINE * _MOST + 1
#: Stretches of odds that have a shift of their own within a text; no bit is held more certain than this.
_PLACES, _LEAST = 8, np.float32(1e-4)
#: The gate of bits that have seen both contexts often, which are most; gates with one for padding; the stretch of each level.
_OFTEN, _GATES = 15, 17
_STRETCH = np.arange(_LEVELS) * _PLACES // _LEVELS
_TERMINATOR = 32
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _hash(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts (32 bits, well mixed) at nodes (already times ``_B``)."""
    z = context ^ node
    z *= _A
    z >>= np.uint32(32 - bits)
    return z


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One well mixed 32-bit context of several 32-bit numbers."""
    z = np.zeros_like(parts[0])
    for x in parts:
        z = (z ^ x) * _A
        z ^= z >> np.uint32(16)
        z = z * _C + np.uint32(1)
        z ^= z >> np.uint32(13)
    return z


@dataclass
class Code:
    """A Huffman code: symbol s is the bits ``bit[start[s] : start[s] + length[s]]`` at the inner nodes ``node[...]``; ``guess`` is each
    node's log odds of a one by the counts alone."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    guess: np.ndarray

    def __post_init__(self):
        self.mixed = self.node.astype(np.uint32) * _B
        self.odds = self.guess[self.node]

    def __reduce__(self):
        return Code, (self.start, self.length, self.node, self.bit, self.guess)


def huffman(counts: np.ndarray) -> Code:
    """The code of at least two symbols; equal counts are merged in the order of their symbols."""
    n = len(counts)
    heap = [(int(c), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, odds = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.int8), np.zeros(n - 1, np.float32)
    for inner in range(n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = n + inner
        side[y] = 1
        odds[inner] = np.log((b + 0.02) / (a + 0.02))
        heapq.heappush(heap, (a + b, n + inner))
    # All symbols climb to the root together, one level a step; inner nodes come before their parents.
    length = np.zeros(2 * n - 1, np.int32)
    for at in range(2 * n - 3, -1, -1):
        length[at] = length[parent[at]] + 1
    length = length[:n]
    start = (np.cumsum(length) - length).astype(np.int32)
    node, bit = np.zeros(int(length.sum()), np.int32), np.zeros(int(length.sum()), np.int8)
    symbol, at = np.arange(n), np.arange(n)
    for up in range(1, int(length.max()) + 1):
        spot = start[symbol] + length[symbol] - up
        node[spot], bit[spot] = parent[at] - n, side[at]
        at = parent[at]
        more = length[symbol] > up
        symbol, at = symbol[more], at[more]
    return Code(start, length, node, bit, odds)


def _expand(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For symbols in a row: how many bits each has, and each bit's place in the code's tables."""
    length = code.length[symbols]
    ends = np.cumsum(length, dtype=np.intp)
    place = np.repeat(code.start[symbols] - ends + length, length)
    place += np.arange(len(place))
    return length, place


@dataclass
class Vocabulary:
    """Coded words (the first ``coded`` of ``ids``), an end and an escape symbol; other words are spelled byte by byte."""

    words: list[bytes]
    coded: int
    word_code: Code
    byte_code: Code

    def __post_init__(self):
        self.ids = {w: i for i, w in enumerate(self.words)}

    def __reduce__(self):
        return Vocabulary, (self.words, self.coded, self.word_code, self.byte_code)


@dataclass
class Tokens:
    """Texts cut into words: how many words each has, and each word's place among the distinct ones; of these, the place in the vocabulary (or -1)
    and a mark that stands for the word in contexts. A word is looked up once, however often it stands in the texts."""

    lengths: np.ndarray
    which: np.ndarray
    words: list[bytes]
    ids: np.ndarray
    marks: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary, lengths: np.ndarray, which: np.ndarray, words: list[bytes]) -> Tokens:
        ids = np.fromiter(map(vocabulary.ids.get, words, repeat(-1)), np.int32, len(words))
        marks, missing = ids.astype(np.uint32), np.flatnonzero(ids < 0)
        marks[missing] = np.array([zlib.crc32(words[i]) for i in missing.tolist()], np.uint32)
        return Tokens(lengths, which, words, ids, marks)

    def of_texts(self, rows: np.ndarray) -> Tokens:
        """Some of the texts."""
        ends = np.cumsum(self.lengths)
        begins = (ends - self.lengths)[rows].tolist()
        which = [self.which[a:b] for a, b in zip(begins, ends[rows].tolist(), strict=True)]
        return Tokens(self.lengths[rows], np.concatenate([self.which[:0], *which]), self.words, self.ids, self.marks)

    def parts(self, words: int) -> Iterator[Tokens]:
        """The texts in turn, about so many words at a time."""
        ends = np.cumsum(self.lengths)
        last = np.flatnonzero(np.diff(np.append(ends // words, -1))) + 1
        begin = at = 0
        for end in last.tolist():
            to = int(ends[end - 1])
            yield Tokens(self.lengths[begin:end], self.which[at:to], self.words, self.ids, self.marks)
            begin, at = end, to


@dataclass
class Batch:
    """The coded symbols of several texts: the words ``spelled`` and whose they are; the bits of all coded symbols, how many each text has, their
    places in the code and both contexts' slots."""

    spelled: list[bytes]
    spelled_owner: np.ndarray
    bits_each: np.ndarray
    bits: np.ndarray
    place: np.ndarray
    slots: tuple[np.ndarray, np.ndarray]


def batch_of(vocabulary: Vocabulary, texts: Tokens | list[list[bytes]]) -> Batch:
    """Texts as words -> the bits of their coded symbols with both hashed contexts.

    The contexts are the last of the ``LANDMARKS`` most frequent words, which tells language and subject, and the last two words.
    """
    if not isinstance(texts, Tokens):
        words = list(chain.from_iterable(texts))
        texts = Tokens.of(vocabulary, np.array([len(t) for t in texts], np.int64), np.arange(len(words)), words)
    end, escape = vocabulary.coded, vocabulary.coded + 1
    lengths, ids, identity = texts.lengths, texts.ids.take(texts.which), texts.marks.take(texts.which)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    loose = np.flatnonzero((ids < 0) | (ids >= vocabulary.coded))
    spelled = [texts.words[i] for i in texts.which[loose].tolist()]
    ids[loose] = escape
    # One end behind each text's words; it is also what stands before the first.
    ends = np.cumsum(lengths)
    symbols = np.insert(ids, ends, end)
    identity = np.insert(identity, ends, np.uint32(0xFFFFFFFF))
    n = len(symbols)
    back = np.full((2, n), 0xFFFFFFFF, np.uint32)
    back[0, 1:], back[1, 2:] = identity[:-1], identity[:-2]
    back[1, ends - lengths + np.arange(len(lengths))] = 0xFFFFFFFF
    mark = np.where((symbols < LANDMARKS) | (symbols == end), np.arange(n), -1)
    mark = np.concatenate([[-1], np.maximum.accumulate(mark)[:-1]]) if n else mark
    landmark = np.where(mark < 0, np.uint32(0xFFFFFFFF), identity[mark]).astype(np.uint32)
    length, place = _expand(vocabulary.word_code, symbols)
    node = vocabulary.word_code.mixed.take(place)
    slots = (_hash(np.repeat(_mixed(landmark), length), node, WORD_BITS), _hash(np.repeat(_mixed(back[0], back[1]), length), node, WORD_BITS))
    each = np.bincount(np.insert(owner, ends, np.arange(len(lengths))), length, len(lengths)).astype(np.int64)
    return Batch(spelled, owner[loose], each, vocabulary.word_code.bit.take(place), place, slots)


def spelling(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The bits of spelled words: owner, bit, place, and the slots of each context, so many bytes before in the same word."""
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    inside = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    length, place = _expand(vocabulary.byte_code, raw.astype(np.int64))
    node = vocabulary.byte_code.mixed.take(place)
    so_far, contexts = np.zeros(len(raw), np.uint32), []
    for back in range(1, max(BYTES_BACK) + 1):
        before = np.full(len(raw), _TERMINATOR, np.uint32)
        before[back:] = np.where(inside[back:] >= back, raw[:-back], _TERMINATOR)
        so_far = _mixed(so_far, before)
        if back in BYTES_BACK:
            contexts.append(so_far)
    slots = tuple(_hash(np.repeat(c, length), node, BYTE_BITS) for c in contexts)
    return np.repeat(np.repeat(np.arange(len(words)), size), length), vocabulary.byte_code.bit.take(place), place, slots


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Counts (zeros, ones) by slot -> log odds in steps of 1/1024 times four, plus how often it was seen (0, 1, 2: more, 3: 16 and more)."""
    zeros, ones = counts[:, 0].astype(float), counts[:, 1].astype(float)
    odds = np.clip(np.log((ones + 0.3) / (zeros + 0.3)), -7.9, 7.9)
    seen = np.digitize(zeros + ones, [1, 2, 16])
    return (np.round(odds * 1024).astype(np.int32) * 4 + seen).astype(np.int16)


@dataclass
class Rows:
    """The bits of several texts in rows of ``SHORT``, ``each`` text's in turn: their places in the code, the bits, and what the tables hold for them.
    A text's last row is filled up with a place behind the code's."""

    each: np.ndarray
    places: np.ndarray
    bits: np.ndarray
    seen: list[np.ndarray]

    @staticmethod
    def of(each: np.ndarray, pad: int, places: np.ndarray, bits: np.ndarray, seen: list[np.ndarray]) -> Rows:
        rows = -(-each // SHORT)
        size = int(rows.sum()) * SHORT
        wide = np.full(size, pad, np.int32), np.zeros(size, np.int8), *(np.zeros(size, np.int16) for _ in seen)
        begin = 0
        for n, to in zip(each.tolist(), ((np.cumsum(rows) - rows) * SHORT).tolist(), strict=True):
            for whole, part in zip(wide, (places, bits, *seen), strict=True):
                whole[to : to + n] = part[begin : begin + n]
            begin += n
        places, bits, *seen = (w.reshape(-1, SHORT) for w in wide)
        return Rows(rows, places, bits, seen)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        """All parts' rows; the list is emptied, so that they are not held twice."""
        seen = [np.concatenate(own) for own in zip(*(p.seen for p in parts), strict=True)]
        whole = Rows(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("each", "places", "bits")), seen)
        parts.clear()
        return whole


@dataclass
class Mixer:
    """Weights by gate (how often two contexts were seen; the last is a constant's), and the refined probability by gate and mixed odds."""

    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def new(inputs: int) -> Mixer:
        weights = np.zeros((16, inputs + 1), np.float32)
        weights[:, :inputs] = 1.0 / inputs
        return Mixer(weights, np.tile(_PLAIN, (16, 1)))

    @cached_property
    def costs(self) -> np.ndarray:
        """Bits of information of a zero and of a one, by gate and level."""
        q = (self.refined + _PLAIN) / 2
        return -np.log2(np.stack([1 - q, q], axis=2)).astype(np.float32).reshape(-1)

    def code(self, inputs: list[np.ndarray], gate: np.ndarray, bits: np.ndarray, costs: np.ndarray, rate: float = 0.0) -> np.ndarray:
        """Bits of information of each bit under the fitted weights and map; those of texts, where they move, are :meth:`coded`."""
        if rate:
            raise ValueError("weights move by text: use coded")
        return costs[gate * np.int32(2 * _LEVELS) + bits + 2 * self._levels(inputs, gate, np.flatnonzero(gate != _OFTEN))]

    def coded(self, rows: Rows, odds: np.ndarray, rate: float) -> np.ndarray:
        """Bits of information of each text. ``odds`` are those of the code's places by counts alone; a text starts from the fitted weights and map,
        and after each ``SHORT`` of its bits those of the gates that were used move on by its own errors, if ``rate`` is positive."""
        # All texts go ahead together, a row of each at a time. Those with most rows come first, so the late steps are small.
        rank = np.argsort(-rows.each, kind="stable")
        each, first = rows.each[rank], (np.cumsum(rows.each) - rows.each)[rank]
        texts, total, pad = len(each), np.zeros(len(each)), len(odds)
        weights, refined = np.zeros((len(self.weights.T), texts, _GATES), np.float32), np.append((self.refined + _PLAIN) / 2, _PLAIN)
        weights[:, :, :-1] = self.weights.T[:, None]
        odds, often = np.append(odds, np.float32(0)), refined[_OFTEN * _LEVELS : (_OFTEN + 1) * _LEVELS]
        shift, base = np.zeros(texts * _GATES * _PLACES, np.float32), ((np.arange(texts) * _GATES + _OFTEN) * _PLACES)[:, None]
        for step in range(int(each.max(initial=0))):
            n = int(np.searchsorted(-each, -step))
            here = first[:n] + step
            places, bit, seen = rows.places[here].astype(np.intp), rows.bits[here].astype(np.float32), [s[here] for s in rows.seen]
            x = np.ones((len(weights), n, SHORT), np.float32)
            odds.take(places, out=x[0], mode="clip")
            for k, s in enumerate(seen, 1):
                np.multiply(s, _SCALE, out=x[k])
            gate = ((seen[-2] & 3) << 2 | (seen[-1] & 3)).reshape(-1)
            # Most bits have seen both contexts often: that gate's weights for all, then the others' own (padding has a gate of its own).
            other = np.flatnonzero(gate != _OFTEN)
            own, whose = np.where(places.reshape(-1)[other] == pad, _OFTEN + 1, gate[other]).astype(np.intp), other // SHORT
            cell, x_own = whose * _GATES + own, x.reshape(len(x), -1)[:, other]
            now, now_own = weights[:, :n, _OFTEN, None], weights.reshape(len(x), -1)[:, cell]
            z, z_own = now[0] * x[0], now_own[0] * x_own[0]
            for k in range(1, len(x)):
                z += now[k] * x[k]
                z_own += now_own[k] * x_own[k]
            z.reshape(-1)[other] = z_own
            level = self._level(z)
            place = _STRETCH.take(level)
            place_own = place.reshape(-1)[other] + cell * _PLACES
            place += base[:n]
            place = place.reshape(-1)
            place[other] = place_own
            p = often.take(level).reshape(-1)
            p[other] = refined[own * _LEVELS + level.reshape(-1)[other]]
            p += shift.take(place)
            np.minimum(np.maximum(p, _LEAST, out=p), 1 - _LEAST, out=p)
            p = p.reshape(n, SHORT)
            cost = np.log(np.abs(np.float32(1) - bit - p))
            cost.reshape(-1)[other[own > _OFTEN]] = 0
            total[rank[:n]] -= cost.sum(axis=1, dtype=float)
            if not rate:
                continue
            error = bit - _PLAIN.take(level)
            error_own = error.reshape(-1)[other]
            error.reshape(-1)[other] = 0
            pace, pace_own = rate / (SHORT - np.bincount(whose, minlength=n) + 60), rate / (np.bincount(cell, minlength=n * _GATES) + 60)
            weights[:, :n, _OFTEN] += pace * np.multiply(x, error, out=x).sum(axis=2, dtype=float)
            sums = np.bincount((cell + np.arange(len(x))[:, None] * (n * _GATES)).reshape(-1), (x_own * error_own).reshape(-1), len(x) * n * _GATES)
            weights[:, :n] += (sums.reshape(len(x), -1) * pace_own).reshape(len(x), n, _GATES)
            found = np.bincount(place, (bit - p).reshape(-1))
            shift[: len(found)] += found * (rate / (SHORT / 2))
        return total / np.log(2)

    def _levels(self, inputs: list[np.ndarray] | np.ndarray, gate: np.ndarray, other: np.ndarray) -> np.ndarray:
        # Most bits have seen both contexts often: theirs for all, then the others' own.
        now, own = self.weights[_OFTEN], self.weights[gate[other]].T
        z, there = np.full(len(gate), now[-1], np.float32), own[-1].copy()
        for k in range(len(now) - 1):
            z += now[k] * inputs[k]
            there += own[k] * inputs[k][other]
        z[other] = there
        return self._level(z)

    @staticmethod
    def _level(z: np.ndarray) -> np.ndarray:
        np.minimum(np.maximum(z, np.float32(-_MOST), out=z), np.float32(_MOST), out=z)
        z += np.float32(_MOST)
        z *= np.float32(_FINE)
        return z.astype(np.intp)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bits: np.ndarray, rate: float, tally: np.ndarray | None) -> None:
        """One online pass: each gate's weights follow its own errors, segment by segment."""
        met, every, kinds = np.empty(len(bits), np.intp), np.stack([*inputs, np.ones(len(bits), np.float32)]), np.arange(len(inputs) + 1)[:, None]
        for a in range(0, len(bits), SEGMENT):
            x, g, y = every[:, a : a + SEGMENT], gate[a : a + SEGMENT], bits[a : a + SEGMENT]
            other = np.flatnonzero(g != _OFTEN)
            own = g[other].astype(np.intp)
            level = met[a : a + SEGMENT] = self._levels(x, g, other)
            error = y - _PLAIN.take(level)
            sums = np.bincount((own + 16 * kinds).reshape(-1), (error[other] * x[:, other]).reshape(-1), 16 * len(x)).reshape(-1, 16).astype(float)  # without bits, they are whole numbers
            error[other] = 0
            sums[:, _OFTEN] = (error * x).sum(axis=1, dtype=float)
            times = np.bincount(own, minlength=16)
            times[_OFTEN] = len(y) - len(other)
            self.weights += (rate * sums / np.where(kinds < len(inputs), times + 60, 0.25 * times + 30)).T
        if tally is not None:
            met += gate * np.intp(_LEVELS)
            met *= 2
            met += bits
            tally += np.bincount(met, minlength=len(tally))


#: The probability of a one at each level of mixed odds (levels are cut off downwards).
_PLAIN = (1 / (1 + np.exp(-(np.arange(_LEVELS) + 0.5 - _FINE * _MOST) / _FINE))).astype(np.float32)


@dataclass
class Model:
    vocabulary: Vocabulary
    tables: np.ndarray
    words: Mixer
    bytes: Mixer
    rate: float = 0.5

    def seen(self, slots: tuple[np.ndarray, ...], first: int) -> list[np.ndarray]:
        """What the tables from the ``first`` on hold in slots of theirs."""
        return [self.tables[OFFSETS[first + k] : OFFSETS[first + k + 1]].take(own, mode="clip") for k, own in enumerate(slots)]

    def word_inputs(self, batch: Batch) -> tuple[list[np.ndarray], np.ndarray]:
        return _inputs(self.vocabulary.word_code.odds.take(batch.place), self.seen(batch.slots, 0))

    def byte_inputs(self, place: np.ndarray, slots: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        return _inputs(self.vocabulary.byte_code.odds.take(place), self.seen(slots, 2))

    def rows(self, batch: Batch) -> tuple[Rows, Rows]:
        """The bits of coded and of spelled words, in rows of each text."""
        words = Rows.of(batch.bits_each, len(self.vocabulary.word_code.node), batch.place, batch.bits, self.seen(batch.slots, 0))
        owner, bit, place, slots = spelling(self.vocabulary, batch.spelled)
        each = np.bincount(batch.spelled_owner[owner], minlength=len(batch.bits_each))
        return words, Rows.of(each, len(self.vocabulary.byte_code.node), place, bit, self.seen(slots, 2))

    def bits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, Batch]:
        """Total bits of each text's words and end. Each text starts from the fitted weights, so its result hangs on no other."""
        batch = batch_of(self.vocabulary, texts)
        return self._coded([self.rows(batch)]), batch

    def bits_of(self, tokens: Tokens) -> np.ndarray:
        """The same of texts by their words' places. ``WORDS`` words are prepared at a time; all texts are coded side by side."""
        return self._coded(self.rows(batch_of(self.vocabulary, part)) for part in tokens.parts(WORDS))

    def _coded(self, parts: Iterable[tuple[Rows, Rows]]) -> np.ndarray:
        words, spelled = [], []
        for w, b in parts:
            words.append(w)
            spelled.append(b)
        if not words:
            return np.zeros(0)
        total = self.words.coded(Rows.joined(words), self.vocabulary.word_code.odds, self.rate)
        return total + self.bytes.coded(Rows.joined(spelled), self.vocabulary.byte_code.odds, self.rate)


def _inputs(odds: np.ndarray, seen: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    return [odds, *(s * _SCALE for s in seen)], (seen[-2] & 3) << 2 | (seen[-1] & 3)


def learn_texts(model: Model, texts: Tokens | list[list[bytes]], rate: float, cells: tuple[np.ndarray, np.ndarray] | None) -> None:
    """One online pass of both mixers over texts that the tables have not seen; ``cells`` counts the levels met on the way."""
    batch = batch_of(model.vocabulary, texts)
    model.words.learn(*model.word_inputs(batch), batch.bits, rate, None if cells is None else cells[0])
    if batch.spelled:
        _, bit, place, slots = spelling(model.vocabulary, batch.spelled)
        model.bytes.learn(*model.byte_inputs(place, slots), bit, rate, None if cells is None else cells[1])


def no_levels() -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones by gate and level, for words and for bytes: none yet."""
    return np.zeros(16 * _LEVELS * 2), np.zeros(16 * _LEVELS * 2)


def refined_by(tally: np.ndarray) -> np.ndarray:
    """The refined probabilities that follow from the zeros and ones by gate and level."""
    width = _FINE // 2
    # Over half a unit of odds on either side, with forty observations' worth of faith in the mixed odds themselves.
    sums = np.cumsum(np.pad(tally.reshape(16, _LEVELS, 2), ((0, 0), (width + 1, width), (0, 0))), axis=1)
    near = sums[:, 2 * width + 1 :] - sums[:, : -2 * width - 1]
    expected = np.cumsum(np.pad(tally.reshape(16, _LEVELS, 2).sum(axis=2) * _PLAIN, ((0, 0), (width + 1, width))), axis=1)
    expected = expected[:, 2 * width + 1 :] - expected[:, : -2 * width - 1]
    # What happened near a level against what was foretold there, applied to the level's own odds.
    shift = np.log((near[:, :, 1] + 40 * _PLAIN) / (expected + 40 * _PLAIN)) - np.log(
        (near[:, :, 0] + 40 * (1 - _PLAIN)) / (near.sum(axis=2) - expected + 40 * (1 - _PLAIN))
    )
    return (1 / (1 + np.exp(-(np.log(_PLAIN / (1 - _PLAIN)) + shift)))).astype(np.float32)


class BitCounts:
    """(zeros, ones) by slot of one hashed table. Bits are gathered and counted together: one pass over the table per ``GATHER`` bits."""

    GATHER = 2_000_000

    def __init__(self, size: int):
        self.counts = np.zeros((size, 2), np.int64)
        self._cells: list[np.ndarray] = []
        self._times: list[np.ndarray] = []
        self._held = 0

    def add(self, slots: np.ndarray, bits: np.ndarray, times: np.ndarray | None = None) -> None:
        """``times``: how often each bit counts, for all calls or for none."""
        cells = slots.astype(np.int32)
        cells *= 2
        cells += bits
        self._cells.append(cells)
        if times is not None:
            self._times.append(times)
        self._held += len(cells)
        if self._held >= self.GATHER:
            self.total()

    def total(self) -> np.ndarray:
        if self._held:
            flat = self.counts.reshape(-1)
            found = np.bincount(np.concatenate(self._cells), np.concatenate(self._times) if self._times else None, len(flat))
            flat += found.astype(np.int64) if self._times else found
            self._cells, self._times, self._held = [], [], 0
        return self.counts
