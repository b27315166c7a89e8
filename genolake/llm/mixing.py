"""The model of operator 2 inside a task: words as paths of bits, predictors of each bit, and their online mixing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer words go by a digest of their own behind a blank, which no word holds, so that every name has a bounded size.
LONGEST_NAME = 64
#: Bits of a word's path that are mixed, each at its own depth; beyond, words of one node keep their shares among them.
DEPTH = 12
CLASS_BITS = 8
LETTER_BITS = 5
#: Predictors of a word's bit: its node alone, its node after the class of the word before, its node in this text so far.
#: Predictors of a letter's bit: four contexts of letters and the class of the word before.
LETTER_INPUTS = 4
LETTER_CONTEXTS = (2048, 1024, 32768, 32768)
#: Nodes whose counts are kept for each text as it goes on, and the strength of the corpus in them.
LOCAL_NODES, LOCAL_PRIOR = 512, 3.0
#: Weights move at the ends of blocks of tokens, each about a third of what came before.
BOUNDS = np.unique(np.concatenate((np.arange(4, 16, 4), (16 * 1.3 ** np.arange(0, 80)).astype(np.int64))))
WORD_START = np.array([0.05, 0.65, 0.4], np.float32)
LETTER_START = np.array([0.25, 0.1, 0.4, 0.42], np.float32)
MATCH_START = np.array([0.6, 0.6], np.float32)
RATE, REFINE_RATE = 0.04, 0.02
#: Tokens that are mixed side by side, so that a block's arrays stay small; a longer text has a group of its own.
GROUP = 1 << 16
#: One place in so many word ends is an anchor, told by the REACH bytes before it, so that equal passages have equal anchors.
ANCHOR, REACH, RUN = 40, 16, 144


def name_of(word: bytes) -> bytes:
    return word if len(word) <= LONGEST_NAME else b" " + hashlib.md5(word).digest()


class Tokens:
    """The words of some texts, A-Z lower-cased; symbols() of a coder are kept with them."""

    def __init__(self, texts: pa.Array):
        whole = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").cast(pa.string(), safe=False)))
        self.lists = pc.ascii_split_whitespace(whole)
        self.sizes = self.lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.empty = pc.equal(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)
        self.sizes[self.empty] = 0  # a text without any word splits into one empty word
        self.first = np.cumsum(self.sizes) - self.sizes
        self.lane = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.known = None

    @cached_property
    def encoded(self) -> pa.DictionaryArray:
        return pc.dictionary_encode(self.lists.flatten())

    @cached_property
    def names(self) -> pa.Array:
        """The distinct words."""
        return self.encoded.dictionary.cast(pa.binary())

    @cached_property
    def codes(self) -> np.ndarray:
        """Where each word is in names."""
        codes = self.encoded.indices.to_numpy(zero_copy_only=False)
        return codes[~np.repeat(self.empty, np.maximum(self.sizes, 1))] if self.empty.any() else codes

    def word(self, code: int) -> bytes:
        return self.names[int(code)].as_py()

    def keys(self) -> pa.Array:
        """The names of the words: the words but for very long ones."""
        long = pc.greater(pc.binary_length(self.names), LONGEST_NAME)
        if not pc.any(long).as_py():
            return self.names
        return pa.array([name_of(w) for w in self.names.to_pylist()], pa.binary())

    @cached_property
    def data(self) -> np.ndarray:
        """The words again as bytes, with one blank behind each (and one for each text without any)."""
        joined = pc.binary_join_element_wise(pc.binary_join(self.lists, " "), "", " ")
        self.joined_sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: int(self.joined_sizes.sum())]

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each word's blank is."""
        ends = np.flatnonzero(self.data == 32)
        if self.empty.any():  # blanks of texts without words are no word ends
            starts = np.cumsum(self.joined_sizes) - self.joined_sizes
            ends = np.setdiff1d(ends, starts[self.empty], assume_unique=True)
        return ends

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, key, begin, end) of each anchor: the number of the word that it follows, the hash of the bytes before it,
        and the run of bytes after it, up to the next anchor of the text."""
        ends = self.ends
        begin_of = np.where(self.first < len(ends), np.concatenate(([0], ends + 1))[np.minimum(self.first, len(ends))], 0)[self.lane]
        last_of = ends[(self.first + self.sizes - 1)[self.lane]] + 1
        far = ends - begin_of >= REACH - 1
        w = np.flatnonzero(far)
        if not len(w):
            return w, np.zeros(0, np.int64), w, w
        tail = np.ascontiguousarray(self.data[ends[w][:, None] + np.arange(1 - REACH, 1)]).view("<u8")
        h = (tail[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (tail[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        at = (h >> np.uint64(7)) % np.uint64(ANCHOR) == 0
        w, key = w[at], h[at].view(np.int64)
        begin = ends[w] + 1
        after = np.append(begin[1:], 0)
        same = np.append(self.lane[w][1:] == self.lane[w][:-1], False)
        end = np.minimum(np.where(same, after, last_of[w]), begin + RUN)
        real = end > begin
        return w[real], key[real], begin[real], end[real]


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin:end] for each pair, as one binary array."""
    sizes = (end - begin).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(edges[-1]) + np.repeat(begin - edges[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def balanced(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each symbol's path, nodes, bits) of a binary tree over symbols in their order: every inner node cuts its
    range where the weights are halved best, so neighbours share most of their paths and frequent symbols have short ones.
    Nodes are numbered level by level."""
    n = len(weights)
    total = np.concatenate(([0], np.cumsum(np.maximum(weights, 1))))
    a, b, made, levels = np.zeros(min(1, n - 1), np.int64), np.full(min(1, n - 1), n), 0, []
    while len(a):
        cut = np.clip(np.searchsorted(total, (total[a] + total[b]) / 2), a + 1, b - 1)
        sizes = b - a
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)
        nodes, bits = np.full(n, -1, np.int32), np.zeros(n, np.int8)
        nodes[at], bits[at] = np.repeat(made + np.arange(len(a)), sizes), at >= np.repeat(cut, sizes)
        levels.append((nodes, bits))
        made += len(a)
        a, b = np.stack([a, cut], 1).ravel(), np.stack([cut, b], 1).ravel()
        a, b = a[b - a > 1], b[b - a > 1]
    nodes, bits = (np.stack(x, 1) for x in zip(*levels, strict=True))
    real = nodes >= 0
    return np.concatenate(([0], np.cumsum(real.sum(1)))), nodes[real], bits[real]


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -9, 9).astype(np.float32)


def predictions(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Stretched predictions of each counter, at 2 * counter + bit: first by all counts, then, in a second half, without one
    event of that bit, for texts that were counted themselves."""
    out = np.empty((2, len(n0), 2), np.float16)
    out[0] = stretched(n0, n1)[:, None]
    out[1, :, 0] = stretched(np.maximum(n0 - 1, 0), n1)
    out[1, :, 1] = stretched(n0, np.maximum(n1 - 1, 0))
    return out.ravel()


class Coder:
    """Words as symbols: each of the head words, the end of a text, and the escape to any other word, in one balanced tree.
    Head words are ordered by their endings, so that like words are near; the first 8 bits are a word's class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, tail: int, table_bits: int):
        """counts: of the head words; ends: of texts; tail: of all other words' tokens."""
        self.words = pa.array(words, pa.binary())
        self.end, self.escape, self.table_bits = len(words), len(words) + 1, table_bits
        order = sorted(range(len(words)), key=lambda k: words[k][::-1])
        self.weights = np.concatenate((counts, [max(1, ends), max(1, tail)])).astype(np.int64)
        place = np.array([*order, self.end, self.escape])
        offsets, nodes, bits = balanced(self.weights[place])
        sizes = np.diff(offsets)
        self.size, self.offset = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        self.size[place], self.offset[place] = np.minimum(sizes, DEPTH), offsets[:-1]
        self.turns, self.n_nodes = nodes.astype(np.int32) * 2 + bits, int(nodes.max(initial=0)) + 1
        kind = np.zeros(len(place), np.int64)
        for k in range(CLASS_BITS):
            has = sizes > k
            kind = kind * 2 + np.where(has, bits[np.minimum(offsets[:-1] + k, len(bits) - 1)], 0)
        self.kind = np.empty(len(place), np.int64)
        self.kind[place] = kind
        # the share of a word among those that part with it only beyond DEPTH
        path = np.repeat(np.arange(len(place)), sizes)
        level = np.arange(len(nodes)) - np.repeat(offsets[:-1], sizes)
        group = np.full(len(place), -1, np.int64)
        group[path[level == DEPTH]] = nodes[level == DEPTH]
        total = np.bincount(group + 1, self.weights[place], self.n_nodes + 1)
        self.rest = np.zeros(len(place))
        self.rest[place] = np.where(group >= 0, np.log(self.weights[place] / total[group + 1]), 0.0)
        weight = np.repeat(self.weights[place], sizes)
        one = np.bincount(nodes[bits > 0], weight[bits > 0], self.n_nodes)
        every = np.bincount(nodes, weight, self.n_nodes)
        self.alone = predictions(every - one, one)
        share = np.clip(one / np.maximum(every, 1), 1e-4, 1 - 1e-4)[:LOCAL_NODES].astype(np.float32)
        self.local = np.zeros((2, LOCAL_NODES), np.float32)
        self.local[1, : len(share)], self.local[0, : len(share)] = LOCAL_PRIOR * share, LOCAL_PRIOR * (1 - share)
        self.by_ending = np.zeros(1 << 16, np.int64)  # the class of the most frequent head word with an ending
        up = np.argsort(counts, kind="stable")
        self.by_ending[endings(self.words)[up]] = self.kind[:-2][up]
        seen = np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256) + 1
        common = np.argsort(-seen, kind="stable")[: (1 << LETTER_BITS) - 1]
        self.letter = np.full(256, (1 << LETTER_BITS) - 1, np.int64)
        self.letter[common] = np.arange(len(common))
        rare = np.where(self.letter == (1 << LETTER_BITS) - 1, seen, 0)
        self.rare = np.where(rare > 0, np.log(np.maximum(rare, 1) / rare.sum()), 0.0)

    def symbols(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, class) of each word of the texts. A rare word's class, as a context, is that of its ending."""
        if tokens.known is None:
            keys = tokens.keys()
            ids = pc.fill_null(pc.index_in(keys, value_set=self.words), self.escape).to_numpy(zero_copy_only=False).astype(np.int64)
            kinds = np.where(ids == self.escape, self.by_ending[endings(keys)], self.kind[ids])
            tokens.known = ids[tokens.codes], kinds[tokens.codes]
        return tokens.known

    def slots(self, before: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The hashed counter of each turn's node after a class, times 2, plus its bit."""
        nodes = (turns >> 1).astype(np.uint32)
        h = ((before * np.uint32(0x9E3779B1)) ^ (nodes * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        return ((h >> np.uint32(32 - self.table_bits)) << np.uint32(1) | (turns & 1).astype(np.uint32)).astype(np.int64)

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol's number, turn: 2 * node + bit, depth) of each mixed bit."""
        sizes = self.size[ids]
        edges = np.cumsum(sizes)
        of = np.repeat(np.arange(len(ids)), sizes)
        every = np.arange(len(of))
        at = every + np.repeat(self.offset[ids] - edges + sizes, sizes)
        return of, self.turns[at], every - np.repeat(edges - sizes, sizes)

    def letters(self, words: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(letter, contexts [LETTER_INPUTS, letters], word's number, log-probability of what the letter leaves open) of
        spelled words, a blank behind each."""
        data = np.frombuffer(b" ".join(words) + b" " * bool(words), np.uint8)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), lengths)
        within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x, gap = self.letter[data], self.letter[32]
        history = []
        for n in range(1, 5):
            prior = np.full(len(data), gap)
            prior[n:] = x[:-n] if n < len(x) else gap
            prior[within < n] = gap
            history.append(prior)
        a, b, c, e = history
        four = (((((a * 32 + b) * 32 + c) * 32 + e) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 17
        contexts = np.stack([a * 64 + (before[of] >> 2), a * 32 + b, (a * 32 + b) * 32 + c, four])
        return x, contexts, of, self.rare[data]


def endings(words: pa.Array) -> np.ndarray:
    """A hash below 2^16 of the last three bytes of each word."""
    words = pa.concat_arrays([words]) if len(words) else words
    if not len(words):
        return np.zeros(0, np.int64)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = np.zeros(len(words), np.int64)
    for k in range(1, 4):
        has = edges[1:] - edges[:-1] >= k
        out[has] = out[has] * 256 + data[edges[1:][has] - k]
    return (out * 0x9E3779B1 & 0xFFFFFFFF) >> 16


LETTER_EDGES = np.concatenate(([0], np.cumsum([n << LETTER_BITS for n in LETTER_CONTEXTS]))).astype(np.int64)


def counters(table_bits: int) -> int:
    """Counters of all tables: two for each hashed slot, one for each letter after each context."""
    return (2 << table_bits) + int(LETTER_EDGES[-1])


def count_into(sums: np.ndarray, coder: Coder, tokens: Tokens) -> None:
    """Adds all events of the texts to the counters."""
    ids, kinds = coder.symbols(tokens)
    ids, kinds, lane, place = with_ends(coder, tokens, ids, kinds)
    before = preceding(kinds, place)
    before = before.astype(np.uint32)
    size = 2 << coder.table_bits
    for k in range(0, len(ids), GROUP):
        of, turns, _ = coder.paths(ids[k : k + GROUP])
        np.add.at(sums, coder.slots(before[k : k + GROUP][of], turns), np.int32(1))
    before = before.astype(np.int64)
    rare = np.flatnonzero(ids == coder.escape)
    if len(rare):
        words = tokens.names.take(pa.array(tokens.codes[rare - lane[rare]])).to_pylist()
        x, contexts, _, _ = coder.letters(words, before[rare])
        for k in range(LETTER_INPUTS):
            a, b = size + LETTER_EDGES[k], size + LETTER_EDGES[k + 1]
            sums[a:b] += np.bincount((contexts[k] << LETTER_BITS) + x, minlength=b - a).astype(np.int32)


def with_ends(coder: Coder, tokens: Tokens, ids: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, class, text, place in the text) of all words and ends."""
    sizes = tokens.sizes + 1
    ends = np.cumsum(sizes) - 1
    inner = np.ones(int(sizes.sum()), bool)
    inner[ends] = False
    out, near = np.full(len(inner), coder.end), np.full(len(inner), coder.kind[coder.end])
    out[inner], near[inner] = ids, kinds
    lane = np.repeat(np.arange(len(sizes)), sizes)
    return out, near, lane, np.arange(len(out)) - np.repeat(ends + 1 - sizes, sizes)


def preceding(kinds: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.full(len(kinds), 0, np.int64)
    out[1:] = kinds[:-1] + 1
    out[place == 0] = 0
    return out


class Mixer:
    """Online logistic mixing of several texts (lanes) side by side.

    Each gate of each lane has weights of its own, which combine the stretched predictions; a table of corrections refines the
    sum; bits are scored with what was known before their block, then weights, corrections and local counts move by the
    whole block. Blocks grow with the text, so that weights run through all of it. Lanes don't touch each other.
    """

    def __init__(self, lanes: int, gates: int, start: np.ndarray, local: np.ndarray | None = None):
        self.gates = gates
        self.w = [np.full(lanes * gates, x, np.float32) for x in start]
        self.fix = np.zeros(lanes * gates * 16, np.float32)
        self.local = None if local is None else np.repeat(local[:, None, :], lanes, 1).reshape(2, -1)

    def block(self, lane: np.ndarray, gate: np.ndarray, x: list[np.ndarray], y: np.ndarray, nodes: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each bit. x: the predictions of each predictor; local counts add one for low nodes."""
        row = lane * self.gates + gate
        if self.local is not None:
            has = np.flatnonzero(nodes < LOCAL_NODES)
            own = lane[has] * LOCAL_NODES + nodes[has]
            told = np.zeros(len(row), np.float32)
            told[has] = np.log(self.local[1][own] / self.local[0][own])
            x = [*x, told]
        s = self.w[0][row] * x[0]
        for w, k in zip(self.w[1:], x[1:], strict=True):
            s += w[row] * k
        cell = row * 16 + (np.minimum(np.maximum(s, -7.9), 7.9) + 8).astype(np.int64)
        s += self.fix[cell]
        away = np.exp(np.minimum(np.maximum(np.where(y > 0, -s, s), -14), 14))  # the odds against what came
        out = -np.log1p(away)
        error = (away / (1 + away)).astype(np.float32)
        np.negative(error, out=error, where=y == 0)
        n = len(self.w[0])
        many = np.maximum(1.0, np.bincount(row, minlength=n) / 8.0).astype(np.float32)  # a large block moves by its mean, a small one by its sum
        for w, k in zip(self.w, x, strict=True):
            w += RATE * np.bincount(row, error * k, n) / many
        np.add.at(self.fix, cell, REFINE_RATE * error / many[row])
        if self.local is not None:
            one = y[has].astype(np.float32)
            np.add.at(self.local[0], own, 1 - one)
            np.add.at(self.local[1], own, one)
        return out


class Model:
    """What scoring needs: the coder and the predictions of all counters."""

    def __init__(self, coder: Coder, counts: np.ndarray):
        self.coder = coder
        size = 2 << coder.table_bits
        pairs = counts[:size].reshape(-1, 2)
        self.after = predictions(pairs[:, 0], pairs[:, 1])
        self.spelled = []
        for k, n in enumerate(LETTER_CONTEXTS):
            leaves = counts[size + LETTER_EDGES[k] : size + LETTER_EDGES[k + 1]].reshape(n, -1)
            heap = np.zeros((n, 2 << LETTER_BITS), np.float64)
            heap[:, 1 << LETTER_BITS :] = leaves
            for node in range((1 << LETTER_BITS) - 1, 0, -1):
                heap[:, node] = heap[:, 2 * node] + heap[:, 2 * node + 1]
            self.spelled.append(predictions(heap[:, 0::2].ravel(), heap[:, 1::2].ravel()))

    def score(self, tokens: Tokens, own: np.ndarray, runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """For each text the log-probability of its words and its end, without what rare words leave open; and for each rare
        word's token its text, its word's code, its log-probability when spelled, and whether its match spared it.

        own: whether a text was counted, so that its own events are taken out one at a time.
        """
        coder, n = self.coder, len(tokens.sizes)
        ids, kinds, lane, place = with_ends(coder, tokens, *coder.symbols(tokens))
        total = np.zeros(n)
        spared = np.zeros(len(ids), bool)
        at, hit, lp = matches(tokens, own, runs)
        if len(at):
            total += np.bincount(tokens.lane[at], lp, n)
            spared[(at + tokens.lane[at])[hit]] = True
        before = preceding(kinds, place).astype(np.uint32)
        todo = np.flatnonzero(~spared)
        total += np.bincount(lane[todo], coder.rest[ids[todo]], n)
        for i, j in groups(np.bincount(lane[todo], minlength=n)):
            a, b = np.searchsorted(lane[todo], [i, j])
            chosen, edges = blocks(place, todo[a:b])
            mixer = Mixer(j - i, DEPTH, WORD_START, coder.local)
            own_alone, own_after = own[i:j] * (len(coder.alone) // 2), own[i:j] * (len(self.after) // 2)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                t = chosen[a:b]
                of, turns, depth = coder.paths(ids[t])
                row = (lane[t] - i)[of]
                x = [coder.alone[own_alone[row] + turns].astype(np.float32), self.after[own_after[row] + coder.slots(before[t][of], turns)].astype(np.float32)]
                total[i:j] += np.bincount(row, mixer.block(row, depth, x, turns & 1, turns >> 1), j - i)
        rare = np.flatnonzero(ids == coder.escape)
        codes = tokens.codes[rare - lane[rare]]
        cost = self.spell(tokens.names.take(pa.array(codes)).to_pylist(), before[rare].astype(np.int64), lane[rare], own)
        return {"total": total, "lane": lane[rare], "code": codes, "spared": spared[rare], "spelled": cost}

    def spell(self, words: list[bytes], before: np.ndarray, lane: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-probability of each word, letter by letter; weights run along the rare words of each text."""
        if not words:
            return np.zeros(0)
        x, contexts, of, rest = self.coder.letters(words, before)
        out = np.bincount(of, rest, len(words))
        first = np.searchsorted(lane, lane)  # rare words come text by text
        place, at = (8 * (np.arange(len(words)) - first))[of], lane[of]
        levels = np.arange(LETTER_BITS)
        tables = [own * (len(p) // 2) for p in self.spelled]
        for i, j in groups(np.bincount(at, minlength=len(own))):
            a, b = np.searchsorted(at, [i, j])
            chosen, edges = blocks(place, np.arange(a, b))
            mixer = Mixer(j - i, LETTER_BITS, LETTER_START)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                t = chosen[a:b]
                letter = x[t][:, None]
                nodes = (1 << levels) | (letter >> (LETTER_BITS - levels))
                bits = (letter >> (LETTER_BITS - 1 - levels)) & 1
                turns = nodes * 2 + bits
                inputs = [p[(tables[k][at[t]] + (contexts[k][t] << (LETTER_BITS + 1)))[:, None] + turns].astype(np.float32).ravel() for k, p in enumerate(self.spelled)]
                lp = mixer.block(np.repeat(at[t] - i, LETTER_BITS), np.tile(levels, len(t)), inputs, bits.ravel())
                np.add.at(out, of[t], lp.reshape(-1, LETTER_BITS).sum(1, dtype=np.float64))
        return out


def groups(sizes: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` tokens together, at least one text each; texts without any are passed over."""
    edges = np.concatenate(([0], np.cumsum(sizes)))
    i = int(np.searchsorted(edges, 0, side="right")) - 1
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, side="right")) - 1)
        if edges[j] > edges[i]:
            yield i, j
        i = j


def blocks(place: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen places, block after block and in their order within, and the edges of the blocks."""
    step = np.searchsorted(BOUNDS, place[chosen], side="right").astype(np.int16)
    order = np.argsort(step, kind="stable")
    return chosen[order], np.concatenate(([0], np.flatnonzero(np.diff(step[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)


def matches(tokens: Tokens, own: np.ndarray, runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, whether the next word was told right, log-probability of that bit) wherever the corpus has a run after
    the last anchor that tells the next word.

    runs: key (sorted), begin, end, data: the most frequent run after an anchor; n, total: how often it, and any run, was
    seen. Of texts that were counted their own runs are taken out. The bit's predictors are the run's share among all runs and
    how long the texts have agreed; what is told is known before the word, so the whole remains a probability.
    """
    none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
    if not len(runs["key"]):
        return none
    w, key, begin, end = tokens.anchors()
    if not len(w):
        return none
    at = np.minimum(np.searchsorted(runs["key"], key), len(runs["key"]) - 1)
    found = runs["key"][at] == key
    size = np.where(found, runs["end"][at] - runs["begin"][at], 0)
    told, cover = np.zeros(len(tokens.data), np.uint8), np.full(len(w), 0, np.int64)
    last = tokens.ends[(tokens.first + tokens.sizes - 1)[tokens.lane[w]]] + 1
    until = np.where(np.append(tokens.lane[w][1:] == tokens.lane[w][:-1], False), np.append(begin[1:], 0), last)
    fill = np.minimum(size, until - begin)
    cover = begin + fill
    edges = np.cumsum(fill) - fill
    put = np.repeat(begin - edges, fill) + np.arange(fill.sum())
    told[put] = runs["data"][np.repeat(runs["begin"][at] - edges, fill) + np.arange(fill.sum())]
    wrong = np.zeros(len(told) + 1, np.int32)
    np.cumsum(told != tokens.data, dtype=np.int32, out=wrong[1:])
    lane = tokens.lane[w]
    same = found & (size == end - begin) & (wrong[np.minimum(cover, end)] == wrong[begin]) & (cover == end)
    group = np.unique(key ^ (lane.astype(np.int64) * np.int64(0x2545F4914F6CDD1D)), return_inverse=True)[1]
    every, mine = np.bincount(group)[group], np.bincount(group, same)[group]
    n = np.where(found, runs["n"][at], 0) - np.where(own[lane], mine, 0)
    total = np.where(found, runs["total"][at], 0) - np.where(own[lane], every, 0)
    useful = found & (n > 0)
    # words after the anchor in force, whose begin is a word's begin in the run as well, with a whole word to come
    start = np.concatenate(([0], tokens.ends[:-1] + 1))
    force = np.searchsorted(begin, start, side="right") - 1
    ok = (force >= 0) & useful[np.maximum(force, 0)]
    force = np.maximum(force, 0)
    ok &= (lane[force] == tokens.lane) & (start < cover[force])
    ok &= (start == begin[force]) | (told[np.maximum(start - 1, 0)] == 32)
    blanks = np.flatnonzero(told == 32)
    word = np.flatnonzero(ok)
    if not len(word) or not len(blanks):
        return none
    k = np.searchsorted(blanks, start[word])
    stop = np.where(k < len(blanks), blanks[np.minimum(k, len(blanks) - 1)], len(told))
    word, stop = word[stop < cover[force[word]]], stop[stop < cover[force[word]]]
    if not len(word):
        return none
    hit = (stop == tokens.ends[word]) & (wrong[tokens.ends[word] + 1] == wrong[start[word]])
    f = force[word]
    number = np.arange(len(word))
    head = np.concatenate(([True], tokens.lane[word][1:] != tokens.lane[word][:-1]))
    # agreed: told words that were right since the last wrong one, before this word, in its text
    miss = np.maximum.accumulate(np.where(np.concatenate(([False], ~hit[:-1])) | head, number, 0))
    agreed = np.minimum(number - miss, 32)
    fresh = np.maximum.accumulate(np.where(head, number, 0)) == miss  # nothing was told wrong yet
    x = [np.log((n[f] + 0.02) / (np.maximum(total[f] - n[f], 0) + 0.3)).astype(np.float32), np.where(fresh, np.log(agreed + 2.0), np.log(agreed + 0.3)).astype(np.float32)]
    gate = np.minimum(agreed, 3) + 4 * ~fresh
    order, edges = blocks(number - np.maximum.accumulate(np.where(head, number, 0)), number)
    mixer, lp = Mixer(len(tokens.sizes), 8, MATCH_START), np.zeros(len(word))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        t = order[a:b]
        lp[t] = mixer.block(tokens.lane[word[t]], gate[t], [k[t] for k in x], hit[t].astype(np.int8))
    return word, hit, lp
