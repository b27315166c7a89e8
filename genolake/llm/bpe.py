"""Operator 7: byte-level BPE encoding and decoding by a depth-first walk over a trie of distinct words."""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import small_batches, table

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 300_000
LONGEST_CACHED = 64


def printable_bytes() -> dict[str, int]:
    """The published one-character names of the 256 bytes: printable ones stand for themselves, others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """Exact BPE in one pass over each distinct prefix.

    A token sequence is what the merges give just if every two neighbours in it are (each pair, merged on its own, comes
    out unchanged). So the last token of a prefix is the only token that ends it and agrees with the last token of what
    stands before. The words of a batch, sorted, are a depth-first traversal of their trie; the stack of last tokens is
    kept down to the prefix that a word shares with the one before it, hence shared prefixes are computed once.
    """

    def __init__(self, spec: str):
        model, names = (made := json.loads(spec))["model"], printable_bytes()
        raw = {t: bytes(map(names.__getitem__, t)) for t in model["vocab"] if set(t) <= names.keys()}
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of = {ids[t]: b for t, b in raw.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.of_byte = {b: ids[c] for c, b in names.items()}
        whole = {raw[t]: i for t, i in ids.items() if t in raw and t not in self.special}
        self.id_of = {b: i for b, i in whole.items() if self.merge(b) == [i]}
        self.parts = {made: (rank, *pair) for pair, (rank, made) in reversed(self.ranks.items())}
        found: dict[bytes, set[int]] = {}
        for word in self.id_of:
            found.setdefault(word[-2:], set()).add(len(word))
        self.lengths = {end: sorted(sizes, reverse=True) + [1] * (len(end) > 1) for end, sizes in found.items()}
        self.agreed: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.split = regex.compile(WORDS)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of a short word: the lowest-ranked pair is merged first."""
        out = [self.of_byte[b] for b in word]
        while len(out) > 1:
            best = min((self.ranks.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(out, out[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def agree(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are side by side: undoing their merges, the latest first, no pair over the border
        may have been due before the merge that used up one of its halves. Equal ranks are merged from the left."""
        if (known := self.agreed.get((a, b))) is not None:
            return known
        if len(self.agreed) > 1_000_000:
            self.agreed.clear()
        x, y, limit, base = a, b, 1 << 60, (-1, 0, 0)
        while True:
            if self.ranks.get((x, y), (1 << 60,))[0] < limit:
                known = False
                break
            left, right = self.parts.get(x, base), self.parts.get(y, base)
            if left[0] > right[0]:
                limit, x = left[0], left[2]
            elif right[0] >= 0:
                limit, y = right[0] + 1, right[1]
            else:
                known = True
                break
        self.agreed[a, b] = known
        return known

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as little-endian unsigned 32-bit integers)."""
        before, last = b"", [-1]
        id_of, lengths, agree, agreed, one = self.id_of, self.lengths, self.agree, self.agreed, (1,)
        size_of = self.size_of
        for word, text in sorted(((w.encode(), w) for w in words)):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in lengths.get(word[max(0, end - 2) : end], one):
                    if size <= end and (t := id_of.get(word[end - size : end])) is not None:
                        if size == end:
                            break
                        if (ok := agreed.get((last[end - size], t))) or (ok is None and agree(last[end - size], t)):
                            break
                last.append(t)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size_of[last[end]]
            before = word
            yield text, np.array(ids[::-1], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian. Words are gathered over all texts before the trie is walked."""
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        parts: list[list[tuple[bool, list[str]]]] = []
        new: set[str] = set()
        for text in texts:
            own = []
            for piece in self.split_special.split(text) if self.split_special else [text]:
                if piece in self.special:
                    own.append((True, [piece]))
                elif piece:
                    own.append((False, words := self.split.findall(piece)))
                    new.update(set(words).difference(self.cache))
            parts.append(own)
        known, once = self.cache, {}
        for word, ids in self.encode_words(new):
            (known if len(word) <= LONGEST_CACHED else once)[word] = ids
        if once:
            known = ChainMap(once, known)
        of_special = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        return [b"".join([b"".join(map((of_special if s else known).__getitem__, words)) for s, words in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_made: dict[int, TrieBpe] = {}


def encoder(spec: str) -> TrieBpe:
    """One encoder for each vocabulary and Python worker."""
    if (key := hash(spec)) not in _made:
        _made.clear()
        _made[key] = TrieBpe(spec)
    return _made[key]


def chunks(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters together, at least one text each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, spec: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded[, digests]) of each row; a null text counts as empty, repeated rows stay.

    keep: return ids (binary, little-endian unsigned 32-bit integers) and the decoded text; else only their sha256.
    spec: the tokenizer file's content, read on the driver and broadcast (a vocabulary file has a fixed size).
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for part in chunks(texts):
                for ids in bpe.encode(part):
                    text = bpe.decode(ids)
                    out.append((len(ids) // 4, ids, text) if keep else (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, ids, text = zip(*out, strict=True) if out else ((), (), ())
            kinds = (pa.binary() if keep else pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(text, kinds[1])], names)

    names = ["doc_id", "n_tokens", *(("ids", "decoded") if keep else ("ids_sha256", "decoded_sha256"))]
    small_batches(docs.sparkSession)
    schema = f"doc_id long, n_tokens long, {names[2]} {'binary' if keep else 'string'}, {names[3]} string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text, as digests, of all rows of documents; null texts count as empty, repeated rows and null ids
    stay, very long texts are encoded whole."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return encode(table(spark, sf_dir, "documents"), f.read(), keep=False)
