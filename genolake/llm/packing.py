"""Operator 3: first-fit-decreasing packing with a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from genolake.llm.bpe import printable_bytes
from genolake.llm.common import Scratch, free_name, small_batches, table

MAX_TOKENS = 2048
END_ID = 1
GROUP_PIECES = 4096
CACHED_WORDS = 400_000
LONGEST_CACHED = 64


BYTE_NAMES = {b: c for c, b in printable_bytes().items()}
#: Words of these letters and signs alone need no normalising but lower case: each is one composed character.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the vocabulary's published splitting pattern, for lower-case words of such characters.
NORMALISERS, PATTERN = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def has_known_rules(spec: dict) -> bool:
    """Whether the file normalises and splits by the rules that the short cut for plain words stands for."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds, steps = [x.get("type") for x in normal.get("normalizers", [])], split.get("pretokenizers", [])
    return kinds == NORMALISERS and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": PATTERN}


class WordIds:
    """Ids of texts by the tokenizers library, asked once for each distinct run between ASCII white space.

    The vocabulary drops white space before it splits words, and neither its normaliser nor its patterns reach over
    ASCII white space, so the ids of a text are those of its runs one after another. Runs of plain letters and signs go
    straight to the library's model, part by part; all others go through the whole tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = "<|" if any("<|" in t.content for t in self.tokenizer.get_added_tokens_decoder().values()) else "<"
        self.model = self.tokenizer.model
        self.short_cut = has_known_rules(json.loads(spec))
        self.cache: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            named = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_NAMES)
            ids = np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()
            if len(part) <= LONGEST_CACHED:
                self.parts[part] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.short_cut and PLAIN.fullmatch(text) and self.specials not in text:
            return b"".join(map(self.part, PLAIN_SPLIT.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.split()
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            pass
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        if len(self.parts) > CACHED_WORDS:
            self.parts = {}
        found = {w: self.word(w) for w in set(words).difference(self.cache)}
        self.cache.update((w, i) for w, i in found.items() if len(w) <= LONGEST_CACHED)
        return b"".join([found[w] if w in found else self.cache[w] for w in words])


_made: dict[int, WordIds] = {}


def word_ids(spec: str) -> WordIds:
    if (key := hash(spec)) not in _made:
        _made.clear()
        _made[key] = WordIds(spec)
    return _made[key]


def pieces(docs: DataFrame, spec: str, most: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and its end id, cut every `most` ids.

    A null text counts as empty and gives one piece with the end id alone. Repeated rows give repeated pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        words = word_ids(shared.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.encode(text or b"") + end
                total = len(ids) // 4
                for start in range(0, total, most):
                    part = ids[4 * start : 4 * (start + most)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, *[part] * keep_ids))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def first_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Each inner node of the tournament tree holds the largest room among its bins, so the
    first bin with room enough is found on one way down from the root."""
    n = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [most] * (2 * n)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[item]), 1
        while node < n:
            node = 2 * node + (room[2 * node] < size)
        bins[item], offsets[item] = node - n, most - room[node]
        room[node] -= size
        node >>= 1
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node >>= 1
    return bins, offsets


def pack(items: DataFrame, most: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to rows with a column `length` (1 to `most`).

    Rows are dealt to random groups of about group_pieces by their place in the written table, not by a key, so one key
    with many rows does not make a large group. Groups are packed on their own; the number of groups follows the input.
    """
    spark = items.sparkSession
    place, dealt_to = free_name(items, "place"), free_name(items, "dealt_to")
    kept = Scratch(spark, "packing").save(items.withColumn(place, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-kept.count() // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(place)
        number = group.column(dealt_to)[0].as_py() if len(group) else 0
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy().astype(np.int64), most)
        group = group.drop_columns([place, dealt_to])
        return group.append_column("sequence_id", pa.array(bins + number * (1 << 24))).append_column("offset", pa.array(offsets))

    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    dealt = kept.withColumn(dealt_to, F.pmod(F.xxhash64(place, F.lit(seed)), F.lit(groups)))
    return dealt.groupBy(dealt_to).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, spec: str, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its sequence and offset there; see pieces() and pack()."""
    return pack(pieces(docs, spec, keep_ids=keep_ids))


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's content; path: by default the installed 49k word vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All rows of documents packed; null and empty texts are the end token alone. Equal texts are packed as often as they
    occur; of bins that fit, the first is taken; texts of any length are cut into pieces."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(path))
