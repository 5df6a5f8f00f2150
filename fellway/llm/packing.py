"""Packing by best-fit decreasing over a segment tree (operator 7).

Documents become token ids plus an end id. A document longer than a window is
first cut into full windows; what remains is placed, longest pieces first, into
the open window with the least room that still holds it. A segment tree indexed
by remaining capacity finds that window.

The packing depends on the pieces' lengths alone, so it is planned once over the
histogram of lengths, which has at most ``window`` entries whatever the corpus:
the driver never sees documents. Windows that hold the same lengths are kept as
intervals of ids. The plan maps (length, rank among the pieces of that length)
to a window id and an offset; each piece gets its rank from a count per
(length, group of documents), so no task ever ranks all pieces of a length.

Defined cases: null text is empty and gives one piece, the end id alone; equal
documents are placed separately; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Generations, documents, session, small_batches, written

WINDOW, END_ID = 2048, 1
CACHE = 250_000
#: Documents are dealt into this many groups for ranking; a group's pieces of
#: one length are ranked by one task.
DOCS_PER_GROUP = 4000
#: Letters beyond Latin: the library itself encodes those words.
_OTHER = re.compile("[^\x00-ɏ]")


class WordEncoder:
    """Ids of a text under a word-end vocabulary, word by word through a bounded cache.

    White space only separates words in this kind of vocabulary, so words between
    blanks and line ends are encoded on their own. A word's last letter is marked
    by the byte 0xFF, which UTF-8 never uses: the marked letters are then the
    first merges, and a rank table gives the same result as the merge list.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(model, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        # The printable alphabet of byte-level vocabularies, by its rule.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}

        def raw(token: str) -> bytes:
            core = token.removesuffix(suffix)
            return bytes(byte_of[c] for c in core) + (b"\xff" if core != token else b"")

        letters = {raw(t): i for t, i in vocabulary.items() if t not in self.special and len(t.removesuffix(suffix)) == 1}
        order = [(bytes([b, 255]), letters[bytes([b, 255])]) for b in range(256) if bytes([b, 255]) in letters]
        order += [(raw(a + b), vocabulary[a + b]) for a, b in spec["model"]["merges"]]
        order += [(bytes([b]), letters.get(bytes([b]), 0)) for b in range(256)]
        ranks = {token: k for k, (token, _) in enumerate(order)}
        if len(ranks) != len(order):
            raise ValueError("two merges of this vocabulary make the same token")
        self.ids = np.array([i for _, i in order], "<u4")
        self.merges = tiktoken.Encoding("ranks", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split).findall
        self.words = Generations(self._word, CACHE)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if _OTHER.search(word) or any(s in word for s in self.special):
            return self._library(word)
        merge = self.merges._encode_single_piece
        found = [k for piece in self.split(unicodedata.normalize("NFC", word).lower()) for k in merge(piece.encode() + b"\xff")]
        return self.ids[found].tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(2)
def word_encoder(model: str) -> WordEncoder:
    return WordEncoder(model)


class CapacityTree:
    """A segment tree over remaining capacities 0..window; leaves count open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least with an open window."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    at += not self.count[at]
                return at - self.size
            at >>= 1
        return None


def plan_packing(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over a histogram of piece lengths.

    Returns rows (length, first rank, first window, offset) sorted by length and
    rank, and the number of windows. A row's ranks run up to the next row of the
    same length; rank r goes to window ``first window + r - first rank``.
    """
    tree, open_ = CapacityTree(window), {}
    rows: list[tuple[int, int, int, int]] = []
    windows = 0

    def keep(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                # No open window holds it: open as many as these pieces fill.
                each = window // length
                n = -(-left // each)
                first, windows = windows, windows + n
                # Piece by piece a new window is filled before another is opened.
                full, over = divmod(left, each)
                for k in range(each):
                    m = full + (k < over)
                    if m:
                        rows.append((length, rank, first, k * length))
                        rank += m
                keep(window - each * length, first, full)
                if over:
                    keep(window - over * length, first + full, 1)
                left = 0
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
                each = capacity // length
                full, over = divmod(left, each)
                if full >= n:
                    full, over = n, 0
                used = full + (over > 0)
                for k in range(each):
                    m = full + (k < over)
                    if m:
                        rows.append((length, rank, first, window - capacity + k * length))
                        rank += m
                keep(capacity - each * length, first, full)
                if over:
                    keep(capacity - over * length, first + full, 1)
                keep(capacity, first + used, n - used)
                left -= full * each + over
    table = np.array(sorted(rows), "int64").reshape(-1, 4)
    return table, windows


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_pieces(docs: DataFrame, model: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows and what remains of each document, with the ids' checksum."""
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        own = word_encoder(model)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = own.encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, model: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark = session(docs)
    small_batches(spark)
    model = model or public_tokenizers.path("word_bpe_49k.json")
    pieces = written(cut_pieces(docs, model, window, end_id), "pieces")
    groups = max(1, -(-pieces.count() // DOCS_PER_GROUP))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # One row per (length, group): bounded by window x groups, and ranked by length.
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_packing(histogram, window)[0])
    within = W.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["length", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    )
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(name, pa.int64()) for name in fields])

    def place(batches):
        table = plan.value
        stride = int(table[:, 1].max() + 1 if len(table) else 1)
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1
            place_ = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields[:5]), *place_], schema=schema)

    return ranked.mapInArrow(place, ", ".join(f"{name} bigint" for name in fields))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
