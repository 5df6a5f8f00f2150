"""Token counts by a map-side two-tier lookup (operator 5).

Tier one is a compact broadcast table from frequent pre-tokens to their token
counts; tier two is a bounded cache in each Python worker that encodes what the
table lacks. Both give exactly what the vocabulary gives, so the choice of the
frequent pre-tokens affects speed alone. Documents never leave their partition:
there is no shuffle of pre-tokens or texts.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings in
a text are matched as the library's default does; equal texts give equal counts; null
and repeated doc_ids pass through;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Generations, documents, session, small_batches

#: About how many documents the frequent pre-tokens are drawn from, and how many are kept.
SAMPLE_DOCS, FREQUENT = 1500, 1 << 16
#: Characters of a sampled text that are tallied at once.
STRETCH = 1 << 20
#: Entries of a worker's cache.
CACHE = 300_000
LIMIT = 512

#: White space other than single blanks and line ends, or two in a row.
_UNEVEN = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]|[ \n][ \n]")
#: Letters beyond Latin: the library itself splits those runs.
_OTHER = re.compile("[^\x00-ɏ]")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


@lru_cache(2)
def _vocabulary(model: str):
    """(count of one pre-token, count of any text, special strings), built once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(model)
    ranks_file = os.path.splitext(model)[0] + ".tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
    merges = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(public_tokenizers.PATTERN)
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def one(piece: str) -> int:
        return len(merges._encode_single_piece(piece.encode()))

    def whole(text: str) -> int:
        return len(full.encode(text, add_special_tokens=False).ids)

    return one, whole, pattern.findall, special


class _Counts:
    """Counts of runs between blanks; a run is one or more pre-tokens."""

    def __init__(self, model: str, frequent: dict[str, int]):
        one, self.whole, self.split, self.special = _vocabulary(model)
        self.pieces = Generations(one, CACHE)
        self.frequent = frequent
        self.runs = Generations(self._run, CACHE)

    def _run(self, run: str) -> int:
        if _OTHER.search(run):
            return self.whole(run)
        total = 0
        for piece in self.split(run):
            n = self.frequent.get(piece)
            total += self.pieces[piece] if n is None else n
        return total

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.whole(text)
        if _UNEVEN.search(text):
            return self._run(text)
        # Single blanks belong to the run after them and line ends stand alone.
        runs, lines = self.runs, text.split("\n")
        total = (len(lines) - 1) * runs["\n"]
        for line in lines:
            first, *rest = line.split(" ")
            if first:
                total += runs[first]
            total += sum(map(runs.__getitem__, [" " + w for w in rest]))
        return total


_WORKER: dict[str, _Counts] = {}


def frequent_pieces(docs: DataFrame, model: str) -> dict[str, int]:
    """The broadcast tier: token counts of the most frequent pre-tokens of a bounded sample."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def tally(batches):
        split = _vocabulary(model)[2]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                # Bounded stretches, so that a very long text is tallied a part at a time.
                for at in range(0, len(text or ""), STRETCH):
                    seen = Counter(split(text[at : at + STRETCH]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    def encoded(batches):
        one = _vocabulary(model)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array([one(p) for p in batch.column("piece").to_pylist()], pa.int64())], schema=schema)

    # A share of the rows by a hash of id and text, tallied where they are read.
    keep = max(1, -(-docs.count() // SAMPLE_DOCS))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(keep)) == 0).select("text")
    often = sample.mapInArrow(tally, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "piece").limit(FREQUENT)
    return {r.piece: r.n for r in often.mapInArrow(encoded, "piece string, n bigint").collect()}


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    model = model or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(session(docs))
    table = session(docs).sparkContext.broadcast(frequent_pieces(docs, model))

    def count(batches):
        counts = _WORKER.get(model)
        if counts is None or counts.frequent is not table.value:
            counts = _WORKER[model] = _Counts(model, table.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]},
                pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
