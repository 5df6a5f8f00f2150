"""SentencePiece merge encoding by a prefix table, and decoding (operator 6).

Every prefix of a text has one last token in the encoding of that prefix. The
table is filled from left to right: an automaton lists the vocabulary pieces
that end at a place, and the one that is compatible with the last token of the
shorter prefix is stored. Ids are then recovered backwards from the end.

Two tokens are compatible if merging in order of score would keep their common
border: undoing their merges in time order, no pair across the border may have
been merged earlier than the merge that hides it.

No piece holds a blank after another letter, so a text is encoded run by run
between blanks; a bounded worker cache keeps the runs. Runs that start with
several blanks hold pieces of equal score, which the order above does not
define; the library encodes those runs.

Defined cases: null text is empty (no ids, both digests of the empty string);
letters outside the vocabulary become byte pieces; equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Generations, documents, session, small_batches

CACHE = 120_000
BLANK = "▁"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_RUN = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class PrefixEncoder:
    """Encodes and decodes with one merge-type model."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(names)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        by_name = {names[i]: i for i in plain if BLANK * 2 not in names[i]}
        # The order of merges; single letters come before all of them.
        merged = sorted((i for n, i in by_name.items() if len(n) > 1), key=lambda i: -lib.get_score(i))
        self.rank = {i: -1 for n, i in by_name.items() if len(n) == 1} | {i: k for k, i in enumerate(merged)}
        self.joined = {}
        for i in merged:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = by_name.get(name[:cut]), by_name.get(name[cut:])
                if a is not None and b is not None:
                    self.joined[a, b] = self.rank[i]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        found = ahocorasick.Automaton()
        for name, i in by_name.items():
            if len(name) == 1:
                found.add_word(name, (i, 1))
        for i in merged:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = by_name.get(name[:cut]), by_name.get(name[cut:])
                if a in self.left or a is not None and self.rank[a] < 0:
                    if b in self.left or b is not None and self.rank[b] < 0:
                        if self._compatible(a, b, self.rank[i]):
                            self.left[i], self.right[i] = a, b
                            found.add_word(name, (i, len(name)))
                            break
        found.make_automaton()
        self.matches, self.letters = found.iter, {n for n in by_name if len(n) == 1}
        self.runs = Generations(self._run, CACHE)

    def _compatible(self, a: int, b: int, limit: float = float("inf")) -> bool:
        rank = self.rank
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _known(self, text: str) -> list[int]:
        """Ids of a text that has only letters of the vocabulary."""
        last: list = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, length) in self.matches(text):
            if last[end + 1] is not None:
                continue
            start = end + 1 - length
            if start:
                before = last[start][0]
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    fits = pairs[key] = self._compatible(before, token)
                if not fits:
                    continue
            last[end + 1] = token, length
        ids, at = [], len(text)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        return ids[::-1]

    def _run(self, run: str) -> tuple[tuple[int, ...], str]:
        if run.startswith(BLANK * 2):
            ids = self.library.encode(run[1:].replace(BLANK, " "))
        elif self.letters.issuperset(run):
            ids = self._known(run)
        else:
            ids, start = [], 0
            for at, letter in enumerate(run):
                if letter not in self.letters:
                    ids += self._known(run[start:at])
                    ids += [self.bytes[b] for b in letter.encode()]
                    start = at + 1
            ids += self._known(run[start:])
        return tuple(ids), ",".join(map(str, ids))

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        if "\0" in text:
            ids = self.library.encode(text)
            return [(tuple(ids), ",".join(map(str, ids)))]
        if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
            runs = _RUN.findall(BLANK + text.replace(" ", BLANK))
        else:
            # A line end is no letter of the vocabulary, so runs end there too.
            runs = []
            for word in text.split(" "):
                if "\n" in word:
                    first, *rest = word.split("\n")
                    runs.append(BLANK + first)
                    for w in rest:
                        runs.append("\n")
                        if w:
                            runs.append(w)
                else:
                    runs.append(BLANK + word)
        return list(map(self.runs.__getitem__, runs))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.parts(text)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(2)
def encoder(model: str) -> PrefixEncoder:
    return PrefixEncoder(model)


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    small_batches(session(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        own = encoder(model)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                parts = own.parts(text or "")
                ids = list(chain.from_iterable([p[0] for p in parts]))
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([p[1] for p in parts if p[1]]).encode()).hexdigest())
                of_text.append(hashlib.sha256((own.decode(ids) if ids else "").encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
