"""Substring dedup over words by suffix automata (operator 8).

A window is 13 consecutive words of one document; a word goes if a window that
covers it also starts in a document with a smaller doc_id. Documents stream
through suffix automata of reference passages: the automaton gives, at each
word, the length of the longest run ending there that a reference holds
(matching statistics), and every run of 13 words or more is removed.

The reference of a document is all documents before it, which is no set that
could be broadcast. So references are sent only where they match: documents are
dealt once into chunks by ranges of doc_id; each chunk sends the hashes of its
windows to buckets; a bucket finds the chunks behind the first that hold a hash,
and names for each of them a holder before it that sends it the passage. Holders
form a tree, so a passage that all chunks hold is sent by each to ``FANOUT`` others
at most. Each chunk then builds automata of bounded size over the passages it
received and over the runs its own earlier documents share with later ones. The
automata compare words, so a wrong hash match removes nothing.

Defined cases: null text has no words; rows that repeat a doc_id are not smaller
than each other; separators are blank, tab, line end, vertical tab, form feed and
carriage return; a null doc_id counts as larger than any other; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import BLOCK_BYTES, PrefixHash, carried_column, chunked, grouped, id_of, numbers, rank_of, to_buckets, unpack
from ._common import documents

WINDOW = 13
#: Words of reference passages in one automaton, and chunks that one holder of a passage serves.
SHARD_WORDS, FANOUT = 100_000, 8
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class SuffixAutomaton:
    """A suffix automaton over words, of any number of passages."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.words = [-1], [0], 0

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        self.words += len(words)
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            p = last
            if q is None:
                at = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = at
                    p = link[p]
                if p < 0:
                    last = at
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[at] = q
                    last = at
                    continue
            else:
                at = -1
            twin = len(nxt)
            nxt.append(nxt[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = twin
                p = link[p]
            link[q] = twin
            if at >= 0:
                link[at] = twin
                last = at
            else:
                last = twin

    def ends(self, words: list[bytes], least: int) -> list[int]:
        """Where a run of at least ``least`` words that some passage holds ends."""
        nxt, link, length = self.next, self.link, self.length
        at, n, found = 0, 0, []
        for k, w in enumerate(words):
            to = nxt[at].get(w)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(w)
            if to is not None:
                at, n = to, n + 1
                if n >= least:
                    found.append(k)
        return found


class Shards:
    """Reference shards: automata of bounded size; a passage lies whole in one."""

    def __init__(self, most: int = SHARD_WORDS):
        self.most, self.all = most, []

    def add(self, words: list[bytes]) -> None:
        if not self.all or self.all[-1].words + len(words) > self.most and self.all[-1].words:
            self.all.append(SuffixAutomaton())
        self.all[-1].add(words)

    def ends(self, words: list[bytes], least: int) -> list[int]:
        return [k for automaton in self.all for k in automaton.ends(words, least)]


class Words:
    """Word places and window hashes of a list of texts."""

    def __init__(self, texts: list[bytes], window: int):
        starts, stops, docs, hashes, self.offsets, at = [], [], [], [], [], 0
        lengths = [len(t) for t in texts]
        first_word = 0
        spans = []
        for a, b in grouped(lengths):
            data = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
            space = _SPACE[data]
            edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
            begin, end = edge[::2], edge[1::2]
            base = np.concatenate([[0], np.cumsum([n + 1 for n in lengths[a:b]])])
            doc = np.searchsorted(base, begin, "right") - 1
            by_word = PrefixHash(PrefixHash.of_bytes(data).spans(begin, end))
            window_hash = by_word.every(window)
            whole = doc[: len(window_hash)] == doc[window - 1 :] if len(window_hash) else np.zeros(0, bool)
            hashes.append(window_hash[whole])
            spans.append(first_word + np.flatnonzero(whole))
            starts.append(begin - base[doc])
            stops.append(end - base[doc])
            docs.append(doc + a)
            first_word += len(begin)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.stop, self.doc = join(starts, np.int64), join(stops, np.int64), join(docs, np.int64)
        #: Hash and first word of each window, in order of place.
        self.hash, self.at = join(hashes, np.uint64), join(spans, np.int64)
        self.texts = texts

    def passage(self, first: int, last: int) -> bytes:
        """Text from one word to another of the same document, ends included."""
        return self.texts[self.doc[first]][self.start[first] : self.stop[last]]

    def runs(self, at: np.ndarray, window: int, gap: int) -> list[tuple[int, int]]:
        """Windows in order, joined where they start at most ``gap`` words apart, as (first word, last word)."""
        if not len(at):
            return []
        new = np.flatnonzero((np.diff(at) > gap) | (np.diff(self.doc[at]) > 0)) + 1
        return [(int(p[0]), int(p[-1]) + window - 1) for p in np.split(at, new)]


def shared_words(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, carried: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank).

    ``carried`` adds ``whole``, the text as it is where no word goes, else null, and
    ``carried.row``, a struct of the other columns: rows stay whole without a join.
    """
    blocks, plan = chunked(docs, chunk_bytes, carried)
    buckets, ranks = max(1, plan.chunks // 4), plan.own  # of heavy ids alone: as many as are sampled at most
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())])
    asked = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary()), ("targets", pa.binary())])
    given = pa.schema([("chunk", pa.int32()), ("passages", pa.list_(pa.binary()))])
    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def window_hashes(table: pa.Table) -> pa.Table:
        out = to_buckets(np.unique(Words(unpack(table)[1], window).hash), buckets)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": [b for b, _ in out], "chunk": [chunk] * len(out), "hashes": [h.tobytes() for _, h in out]}, schema=sent)

    def first_holders(table: pa.Table) -> pa.Table:
        parts, own = numbers(table.column("hashes"), "<u8"), table.column("chunk").to_numpy()
        h, c = np.concatenate(parts), np.repeat(own.astype(np.int64), [len(p) for p in parts])
        by = np.lexsort((c, h))
        h, c = h[by], c[by]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        nth = np.arange(len(h)) - start
        # Whoever holds a hash may send it once a chunk of a smaller rank holds it too.
        asks = rank_of(ranks, c) > rank_of(ranks, c[start])
        first = c[start + np.maximum(nth - 1, 0) // FANOUT]
        h, c, first = h[asks], c[asks], first[asks]
        by = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[by])) + 1
        groups = [g for g in np.split(by, cuts) if len(g)]
        return pa.table({"chunk": [int(first[g[0]]) for g in groups], "hashes": [h[g].tobytes() for g in groups], "targets": [c[g].astype("<i4").tobytes() for g in groups]}, schema=asked)

    def send_passages(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return given.empty_table()
        words = Words(unpack(left)[1], window)
        h, c = np.concatenate(numbers(right.column("hashes"), "<u8")), np.concatenate(numbers(right.column("targets"), "<i4"))
        # The first place of each hash: documents are in order of doc_id.
        held, place = np.unique(words.hash, return_index=True)
        at = words.at[place[np.searchsorted(held, h)]]
        order = np.lexsort((at, c))
        at, c = at[order], c[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        out = [(int(c[g[0]]), [words.passage(a, b) for a, b in words.runs(at[g], window, 1)]) for g in np.split(np.arange(len(c)), cuts) if len(g)]
        return pa.table({"chunk": [t for t, _ in out], "passages": [p for _, p in out]}, schema=given)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return final.empty_table()
        ids, texts, *more = unpack(left, carried=carried)
        words = Words(texts, window)
        before, inside = Shards(shard_words), Shards(shard_words)
        passages = [p for some in right.column("passages").to_pylist() for p in some]
        for p in passages:
            before.add(p.split())
        # Candidates: windows with a hash of a received passage, or of two documents of this chunk.
        known = np.unique(Words(passages, window).hash)
        value, back = np.unique(words.hash, return_inverse=True)
        doc_of = words.doc[words.at]
        own = np.zeros(len(value), bool)
        if len(value):
            low, high = np.full(len(value), len(texts)), np.zeros(len(value), np.int64)
            np.minimum.at(low, back, doc_of)
            np.maximum.at(high, back, doc_of)
            own = low < high
        repeated = own[back]
        candidate = repeated | np.isin(value, known, assume_unique=True)[back]
        lost = np.zeros(len(words.start) + 1, np.int64)
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for a, b in words.runs(words.at[candidate], window, window):
            by_doc.setdefault(int(words.doc[a]), []).append((a, b))
        later: dict[int, list[tuple[int, int]]] = {}
        for a, b in words.runs(words.at[repeated], window, window):
            later.setdefault(int(words.doc[a]), []).append((a, b))
        waiting: list[int] = []
        for d in sorted(by_doc):
            if waiting and ids[waiting[0]] != ids[d]:
                for w in waiting:
                    for a, b in later.get(w, ()):
                        inside.add(words.passage(a, b).split())
                waiting = []
            for a, b in by_doc[d]:
                run = words.passage(a, b).split()
                for shards in (before, inside):
                    for k in shards.ends(run, window):
                        lost[a + k - window + 1] += 1
                        lost[a + k + 1] -= 1
            waiting.append(d)
        gone = np.cumsum(lost[:-1]) > 0
        cut = np.searchsorted(words.doc, np.arange(len(texts) + 1))
        rows = []
        for d, text in enumerate(texts):
            all_words, own_gone = text.split(), gone[cut[d] : cut[d + 1]]
            removed = int(own_gone.sum())
            kept = [w for w, g in zip(all_words, own_gone.tolist()) if not g] if removed else all_words
            rows.append((id_of(ids[d]), len(all_words), removed, b" ".join(kept).decode()))
        made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), final.types)], schema=final)
        if carried:
            none = pc.struct_field(more[0], "none").to_pylist()
            whole = [None if r[2] or no else text.decode() for r, text, no in zip(rows, texts, none)]
            made = made.append_column("whole", pa.array(whole, pa.string())).append_column("carried", more[0])
        return made

    result = T.StructType.fromDDL(SCHEMA)
    if carried:
        result = result.add("whole", T.StringType()).add("carried", docs.select(carried_column(docs)).schema["carried"].dataType)
    hashes = blocks.groupBy("chunk").applyInArrow(window_hashes, "bucket int, chunk int, hashes binary")
    requests = hashes.groupBy("bucket").applyInArrow(first_holders, "chunk int, hashes binary, targets binary")
    passages = blocks.groupBy("chunk").cogroup(requests.groupBy("chunk")).applyInArrow(send_passages, "chunk int, passages array<binary>")
    return blocks.groupBy("chunk").cogroup(passages.groupBy("chunk")).applyInArrow(remove, result)


def op8_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of all documents; a word goes if a window over it starts in an earlier document.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS k FROM d
), windows AS MATERIALIZED (
  SELECT r, doc_id, k, sha256(array_to_string(w[k:k + 12], ' ')) AS s FROM places
), first_doc AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s
), covered AS (
  SELECT DISTINCT r, k + o AS p FROM windows JOIN first_doc USING (s), range(0, 13) t(o) WHERE least < doc_id
), words AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
