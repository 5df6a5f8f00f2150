"""Exact substring dedup over bytes by hash-compared suffix sorting (operator 2).

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else, in the same document or another; strings are judged on the input.

Sorting the suffix at every byte needs more disk than the corpus itself, so only
sparse suffixes are sorted. Of the hashes of all ``anchor``-byte strings inside a
window of ``width`` bytes the least one picks the window's anchor, and equal
windows pick it at the same place. The windows that picked one anchor lie side by
side; the bytes they cover are the anchor's context.

1. Blocks of documents send (anchor hash, context hash, context digest) to
   buckets, which tell who shows what: of a context that occurs twice or more, two
   occurrences; of an anchor with several contexts, one of each at least. Further
   occurrences of a shown context follow by its two hashes, of different kinds.
2. The bytes of what is shown go to a bucket. There the suffixes at its windows are
   sorted (``sorted_suffixes``): a mergesort in which two suffixes are compared by their
   common extension, found by binary search over prefix polynomial hashes, so in a
   logarithmic number of steps. Neighbours with a common extension of ``width`` bytes
   are repeats.
3. Collision verification: neighbours in the sorted order are compared by their
   bytes. Where a colliding hash has put them into a wrong order, those suffixes
   are sorted by their bytes instead. So a collision changes no result.
4. A block removes the spans of its repeated contexts and windows.

Hot anchors: a passage that a third of all documents share gives its first and
last anchors as many contexts. A block that holds over ``HOT`` contexts of an anchor
sends one mark instead of them, and the windows of a hot anchor go to buckets by
their own hash, with a digest that verifies it, not to the anchor's bucket.

Defined cases: null text is empty; matches never cross documents; texts under
``width`` bytes keep everything; long texts are worked through in pieces of
``PIECE`` windows; repeated rows are each other's repeats; rows with a null doc_id
take part like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import BLOCK_BYTES, PrefixHash, content_blocks, give_back, id_of, mixed, numbers, to_buckets, unpack
from ._common import documents, text_bytes, written

WIDTH, ANCHOR = 400, 300
#: Windows handled at once, bytes of text per bucket, contexts of one anchor in a block or bucket above which it is hot.
PIECE, BUCKET_BYTES, HOT, HOT_BUCKET = 1 << 18, 16 << 20, 32, 2048
#: Buckets of the sort for each bucket of anchors.
SORT_BUCKETS = 6
SCHEMA = "doc_id bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept_sha256 string, kept binary"
_PLACE_BITS = np.uint64(32)
#: What a bucket answers about a context: it is repeated by its hashes; show its first
#: occurrence; go by single windows; show its second occurrence too.
REPEATED, SORT, SPREAD, SECOND = 1, 2, 4, 8
_ONE = np.uint64(1)
_SPREAD = 0xD6E8FEB86659FD93
_NO_U8 = np.zeros(0, np.uint64)


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the first least hash (by its upper half) among each ``span`` neighbours."""
    n = len(hashes)
    keys = hashes >> _PLACE_BITS << _PLACE_BITS | np.arange(n, dtype=np.uint64)
    size = -(-n // span) * span
    padded = np.full(size, ~np.uint64(0))
    padded[:n] = keys
    blocks = padded.reshape(-1, span)
    # The least up to a place in its block, and the least from a place on.
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    return (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)


class Anchors:
    """Anchors of a list of texts, with the windows that picked them: places are those of the texts laid end to end."""

    def __init__(self, texts: list[bytes], width: int, anchor: int, hash_bits: int = 64):
        self.width, self.mask = width, np.uint64((1 << hash_bits) - 1)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.edges, self.data = edges, np.frombuffer(b"".join(texts), np.uint8)
        parts = [self._piece(at, anchor) for at in range(0, max(0, len(self.data) - width + 1), PIECE)]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        #: Per anchor: its hash, hash and digest of its context, first and last window, the anchor's place.
        self.hash, self.context, self.digest = (join(k, np.uint64) for k in range(3))
        self.low, self.high, self.at = (join(k, np.int64) for k in range(3, 6))

    def _piece(self, begin: int, anchor: int) -> tuple[np.ndarray, ...]:
        data, width, edges = self.data[begin : begin + PIECE + self.width - 1], self.width, self.edges
        prefix = PrefixHash.of_bytes(data)
        hashes = prefix.every(anchor) & self.mask
        picked = least_places(hashes, width - anchor + 1)
        # Windows that end inside their own document.
        a, b = np.searchsorted(edges, [begin, begin + len(picked)], "right")
        own = np.clip(edges[a - 1 : b + 1], begin, begin + len(picked))
        stop = np.repeat(edges[a : a + len(own) - 1], np.diff(own))
        starts = np.flatnonzero(np.arange(begin, begin + len(picked)) + width <= stop)
        picked = picked[starts]
        if not len(starts):
            return _NO_U8, _NO_U8, _NO_U8, *[np.zeros(0, np.int64)] * 3
        new = np.flatnonzero((np.diff(picked) != 0) | (np.diff(starts) != 1)) + 1
        first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(starts) - 1]])
        low, high, at = starts[first], starts[last], picked[first]
        # Least hashes are small numbers; mixed again, they spread over all buckets.
        anchor_hash = mixed(hashes[at] ^ np.uint64(_SPREAD))
        context = (prefix.spans(low, high + width) ^ mixed((high - low).astype(np.uint64) << np.uint64(32) | (at - low).astype(np.uint64))) & self.mask
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        check = np.fromiter((digest(view[x:y]) for x, y in zip(low.tolist(), (high + width).tolist())), np.uint64, len(low))
        return anchor_hash, context, check & ~_ONE, low + begin, high + begin, at + begin

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts in order of (anchor hash, context, digest): the first of each, how many, and each anchor's group. A second one's place follows the first in ``self.order``."""
        order = self.order = np.lexsort((self.digest, self.context, self.hash))
        if not len(order):
            return order, order, order
        a, c, d = self.hash[order], self.context[order], self.digest[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])), group


class Suffixes:
    """Suffixes of a byte string, compared up to ``width`` bytes by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, width: int, hash_bits: int = 64):
        self.data, self.width, self.mask = data, width, np.uint64((1 << hash_bits) - 1)
        self.prefix = PrefixHash.of_bytes(data)

    def _same(self, p: np.ndarray, q: np.ndarray, n) -> np.ndarray:
        span = lambda x: mixed((self.prefix.sums[x + n] - self.prefix.sums[x]) * self.prefix.inverse[x]) & self.mask
        return span(p) == span(q)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search over prefix hashes."""
        length = np.where(self._same(p, q, self.width), self.width, 0)
        open_ = np.flatnonzero(length == 0)
        p, q, low = p[open_], q[open_], np.zeros(len(open_), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        while step:
            reach = np.minimum(step, self.width - low)
            low = np.where(self._same(p + low, q + low, reach), low + reach, low)
            step >>= 1
        length[open_] = low
        return length

    def order(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how suffix p stands to suffix q."""
        n = self.common(p, q)
        at = np.minimum(n, self.width - 1)
        return np.where(n >= self.width, 0, np.sign(self.data[p + at].astype(np.int16) - self.data[q + at].astype(np.int16)))


def _merged(suffixes: Suffixes, start: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of suffixes within segments (each element knows its segment's first place and size): bottom-up mergesort.

    All runs of one length are merged at once: an element's new place is its place
    in its own run and how many elements of the sister run stand before it, which
    a binary search finds.
    """
    order, width = np.arange(len(start)), 1
    own = np.arange(len(start)) - first
    while True:
        live = np.flatnonzero(size > width)
        if not len(live):
            return order
        run = own[live] // width
        sister = np.where(run % 2 == 0, run + 1, run - 1) * width
        low = np.zeros(len(live), np.int64)
        most = np.clip(size[live] - sister, 0, width)
        high, base, me = most.copy(), first[live] + sister, start[order[live]]
        left = run % 2 == 0
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            sign = suffixes.order(start[order[base[todo] + middle]], me[todo])
            before = (sign < 0) | ((sign == 0) & ~left[todo])
            low[todo], high[todo] = np.where(before, middle + 1, low[todo]), np.where(before, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        place = first[live] + run // 2 * 2 * width + own[live] - run * width + low
        # Colliding hashes can contradict each other; such a segment is left as it is, for the verification.
        hit = np.zeros(len(order), bool)
        hit[place] = True
        if not hit[live].all():
            torn = np.isin(first[live], first[live][~hit[live]])
            place = np.where(torn, live, place)
        order[place] = order[live]
        width *= 2


def sorted_suffixes(suffixes: Suffixes, start: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeats): suffixes sorted within their segments, and which of them some other of the segment equals.

    Neighbours are verified by their bytes; segments that a collision has misled are
    sorted by their bytes.
    """
    by = np.argsort(segment, kind="stable")
    start, segment = start[by], segment[by]
    new = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(by) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([new, [len(by)]])).astype(np.int64)
    first, size = np.repeat(new, sizes), np.repeat(sizes, sizes)
    order = _merged(suffixes, start, first, size)
    rows = np.lib.stride_tricks.sliding_window_view(suffixes.data, suffixes.width) if len(by) else None
    same = np.zeros(len(by) + 1, bool)
    wrong = []
    pairs = np.flatnonzero(segment[1:] == segment[:-1]) + 1
    for at in range(0, len(pairs), 4096):
        here = pairs[at : at + 4096]
        a, b = rows[start[order[here - 1]]], rows[start[order[here]]]
        differ = a != b
        where = differ.argmax(axis=1)
        equal = ~differ[np.arange(len(here)), where]
        same[here] = equal
        wrong.append(here[~equal & (a[np.arange(len(here)), where] > b[np.arange(len(here)), where])])
    for begin in np.unique(first[np.concatenate(wrong)]).tolist() if wrong else []:
        stop = begin + int(size[begin])
        mine = sorted(order[begin:stop].tolist(), key=lambda k: rows[start[k]].tobytes())
        order[begin:stop] = mine
        texts = [rows[start[k]].tobytes() for k in mine]
        same[begin + 1 : stop] = [x == y for x, y in zip(texts, texts[1:])]
    repeats = np.zeros(len(by), bool)
    repeats[by[order]] = same[:-1] | same[1:]
    return by[order], repeats


def _by_chunk(chunk: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(chunk, kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[order])) + 1
    return [(int(chunk[g[0]]), *(c[g].tobytes() for c in columns)) for g in np.split(order, cuts) if len(g)]


def _made(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    parts = numbers(column.drop_null(), kind)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers of it, then those of the next."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def repeated_bytes(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, texts: bool = True, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, hot_bucket: int = HOT_BUCKET, hash_bits: int = 64
) -> DataFrame:
    """doc_id, n_bytes, starts and stops of the maximal removed runs, kept (the other bytes) and its digest.

    Without ``texts`` the kept bytes stay with the workers and only their digest is
    returned. Fewer ``hash_bits`` make hashes collide, for tests.
    """
    blocks = content_blocks(docs, block_bytes)
    buckets = max(1, int((docs.agg(F.sum(text_bytes("text"))).first()[0] or 0) // bucket_bytes))
    #: What is shown is about as many bytes again, with several numbers a byte beside it while it is sorted.
    sort_buckets = SORT_BUCKETS * buckets
    schema = lambda **of: pa.schema(list(of.items()))
    number, raw, place = pa.int32(), pa.binary(), pa.int64()
    sent = schema(bucket=number, chunk=place, anchors=raw, contexts=raw, digests=raw, groups=raw)
    told = schema(chunk=place, groups=raw, kinds=raw)
    #: Own spans of a chunk (no bucket), or contexts or windows for a bucket.
    shown = schema(bucket=number, chunk=place, starts=raw, stops=raw, anchors=raw, backs=raw, counts=raw, bytes=raw, hashes=raw, digests=raw)
    found = schema(chunk=place, starts=raw, stops=raw)
    places = pa.list_(pa.int64())
    final = schema(doc_id=place, n_bytes=place, starts=places, stops=places, kept_sha256=pa.string(), kept=raw)

    def hot_groups(anchor_hash: np.ndarray) -> np.ndarray:
        """Which of a chunk's distinct contexts, in order of their anchor, belong to an anchor that is hot in the chunk."""
        _, back, n = np.unique(anchor_hash, return_inverse=True, return_counts=True)
        return n[back] > hot

    def send_anchors(table: pa.Table) -> pa.Table:
        give_back()
        own = Anchors(unpack(table, sort=False)[1], width, anchor, hash_bits)
        first, n, _ = own.groups()
        if not len(first):
            return sent.empty_table()
        a, c, d = own.hash[first], own.context[first], own.digest[first] | (n > 1).astype(np.uint64)
        # Of a hot anchor its first context goes along, as a mark with a negative place.
        marked = hot_groups(a)
        keep = np.flatnonzero(~marked | np.concatenate([[True], a[1:] != a[:-1]]))
        group = np.where(marked, -1 - np.arange(len(a)), np.arange(len(a)))[keep].astype("<i8")
        a, c, d, chunk, rows, at = a[keep], c[keep], d[keep], table.column("chunk")[0].as_py(), [], 0
        for bucket, part in to_buckets(a, buckets):
            mine = slice(at, at + len(part))
            rows.append((bucket, chunk, part.tobytes(), c[mine].tobytes(), d[mine].tobytes(), group[mine].tobytes()))
            at += len(part)
        return _made(rows, sent)

    def sort_anchors(table: pa.Table) -> pa.Table:
        give_back()
        a, c, d, group = (_joined(table.column(x), k) for x, k in (("anchors", "<u8"), ("contexts", "<u8"), ("digests", "<u8"), ("groups", "<i8")))
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in numbers(table.column("anchors"), "<u8")])
        by = np.lexsort((chunk, d & ~_ONE, c, a))
        a, c, d, group, chunk = a[by], c[by], d[by], group[by], chunk[by]
        twice, d, mark = (d & _ONE).astype(bool), d & ~_ONE, group < 0
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        of_context, of_anchor = np.cumsum(new) - 1, np.cumsum(new_a) - 1
        holders, several = np.bincount(of_context, ~mark), np.bincount(of_context, twice) > 0
        repeat = ((holders > 1) | several)[of_context] & ~mark
        contexts_of = np.bincount(of_anchor[new])[of_anchor]
        is_hot = (np.bincount(of_anchor, mark) > 0)[of_anchor] | (contexts_of > hot_bucket)
        kind = np.where(repeat, REPEATED, 0)
        # Of a repeated context two occurrences are shown, by its first two holders or by one that has both;
        # of a hot anchor every holder shows what it has. What is shown is decided by the sort.
        nth = np.arange(len(a)) - np.flatnonzero(new)[of_context]
        shown_by = np.where((holders > 1)[of_context], nth < 2, nth < 1)
        both = (holders == 1)[of_context] & twice
        kind |= np.where(((contexts_of > 1) & new | repeat & shown_by) & ~is_hot, SORT, 0) | np.where(is_hot, SPREAD, 0) | np.where(repeat & both & ~is_hot, SECOND, 0)
        say = kind > 0
        return _made(_by_chunk(chunk[say], group[say], kind[say].astype(np.uint8)), told)

    def show(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        if not left.num_rows:
            return shown.empty_table()
        own = Anchors(unpack(left, sort=False)[1], width, anchor, hash_bits)
        first, _, group = own.groups()
        if not len(first):
            return shown.empty_table()
        chunk, rows = left.column("chunk")[0].as_py(), []
        kinds = np.zeros(len(first), np.uint8)
        told_of, said = _joined(right.column("groups"), "<i8"), _joined(right.column("kinds"), np.uint8)
        kinds[np.where(told_of < 0, -1 - told_of, told_of)] = said
        a = own.hash[first]
        kinds[hot_groups(a)] = SPREAD
        begin = np.searchsorted(group[own.order], np.arange(len(first)))
        mine = np.concatenate([first[kinds & SORT > 0], own.order[begin[kinds & SECOND > 0] + 1]])
        mine = mine[np.argsort(own.hash[mine], kind="stable")]
        # What is shown is decided by the sort; the other occurrences follow by their hashes.
        follows = kinds[group] & REPEATED > 0
        follows[mine] = False
        rows.append((None, chunk, own.low[follows].tobytes(), (own.high[follows] + width).tobytes(), *[None] * 6))
        at = 0
        for bucket, part in to_buckets(own.hash[mine], sort_buckets) if len(mine) else []:
            k = mine[at : at + len(part)]
            at += len(part)
            text = b"".join(own.data[x:y].tobytes() for x, y in zip(own.low[k].tolist(), (own.high[k] + width).tolist()))
            rows.append((bucket, chunk, own.low[k].tobytes(), None, part.tobytes(), (own.at[k] - own.low[k]).tobytes(), (own.high[k] - own.low[k] + 1).tobytes(), text, None, None))
        spread = np.flatnonzero(kinds[group] & SPREAD > 0)
        if len(spread):
            start = _ranges(own.low[spread], own.high[spread] - own.low[spread] + 1)
            view = memoryview(own.data)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[x : x + width]) for x in start.tolist()), np.uint64, len(start))
            hashes = mixed(digest) & own.mask  # the second hash decides the bucket, the first verifies it
            check = np.fromiter((xxhash.xxh64_intdigest(view[x : x + width]) for x in start.tolist()), np.uint64, len(start))
            by = np.lexsort((start, check, hashes))
            start, hashes, check, at = start[by], hashes[by], check[by], 0
            for bucket, part in to_buckets(hashes, sort_buckets):
                k = slice(at, at + len(part))
                rows.append((bucket, chunk, start[k].tobytes(), None, None, None, None, None, part.tobytes(), check[k].tobytes()))
                at += len(part)
        return _made(rows, shown)

    def sort_suffixes(table: pa.Table) -> pa.Table:
        give_back()
        chunks, starts = [], []
        sorts, spreads = table.filter(table.column("anchors").is_valid()), table.filter(table.column("hashes").is_valid())
        if sorts.num_rows:
            data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in sorts.column("bytes")])
            low, back, count, anchors = (_joined(sorts.column(c), k) for c, k in (("starts", "<i8"), ("backs", "<i8"), ("counts", "<i8"), ("anchors", "<u8")))
            chunk = np.repeat(sorts.column("chunk").to_numpy(), [len(x) for x in numbers(sorts.column("anchors"), "<u8")])
            begin = np.cumsum(count + width - 1) - (count + width - 1)
            # Only windows with the anchor at the same place can be equal: a segment of the sort each.
            _, anchor_of = np.unique(anchors, return_inverse=True)
            behind = np.repeat(back, count) - _ranges(np.zeros(len(count), np.int64), count)
            segment = np.repeat(anchor_of, count) * (width + 1) + behind
            _, repeats = sorted_suffixes(Suffixes(data, width, hash_bits), _ranges(begin, count), segment)
            chunks.append(np.repeat(chunk, count)[repeats])
            starts.append(_ranges(low, count)[repeats])
        if spreads.num_rows:
            h, d, start = (_joined(spreads.column(c), k) for c, k in (("hashes", "<u8"), ("digests", "<u8"), ("starts", "<i8")))
            chunk = np.repeat(spreads.column("chunk").to_numpy(), [len(x) for x in numbers(spreads.column("hashes"), "<u8")])
            by = np.lexsort((d, h))
            same = np.concatenate([[False], (h[by][1:] == h[by][:-1]) & (d[by][1:] == d[by][:-1]), [False]])
            repeats = by[same[:-1] | same[1:]]
            chunks.append(chunk[repeats])
            starts.append(start[repeats])
        chunk, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (chunks, starts))
        order = np.lexsort((start, chunk))
        chunk, start = chunk[order], start[order]
        # Windows side by side are one span.
        new = np.concatenate([[True], (np.diff(chunk) != 0) | (np.diff(start) > width)]) if len(start) else np.zeros(0, bool)
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]]) if len(start) else np.zeros(0, np.int64)
        return _made(_by_chunk(chunk[new], start[new], start[last] + width), found)

    with_texts = texts

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        if not left.num_rows:
            return final.empty_table()
        ids, texts = unpack(left, sort=False)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cover = np.zeros(int(base[-1]) + 1, np.int32)
        np.add.at(cover, _joined(right.column("starts"), "<i8"), 1)
        np.add.at(cover, _joined(right.column("stops"), "<i8"), -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows = []
        for d, text in enumerate(texts):
            mine = gone[base[d] : base[d + 1]]
            edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if len(edges) else text
            rows.append((id_of(ids[d]), len(text), edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(kept).hexdigest(), kept if with_texts else None))
        return _made(rows, final)

    ddl = lambda of: ", ".join(f"{f.name} {'int' if f.type == number else 'bigint' if f.type == place else 'binary'}" for f in of)
    anchors = blocks.groupBy("chunk").applyInArrow(send_anchors, ddl(sent))
    kinds = anchors.groupBy("bucket").applyInArrow(sort_anchors, ddl(told))
    # Written, as both the buckets and the blocks go on from here.
    seen = written(blocks.groupBy("chunk").cogroup(kinds.groupBy("chunk")).applyInArrow(show, ddl(shown)), "contexts")
    repeats = seen.filter("bucket IS NOT NULL").groupBy("bucket").applyInArrow(sort_suffixes, ddl(found))
    spans = seen.filter("bucket IS NULL").select("chunk", "starts", "stops").unionByName(repeats)
    return blocks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(remove, SCHEMA)


def op2_substring_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    return repeated_bytes(documents(spark, sf_dir), texts=False).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
