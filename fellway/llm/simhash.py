"""SimHash near-duplicates by bit-sliced comparison (operator 3).

Distinct fingerprints are dealt to buckets by each of ``radius + 1`` blocks of
their bits: two fingerprints within the radius agree on at least one block. A
bucket keeps its fingerprints as vertical bit planes; a query's distances to all
of them are added up plane by plane in carry-save counters, one bit of each
counter per word, and a comparison is abandoned once every counter has passed
the radius. From a bucket come only the links of a spanning forest, at most one
less than its members. Buckets above a size are cut into tiles and every pair of
tiles is compared by its own task, so none is dropped.

Links meet in connected components by alternating star steps; each step is
written to the shared folder. Copies share a fingerprint and are never paired.

Defined cases: null or wordless text has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows share their
component; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, session, small_batches, written

WORDS, RADIUS, SEED = 3, 3, 42
#: Near copies are measured by sets of shingles of so many words.
SHINGLE = 5
#: Bands of least hashes: at similarity 0.8 a pair agrees on none of 40 bands of 8 with a chance of (1 - 0.8**8)**40 = 6e-4.
BANDS, BAND_ROWS = 40, 8
#: Documents of a candidate group that a task compares at once, and distinct shingles for each of them.
TILE_DOCS, TILE_SHINGLES = 512, 2048
#: Fingerprints compared at once, and the bucket size above which tiles are cut.
TILE, BUCKET = 1024, 1 << 16
_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Bits of a byte, lowest first: row b holds the bits of b.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def shingle_hashes(found: list[str], words: int) -> np.ndarray:
    """Hashes of all runs of so many words; fewer words make one shingle."""
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [" ".join(found)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 majority bits over the hashes of all shingles."""
    return _majority(shingle_hashes(words_of(text), words))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for byte in range(8):
        ones = np.bincount(columns[:, byte], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            value |= 1 << (8 * byte + bit)
    return value


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""
    small_batches(session(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of up to TILE numbers: plane b holds bit b of all of them, 64 to a word."""
    width = -(-len(values) // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    for b in range(64):
        bits[b, : len(values)] = values >> np.uint64(b) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, value) of all pairs that differ in at most ``radius`` bits."""
    planes = planes_of(values)
    rows = np.arange(len(queries))
    digits = max(1, int(radius).bit_length())
    # counters[d] holds digit d of every counter; past marks those beyond the radius.
    counters = [np.zeros((len(rows), planes.shape[1]), np.uint64) for _ in range(digits)]
    past = np.zeros_like(counters[0])
    spare = planes.shape[1] * 64 - len(values)
    if spare:
        past[:, -1] = np.uint64((1 << 64) - (1 << (64 - spare)))
    full = ~np.uint64(0)
    for b in range(64):
        ones = (queries[rows] >> np.uint64(b) & np.uint64(1)).astype(bool)
        carry = np.where(ones[:, None], ~planes[b], planes[b])
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        past |= carry
        if b >= 8 and b % 4 == 3:
            over = past
            if radius + 1 < 1 << digits:  # a counter may stand between the radius and its last value
                over = past | _above(counters, radius)
            live = ~(over == full).all(axis=1)
            if not live.all():
                rows, past = rows[live], past[live]
                counters = [c[live] for c in counters]
                if not len(rows):
                    return np.zeros(0, int), np.zeros(0, int)
    over = past | _above(counters, radius)
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    q, v = np.nonzero(near)
    return rows[q], v


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Counters that hold more than the radius, digit by digit."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for d in reversed(range(len(counters))):
        if radius >> d & 1:
            same &= counters[d]
        else:
            more |= same & counters[d]
            same &= ~counters[d]
    return more


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(values: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS, seconds: np.ndarray | None = None, second_radius: int = 64) -> list[tuple[int, int]]:
    """Spanning links, as places, within a bucket or between two tiles of a large one.

    Places of ``other`` follow those of ``values``. ``seconds`` holds a second
    fingerprint at every place, which has a radius of its own.
    """
    n = len(values)
    targets, base = (values, 0) if other is None else (other, n)
    forest, links = _Forest(n + (0 if other is None else len(other))), []
    for i in range(0, n, TILE):
        for j in range(i if other is None else 0, len(targets), TILE):
            q, v = within(values[i : i + TILE], targets[j : j + TILE], radius)
            q, v = q + i, v + j + base
            if seconds is not None:
                near = np.bitwise_count(seconds[q] ^ seconds[v]) <= second_radius
                q, v = q[near], v[near]
            for a, b in zip(q.tolist(), v.tolist()):
                if a != b and forest.join(a, b):
                    links.append((a, b))
    return links


def _blocks(parts: int, bits: int) -> list[tuple[int, int, int]]:
    """(block, shift, width): the widest keys are whole blocks; fewer bits make fewer, larger buckets."""
    cut = [round(64 * k / parts) for k in range(parts + 1)]
    return [(k, cut[k], min(bits, cut[k + 1] - cut[k])) for k in range(parts)]


def links(distinct: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET, second_radius: int = 64) -> DataFrame:
    """Links (a, b) between nodes that join all fingerprints within the radius.

    ``distinct`` has n rows (node, fp), and may have ``fp2``, a second fingerprint
    to be within ``second_radius``, and ``shingles``, the size of a set: then only
    nodes whose sizes differ by a factor of up to 1.25 are sure to be compared, as
    sets with a similarity of 0.8 do.
    """
    # Buckets of about two tiles: with fewer fingerprints, fewer bits of a block are the key.
    bits = max(1, int(max(1, n // (2 * TILE))).bit_length())
    keys = F.array(*[(F.lit(k) * F.lit(1 << 32) + F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)).cast("long") for k, shift, width in _blocks(radius + 1, bits)])
    fields = ["node", "fp", *(c for c in ("fp2",) if c in distinct.columns)]
    if "shingles" in distinct.columns:
        # Two neighbouring bands of a factor of a little over 1.25 each.
        band = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1)).cast("double")) / F.log(F.lit(1.2501)))
        distinct = distinct.select(*fields, F.explode(F.array(band, band + 1)).alias("band"))
    else:
        distinct = distinct.select(*fields, F.lit(0).cast("long").alias("band"))
    dealt = distinct.select(*fields, F.explode(keys).alias("key"), "band").withColumn("bucket", F.col("key") + F.col("band") * F.lit(1 << 40)).drop("key", "band")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > bucket).select("bucket", F.ceil(F.col("size") / bucket).cast("int").alias("tiles"))
    # A bucket of several tiles goes to every pair of them; side tells which tile of the pair.
    pairs = (
        dealt.join(large, "bucket", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        .select(*fields, "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("mate"))
        .select(*fields, "bucket", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), (F.col("own") > F.col("mate")).alias("side"))
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        i, j, side = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        node, fp = (table.column(c).to_numpy()[order] for c in ("node", "fp"))
        fp = fp.view(np.uint64)
        seconds = table.column("fp2").to_numpy()[order].view(np.uint64) if "fp2" in fields else None
        first = len(side) if i == j else int(np.count_nonzero(~side))
        found = bucket_links(fp[:first], None if i == j else fp[first:], radius, seconds, second_radius)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]}, schema=schema)

    return pairs.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, by alternating large and small stars.

    A hub may hold a third of all links. So least neighbours are aggregated map-side and
    written, and links meet them in joins of two written tables, whose hot partitions
    Spark can split.
    """
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Large star: the larger end of a link moves to the least neighbour of the smaller end.
        least = written(edges.groupBy("a").agg(F.min("b").alias("least")), "least").withColumnRenamed("a", "b")
        large = written(edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b")).distinct(), "links")
        # Small star: smaller neighbours and the node itself move to the smallest neighbour.
        least = written(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b")
        edges = written(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        # Stable once the links no longer change; both figures are exact sums.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    own = written(fingerprints(docs, words), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select(F.col("fp").alias("node"), "fp"), distinct.count(), radius, bucket))
    # Fingerprints without links stand for themselves.
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


_RNG = np.random.default_rng(SEED)
_MASKS = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32) | np.uint32(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One signed key per band over the least values of its hash functions."""
    low, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, ((low[at : at + 2048] ^ _MASKS) * _FACTORS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, BAND_ROWS)], np.uint64).view(np.int64)


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links, as places, between all sets with a Jaccard similarity of 0.8 or more."""
    sizes, n = np.array([len(s) for s in sets], np.int64), len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    # What one set holds alone is shared with none.
    often = np.bincount(column, minlength=len(values)) > 1
    kept = often[column]
    column, owner = (np.cumsum(often) - 1)[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n))
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        shared += held @ held.T
    near = np.triu(9 * shared >= 4 * (sizes[:, None] + sizes), 1)
    forest = _Forest(n)
    return [(x, y) for x, y in np.argwhere(near).tolist() if forest.join(x, y)]


def text_key(column: str = "text") -> Column:
    """Names a text within rows of one doc_id; null counts as empty."""
    return F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256)


def _band_stars(members: DataFrame) -> DataFrame:
    """Links of every node to the least node of each of its bands of least hashes."""
    bands = members.select("node", F.posexplode("bands").alias("band", "key"))
    first = bands.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return bands.join(first, ["band", "key"]).filter("node != b").select(F.col("node").alias("a"), "b").distinct()


_LINKS = "a bigint, b bigint"
_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_table(node: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]}, schema=_LINK_SCHEMA)


def shingle_sets(texts: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(words_of(t), SHINGLE)) for t in texts.to_pylist()]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """A Jaccard similarity of 0.8 or more."""
    total = 4 * (len(x) + len(y))
    return 9 * min(len(x), len(y)) >= total and 9 * len(np.intersect1d(x, y, assume_unique=True)) >= total


def _all_pairs(held: DataFrame, lots: int) -> DataFrame:
    """Similar links within groups of one tile; such groups share tasks."""

    def confirm(table: pa.Table) -> pa.Table:
        node, root, texts = table.column("node").to_numpy(), table.column("root").to_numpy(), table.column("text")
        out = []
        for r in np.unique(root):
            mine = np.flatnonzero(root == r)
            out.append(_link_table(node[mine], similar_links(shingle_sets(texts.take(pa.array(mine))))))
        return pa.concat_tables(out)

    return held.withColumn("lot", F.pmod(F.xxhash64("root"), F.lit(lots))).select("lot", "root", "node", "text").groupBy("lot").applyInArrow(confirm, _LINKS)


def _against_hubs(pairs: DataFrame, held: DataFrame, tile: int) -> DataFrame:
    """The similar ones of the pairs (node, hub), each hub with so many nodes at a time."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = written(pairs.join(sizes, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part")), "pairs")
    hubs = dealt.select(F.col("hub").alias("node"), "hub", "part").distinct()
    rows = dealt.unionByName(hubs).join(held.select("node", "text"), "node")
    lots = max(1, 2 * dealt.count() // tile)
    lot = F.pmod(F.xxhash64("hub", "part"), F.lit(lots))

    def compare(table: pa.Table) -> pa.Table:
        node, hub, part = (table.column(c).to_numpy() for c in ("node", "hub", "part"))
        sets, found = shingle_sets(table.column("text")), []
        centre = {(h, p): k for k, (n, h, p) in enumerate(zip(node.tolist(), hub.tolist(), part.tolist())) if n == h}
        for k, key in enumerate(zip(hub.tolist(), part.tolist())):
            if k != centre[key] and similar(sets[k], sets[centre[key]]):
                found.append((k, centre[key]))
        return _link_table(node, found)

    return rows.select(lot.alias("lot"), "node", "hub", "part", "text").groupBy("lot").applyInArrow(compare, _LINKS)


def _across(labels: DataFrame, members: DataFrame) -> DataFrame:
    """(band, key, node, odd, hub, n, odds): bands whose nodes do not all have one label; odd nodes have another label than the hub."""
    bands = members.join(labels, "node").select("node", "label", F.posexplode("bands").alias("band", "key"))
    of = bands.groupBy("band", "key").agg(F.min(F.struct("label", "node")).alias("h"), F.max("label").alias("most")).filter("h.label != most")
    return bands.join(of, ["band", "key"]).select("band", "key", "node", (F.col("label") != F.col("h.label")).alias("odd"), F.col("h.node").alias("hub"))


def _odd_pairs(across: DataFrame, held: DataFrame, tile: int) -> DataFrame:
    """Similar links between the odd nodes of a band and all its nodes, tile by tile."""
    across = written(across, "across")
    sizes = across.groupBy("band", "key").agg(F.ceil(F.count("*") / tile).cast("int").alias("all"), F.ceil(F.count_if("odd") / tile).cast("int").alias("odds"))
    dealt = across.join(sizes, ["band", "key"])
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("odd").select("band", "key", "node", F.lit(True).alias("left"), own("odds").alias("i"), every("all").alias("j"))
    right = dealt.select("band", "key", "node", F.lit(False).alias("left"), every("odds").alias("i"), own("all").alias("j"))
    rows = left.unionByName(right).join(held.select("node", "text"), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        return _link_table(node, similar_links(shingle_sets(table.column("text").take(pa.array(first)))))

    return rows.select("band", "key", "i", "j", "node", "text").groupBy("band", "key", "i", "j").applyInArrow(compare, _LINKS)


def _confirmed(docs: DataFrame, own: DataFrame, distinct: DataFrame, bits: DataFrame, tile: int) -> DataFrame:
    """Links between texts that are similar by their shingles.

    Candidate groups (joined by near fingerprints or equal bands) of one tile are
    compared pair by pair in a task. Larger ones never are: their nodes are compared
    with the group's root, then with hubs of the bands that still hold several
    groups, and only what those leave apart meets pair by pair within such bands.
    """
    found = components(bits.unionByName(_band_stars(distinct)))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    weighed = written(found.join(distinct.select("node", "shingles"), "node"), "candidates")
    sizes = weighed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("shingles") / (tile * TILE_SHINGLES))).cast("int").alias("tiles"))
    texts = own.groupBy("node").agg(F.min("key").alias("key")).join(weighed.select("node", "root").join(sizes, "root"), "node")
    # Copies are brought down to one row a partition before they are shuffled.
    once = docs.groupBy(text_key().alias("key")).agg(F.first(F.col("text").cast("string")).alias("text"))
    held = written(once.join(texts, "key").select("node", "root", "tiles", "text"), "held")
    small, large = held.filter("tiles = 1"), held.filter("tiles > 1")
    links = written(_all_pairs(small, max(1, 4 * small.count() // tile)), "links")
    if large.isEmpty():
        return links
    nodes = large.select("node", "root")
    members = written(distinct.join(nodes.select("node"), "node", "left_semi").select("node", "bands"), "members")
    stars = written(_against_hubs(nodes.filter("node != root").select("node", F.col("root").alias("hub")), large, tile), "links")
    near = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = written(nodes.select("node").join(near, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    by_bits = bits.join(labels.withColumnsRenamed({"node": "a", "label": "x"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "y"}), "b").filter("x != y")
    pairs = _across(labels, members).filter("odd").select("node", "hub").unionByName(by_bits.select(F.col("a").alias("node"), F.col("b").alias("hub"))).distinct()
    stars = stars.unionByName(written(_against_hubs(pairs, large, tile), "links"))
    joined = components(stars).withColumnRenamed("root", "label")
    labels = written(nodes.select("node").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    return links.unionByName(stars).unionByName(_odd_pairs(_across(labels, members), large, tile))


def _grouped(docs: DataFrame, near: tuple[int, int], also: tuple[int, int], bucket: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) of every row, and (node, root): the group of every distinct set of shingles."""
    small_batches(session(docs))
    fields = [("doc_id", pa.int64()), ("key", pa.string()), ("node", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("shingles", pa.int64()), ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                shingles = np.unique(shingle_hashes(found, SHINGLE))
                bits = [_majority(shingle_hashes(found, k)) for k in (near[0], also[0])]
                # Equal sets are one node.
                signed = np.array([xxhash.xxh3_64_intdigest(shingles.tobytes()), *bits], np.uint64).view(np.int64).tolist()
                rows.append((*signed, len(shingles), band_keys(shingles) if len(shingles) else []))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types[2:])] if rows else [pa.array([], t) for t in schema.types[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], schema=schema)

    signed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key().alias("key"))
    every = written(signed.mapInArrow(run, "doc_id bigint, key string, node bigint, fp bigint, fp2 bigint, shingles bigint, bands array<bigint>"), "fingerprints")
    own = every.select("doc_id", "key", "node")
    distinct = written(every.groupBy("node").agg(F.min(F.struct("fp", "fp2", "shingles", "bands")).alias("s")).select("node", "s.*"), "distinct")
    bits = written(links(distinct.select("node", "fp", "fp2", "shingles"), distinct.count(), near[1], bucket, also[1]), "bits")
    found = components(_confirmed(docs, own, distinct, bits, tile))
    return own, distinct.select("node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_groups(docs: DataFrame, near: tuple[int, int] = (2, 8), also: tuple[int, int] = (3, 12), bucket: int = BUCKET, tile: int = TILE_DOCS) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group), for near copies with several edits.

    Documents link if their sets of five-word shingles have a similarity of 0.8 or
    more, by the 64-bit hashes of the shingles. Compared are the documents of a
    candidate group: those joined by fingerprints of two-word shingles that differ
    in at most 8 bits and of three-word shingles in at most 12, or by an equal band
    of least hashes of the five-word shingles, which finds a similar pair whatever
    the edit. Groups beyond a tile are not compared by every pair (``_confirmed``). Texts without words link with each other. A null doc_id is larger
    than any other.
    """
    own, rooted = _grouped(docs, near, also, bucket, tile)
    first = own.groupBy("node").agg(F.min("doc_id").alias("first"))
    least = rooted.join(first, "node").groupBy("root").agg(F.min("first").alias("group_id"))
    return own.join(rooted.join(least, "root").select("node", "group_id"), "node").select("doc_id", "group_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key, rows: of each group of near copies the text that stays, and how many rows hold it.

    The smallest doc_id goes first, null after all others, then the key of the text
    (``text_key``), so a text is named also where ids repeat.
    """
    own, rooted = _grouped(docs, (2, 8), (3, 12), BUCKET, TILE_DOCS)
    alike = own.groupBy("node", "doc_id", "key").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("s")
    first = alike.groupBy("node").agg(least)
    return rooted.join(first, "node").groupBy("root").agg(F.min("s").alias("s")).select("s.doc_id", "s.key", "s.rows")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
