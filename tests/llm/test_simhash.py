"""SimHash against counting bits and comparing all pairs."""

import random

import numpy as np
import xxhash

from fellway.llm.simhash import bucket_links, components, fingerprint, links, near_duplicates, similar_groups, similar_links, within


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint(odd_texts):
    for text in [None, *odd_texts, "ÀB Cd É" * 30]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_within_any_radius():
    rng = random.Random(3)
    for n, radius in ((1, 0), (63, 1), (64, 2), (130, 3), (70, 5), (200, 9)):
        base = [rng.getrandbits(64) for _ in range(5)]
        values = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for _ in range(n)]
        array = np.array(values, np.uint64)
        q, v = within(array, array, radius)
        assert sorted(zip(q.tolist(), v.tolist())) == [(i, j) for i in range(n) for j in range(n) if (values[i] ^ values[j]).bit_count() <= radius]


def cloud(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out[:n]))


def test_links_span_every_component(spark):
    values = cloud(400, 8)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v, v) for v in signed], "node bigint, fp bigint")
    expected = plain_components(values)
    for bucket in (1 << 16, 40):
        found = components(links(frame, 400, bucket=bucket)).collect()
        root = {r.node: r.root for r in found}
        groups = {}
        for v, e in zip(signed, expected):
            groups.setdefault(e, set()).add(root.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set.union(*groups.values())) == len(groups)


def test_a_clique_gives_few_links():
    values = np.array([1 << k for k in range(3)] + [0, 3, 5, 6, 7], np.uint64)
    assert len(bucket_links(values)) == 7


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_documents(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "one", "One", "one two"]
    for _ in range(30):
        text = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(text))
            if rng.random() < 0.6:
                text[rng.randrange(150)] = "new"
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, fp int")
    rows = {r.doc_id: r for r in near_duplicates(docs).collect()}
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    expected = plain_components([plain_fingerprint(texts[k]) for k in order])
    for at, k in enumerate(order):
        assert rows[ids[k]].fingerprint == f"{plain_fingerprint(texts[k]):016x}"
        assert rows[ids[k]].component_id == ids[order[expected[at]]]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_similar_groups(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    rows, truth = [], {}
    for g in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for k in range(3):
            own = list(text)
            for _ in range(k * len(own) // 100):
                own[rng.randrange(len(own))] = rng.choice(words)
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.group_id for r in similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    firsts = {g: min(i for i in truth if truth[i] == g) for g in truth.values()}
    assert all(got[i] in truth and truth[got[i]] == truth[i] for i in got)
    assert sum(got[i] == firsts[truth[i]] for i in got) > 0.97 * len(rows)


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_similar_groups_of_every_kind_of_edit(spark):
    rng = random.Random(6)
    texts, pairs = [], []
    for g in range(120):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        n, fresh = len(text), [f"n{rng.randrange(5000)}" for _ in range(400)]
        other = [text[: -(-n * 82 // 100)], text[: n - n // 16] + fresh[: n // 16], text[: n // 2] + fresh[: n // 16] + text[n // 2 + n // 16 :]][g % 3]
        a, b = shingles(text), shingles(other)
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(text), " ".join(other)]
    # Near in the fingerprints, but below 0.8: one word in eighteen is another.
    for _ in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(360)]
        texts += [" ".join(text), " ".join("x" if k % 18 == 9 else w for k, w in enumerate(text))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for tile in (512, 20):
        got = {r.doc_id: r.group_id for r in similar_groups(docs, tile=tile).collect()}
        assert got == {k: k for k in range(len(texts))} | {b: a for a, b in pairs}


def test_similar_links_against_all_pairs():
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 1 << 40, 90, np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][rng.random(90) < 0.93], rng.integers(0, 1 << 40, k % 9, np.uint64)])) for k in range(80)]
    plain = list(range(80))
    for i in range(80):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])):
                a, b = plain[i], plain[j]
                plain = [min(a, b) if x in (a, b) else x for x in plain]
    root = list(range(80))
    for i, j in similar_links(sets):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == plain


def test_similar_groups_across_repeated_text(spark):
    rng = random.Random(8)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    changed = [*text[:150], "changed", *text[151:]]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text + changed + text)), (3, "other words")], "doc_id bigint, text string")
    assert {r.doc_id: r.group_id for r in similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_large_groups_equal_all_pairs(spark):
    rng, texts = random.Random(12), []
    page = [f"w{rng.randrange(5000)}" for _ in range(60)]
    for _ in range(4):
        # A chain of small changes behind a page that all share: its ends are far apart.
        text = [*page, *(f"w{rng.randrange(5000)}" for _ in range(120))]
        for _ in range(45):
            text = list(text)
            for _ in range(rng.randint(1, 3)):
                text[60 + rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts.append(text)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert 3 < len(set(root)) < 60
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for tile in (512, 12):
        assert {r.doc_id: r.group_id for r in similar_groups(docs, tile=tile).collect()} == dict(enumerate(root))
