"""Language identification by a linear-chain conditional random field (operator 1).

Every word with a letter gets a label. A word's score for a label sums learned
weights of its affixes and character n-grams (up to three letters, word borders
included) and of its entry in a lexicon of words seen often in training; learned
transitions link neighbours, so words of code-switched text lean on each other.
Forward-backward gives each word's label probabilities; a document's language is
the label with the highest mean probability, and that mean, to six places, is the
score.

Forward-backward runs over whole batches at once: documents are laid end to end,
a document's first word forgets what came before, and the chain is cut into
blocks whose transfer matrices are multiplied first, so every step works on all
blocks together.

Training takes at most ``TRAIN_DOCS`` labelled documents (whole texts of up to
``TRAIN_LETTERS`` letters, chosen by the hash of doc_id and text among documents whose
crc32(doc_id as text) mod 5 is not 0) and learns from text and lang alone. Half of
them are also spliced in pairs of two languages, so that transitions are learned
from text that changes its language. ``labelled_spans`` gives the runs of words of
one language in every text.

Defined cases: null text or text without a letter is ``und`` with score 0; so is
every document if no labelled text exists; a null doc_id counts as the empty text;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, session, small_batches

#: The bounds on labelled documents that the model is fitted to, and on the length of each.
TRAIN_DOCS, TRAIN_LETTERS = 400, 100_000
FOLDS = 5
FEATURES, NGRAM, LEXICON, LEXICON_LEAST = 1 << 16, 3, 20_000, 3
STEPS, RATE, DECAY = 14, 0.15, 1e-3
#: Words whose scores a worker keeps.
CACHE = 150_000
#: Letters of whole texts that are labelled at once (more, if one text has more): arrays over all their words are held.
LETTERS_AT_ONCE = 500_000
UNKNOWN = "und"
#: A text may hold so many times the unknown n-grams of the held-out training rows
#: (of the one in a hundred with the most), and this share of them in any case.
MISSES, LEAST_MISSES = 10, 0.05
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


@dataclass
class Model:
    labels: list[str]
    ngrams: np.ndarray  # features x labels
    lexicon: dict[str, int]
    words: np.ndarray  # lexicon entries x labels
    transitions: np.ndarray
    start: np.ndarray
    #: Features that training words have, and the least share of them in a text of these languages.
    known: np.ndarray | None = None
    least_known: float = 0.0


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of every n-gram of the words with their borders, in word order."""
    # \x02 and \x03 mark the borders, so border n-grams are the affixes.
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    features, owners, value = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, NGRAM + 1):
        value[: len(codes) - n + 1] = (value[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        whole = np.flatnonzero(left >= n)
        features.append((value[whole] >> np.uint64(7)).astype(np.int64) % FEATURES)
        owners.append(owner[whole])
    feature, own = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return feature[order], own[order]


def _summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    return _scores(model, words, *ngram_features(words)) if words else np.zeros((0, len(model.labels)))


def known_shares(known: np.ndarray, feature: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n words the share of its n-grams that training words have."""
    return np.bincount(owner, known[feature], n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _scores(model: Model, words: list[str], feature: np.ndarray, owner: np.ndarray) -> np.ndarray:
    scores = _summed(model.ngrams[feature], owner, len(words))
    known = [(k, model.lexicon[w]) for k, w in enumerate(words) if w in model.lexicon]
    if known:
        at, row = np.array(known).T
        scores[at] += model.words[row]
    return scores


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Forward and backward vectors, each scaled to sum one, for chains laid end to end.

    ``first`` marks the first word of each chain.
    """
    n, labels = scores.shape
    columns = max(1, int(n**0.5))
    rows = -(-n // columns)
    emit = np.ones((rows * columns, labels))
    emit[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    begins = np.ones(rows * columns, bool)
    begins[:n] = first
    emit, begins = emit.reshape(rows, columns, labels), begins.reshape(rows, columns)
    move, open_ = np.exp(transitions), np.exp(start)
    anew = [np.flatnonzero(begins[:, c]) for c in range(columns)]

    # Transfer matrices of whole blocks.
    block = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
    for c in range(columns):
        after = block @ move
        if len(anew[c]):
            after[anew[c]] = block[anew[c]].sum(axis=2, keepdims=True) * open_
        block = after * emit[:, c, None, :]
        block /= block.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((rows, labels)), np.empty((rows, labels))
    into[0], out[-1] = 1 / labels, 1 / labels
    for r in range(1, rows):
        v = into[r - 1] @ block[r - 1]
        into[r] = v / v.sum()
    for r in range(rows - 1, 0, -1):
        v = block[r] @ out[r]
        out[r - 1] = v / v.sum()

    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    at = into
    for c in range(columns):
        after = at @ move
        if len(anew[c]):
            after[anew[c]] = open_
        at = after * emit[:, c]
        at /= at.sum(axis=1, keepdims=True)
        alpha[:, c] = at
    at = out
    for c in range(columns - 1, -1, -1):
        beta[:, c] = at
        seen = at * emit[:, c]
        before = seen @ move.T
        if len(anew[c]):
            before[anew[c]] = 1
        at = before / before.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n]


def posteriors(scores, first, transitions, start) -> np.ndarray:
    if not len(scores):
        return scores
    alpha, beta = forward_backward(scores, first, transitions, start)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _spliced(chains: list[tuple[list[str], list[int]]]) -> list[tuple[list[str], list[int]]]:
    """Code-switched chains: runs of two texts of different languages in turn, every word with its own label."""
    rng, mixed = np.random.default_rng(len(chains)), []
    partner = rng.permutation(len(chains))
    for k, other in enumerate(partner.tolist()):
        pair = chains[k], chains[other]
        if k % 2 or pair[0][1][0] == pair[1][1][0]:
            continue
        words, labels, at, side = [], [], [0, 0], 0
        while at[side] < len(pair[side][0]):
            stop = at[side] + int(rng.integers(2, 25))
            words += pair[side][0][at[side] : stop]
            labels += pair[side][1][at[side] : stop]
            at[side], side = stop, 1 - side
        mixed.append((words, labels))
    return mixed


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) pairs.

    A word of a text carries the text's label. So that transitions see languages
    change, texts of different languages are also spliced run by run.
    """
    plain = [([w for w in words_of(t) if has_letter(w)], lang) for t, lang in sorted(rows)]
    plain = [(w, lang) for w, lang in plain if w]
    labels = sorted({lang for _, lang in plain})
    counted = Counter(w for words, _ in plain for w in words)
    lexicon = {w: k for k, (w, n) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= LEXICON_LEAST}
    width = max(1, len(labels))
    model = Model(labels, np.zeros((FEATURES, width)), lexicon, np.zeros((len(lexicon), width)), np.zeros((width, width)), np.zeros(width))
    if not labels:
        return model
    chains = [(words, [labels.index(lang)] * len(words)) for words, lang in plain]
    whole = len(chains)
    chains += _spliced(chains)
    vocabulary = {w: k for k, w in enumerate(sorted(counted))}
    ids = np.array([vocabulary[w] for words, _ in chains for w in words])
    gold = np.array([g for _, own in chains for g in own])
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0] + [len(w) for w, _ in chains[:-1]])] = True
    feature, owner = ngram_features(list(vocabulary))
    known = np.array([(vocabulary[w], k) for w, k in lexicon.items()], np.int64).reshape(-1, 2)
    of_text = np.repeat(np.arange(whole), [len(w) for w, _ in chains[:whole]])
    model.known, model.least_known = _membership(ids[: len(of_text)], of_text, feature, owner, len(vocabulary))

    truth = np.zeros((len(ids), width))
    truth[np.arange(len(ids)), gold] = 1
    follow = np.flatnonzero(~first)
    pairs = np.zeros((width, width))
    np.add.at(pairs, (gold[follow - 1], gold[follow]), 1)
    begins = truth[first].sum(axis=0)

    parts = [model.ngrams, model.words, model.transitions, model.start]
    moment, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        of_word = _summed(model.ngrams[feature], owner, len(vocabulary))
        of_word[known[:, 0]] += model.words[known[:, 1]]
        scores = of_word[ids]
        alpha, beta = forward_backward(scores, first, model.transitions, model.start)
        both = alpha * beta
        both /= both.sum(axis=1, keepdims=True)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        expected = np.einsum("ti,ij,tj->tij", alpha[follow - 1], np.exp(model.transitions), (emit * beta)[follow])
        expected /= expected.sum(axis=(1, 2), keepdims=True)
        gap = _summed(truth - both, ids, len(vocabulary))
        slopes = [_summed(gap[owner], feature, FEATURES), gap[known[:, 0]], pairs - expected.sum(axis=0), begins - both[first].sum(axis=0)]
        # Adaptive moments with decay towards zero.
        for p, m, s, slope in zip(parts, moment, square, slopes):
            slope = slope / len(chains) - DECAY * p
            m += 0.1 * (slope - m)
            s += 0.01 * (slope * slope - s)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return model


def _membership(ids: np.ndarray, chain: np.ndarray, feature: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The features of all training words, and the least share of known n-grams in a text.

    Each tenth of the texts is measured by the features of the others.
    """
    shares = []
    for part in range(10):
        seen, features, own = np.zeros(n, bool), np.zeros(FEATURES, bool), chain % 10 == part
        seen[ids[~own]] = True
        features[feature[seen[owner]]] = True
        share = known_shares(features, feature, owner, n)[ids[own]]
        count = np.bincount(chain[own] // 10)
        shares.append(np.bincount(chain[own] // 10, share) / np.maximum(count, 1))
    features = np.zeros(FEATURES, bool)
    features[feature] = True
    missed = 1 - float(np.quantile(np.concatenate(shares), 0.01))
    return features, 1 - max(LEAST_MISSES, MISSES * missed)


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull())
    short = labelled.filter(F.length(F.col("text").cast("string")) <= TRAIN_LETTERS)
    # First a share of the rows by a hash of id and text, so that few texts are sorted and
    # sent; a larger one where it has too few of the texts that can be used.
    keep, sample = max(1, -(-labelled.select("doc_id", "lang").count() // most)), []
    order = (F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text"))
    while True:
        share = short.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(keep)) == 0)
        sample = share.select("text", "lang", "doc_id").orderBy(*order).limit(most).collect()
        if keep == 1 or 4 * len(sample) >= most:
            return fit([(r.text, r.lang) for r in sample])
        keep = max(1, keep // 8)


def _portions(texts: list[str | None]):
    """The texts in order, some ``LETTERS_AT_ONCE`` letters at a time."""
    begin, letters = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > begin and letters + n > LETTERS_AT_ONCE:
            yield texts[begin:k]
            begin, letters = k, 0
        letters += n
    if begin < len(texts):
        yield texts[begin:]


class Labeller:
    """Scores of words, kept for a bounded number of them."""

    def __init__(self, model: Model, shares: bool = False):
        self.model, self.index, self.scores = model, {}, np.zeros((0, max(1, len(model.labels))))
        #: Shares of known n-grams, kept only where they are asked for.
        self.shares = np.zeros(0) if shares and model.known is not None else None

    def word_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word (-1: no letter) over all texts, and words per text."""
        if len(self.index) > CACHE:
            self.index, self.scores = {}, self.scores[:0]
            self.shares = None if self.shares is None else self.shares[:0]
        index, new, lengths, out = self.index, [], [], []
        at = len(self.scores)
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            own = list(map(index.get, words))
            if None in own:
                for k, i in enumerate(own):
                    if i is None and (w := words[k]) not in index:
                        index[w] = at + len(new) if (letter := has_letter(w)) else -1
                        if letter:
                            new.append(w)
                own = list(map(index.__getitem__, words))
            out.append(np.array(own, np.int32))
        if new:
            features = ngram_features(new)
            self.scores = np.concatenate([self.scores, _scores(self.model, new, *features)])
            if self.shares is not None:
                self.shares = np.concatenate([self.shares, known_shares(self.model.known, *features, len(new))])
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(lengths, np.int64)

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Runs of words with one label in each text: first word, word behind the last, label. A word without a letter goes with the run before it."""
        return [runs for portion in _portions(texts) for runs in self._spans(portion)]

    def _spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        ids, lengths = self.word_ids(texts)
        owner, place = np.repeat(np.arange(len(texts)), lengths), np.concatenate([np.arange(n) for n in lengths.tolist()] or [np.zeros(0, int)])
        owner, place, ids = owner[ids >= 0], place[ids >= 0], ids[ids >= 0]
        runs: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(ids) or not self.model.labels:
            return runs
        first = np.ones(len(ids), bool)
        first[1:] = owner[1:] != owner[:-1]
        best = posteriors(self.scores[ids], first, self.model.transitions, self.model.start).argmax(axis=1)
        new = np.flatnonzero(first | np.concatenate([[True], best[1:] != best[:-1]]))
        for k, at in enumerate(new.tolist()):
            d = int(owner[at])
            last = k + 1 == len(new) or owner[new[k + 1]] != d
            runs[d].append((0 if first[at] else int(place[at]), int(lengths[d]) if last else int(place[new[k + 1]]), self.model.labels[best[at]]))
        return runs

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.measured(texts)[:2]

    def measured(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and the mean share of known n-grams over the words."""
        found: tuple[list[str], list[float], list[float]] = [], [], []
        for portion in _portions(texts):
            for whole, part in zip(found, self._measured(portion)):
                whole += part
        return found

    def _measured(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        ids, lengths = self.word_ids(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)[ids >= 0]
        ids = ids[ids >= 0]
        if not len(ids) or not self.model.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        first = np.ones(len(ids), bool)
        first[1:] = owner[1:] != owner[:-1]
        found = posteriors(self.scores[ids], first, self.model.transitions, self.model.start)
        count = np.bincount(owner, minlength=len(texts))
        mean = _summed(found, owner, len(texts)) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        shares = np.zeros(len(texts)) if self.shares is None else np.bincount(owner, self.shares[ids], len(texts)) / np.maximum(count, 1)
        return [self.model.labels[b] if n else UNKNOWN for b, n in zip(best, count)], [round(float(min(1.0, m[b])), 6) for m, b in zip(mean, best)], shares.tolist()


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spark = session(docs)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        own = Labeller(sent.value)
        for batch in batches:
            labels, scores = own.label(batch.column("text").to_pylist())
            fold = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": fold, "lang_pred": labels, "score": scores}, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


SPANS = "doc_id bigint, spans array<struct<start:int,stop:int,lang:string>>"


def labelled_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, spans: the runs of words (separated by white space) of one language, for code-switched text."""
    spark = session(docs)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train(docs))
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        own = Labeller(sent.value)
        for batch in batches:
            found = own.spans(batch.column("text").to_pylist())
            spans = [[{"start": a, "stop": b, "lang": c} for a, b, c in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, schema.types[1])], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def known_language(docs: DataFrame, least: float = 0.3, model: Model | None = None) -> DataFrame:
    """The documents, all columns as they are, whose language is found with a score of ``least`` or more.

    A score only tells languages apart. So a document also needs a share of known
    n-grams, over all languages at once, that training rows held out from each other
    bear out (``_membership``). With a few training rows that share falls to nothing.
    """
    spark = session(docs)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train(docs))
    at = docs.columns.index("text")

    def run(batches):
        own = Labeller(sent.value, shares=True)
        for batch in batches:
            found = zip(*own.measured(batch.column(at).to_pylist()))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least and share >= sent.value.least_known for lang, s, share in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
