"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a word vector and a character vector. The word vector holds the word's log-odds in the
fitting sample and a trained hashed embedding; the character vector holds the largest and the mean log-odds
of the word's boundary-marked character n-grams and the mean of trained hashed n-gram embeddings. A forward
and a backward gated recurrent unit read windows of WINDOW words; attention pools the states of a window; a
logistic output scores it. Windows start every STRIDE words, so they overlap and cover the whole text, and
a document's score is the largest of its windows.

Fitting reads a bounded sample of labelled rows: PER_CLASS toxic and CLEAN_SHARE times as many clean ones at most,
smallest hash first, and of each class no more than FIT_BYTES / 2 bytes of text. All of them enter the tables of
log-odds; the network learns from the windows of all toxic ones and of CLEAN_SHARE times as many clean ones (of
CLEAN_SHARE x LEAST_TOXIC at least). While it learns, a document's log-odds come from the other FOLDS - 1 folds of
the sample, so that no document sees its own label through the tables; scoring uses the tables of the whole sample.
The fit runs in one executor task. Only documents are labelled, so a document counts through the window whose words have the largest n-gram
log-odds; clean documents give a random window besides.

Scoring is vectorised: words are found on the bytes of an Arrow batch, each distinct word of a slice is
encoded once, and all windows of a slice step through the network together. Memory is bounded by the slice
and, for a longer text, by the text.

Defined results: null counts as empty; a text without words is one empty window and gets its score;
repeated rows get equal scores; with no labelled rows of one of the classes all scores are the smoothed
share of label 1.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, named, pick, prepare, slices, typed, utf8
from tessera.llm._words import PRIME, mixed, word_hashes, words_of

WINDOW, STRIDE = 48, 36
#: Sizes: hidden units of a direction, trained parts of word and character vectors, hash tables.
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 4, 4, 8
LOG_ODDS_ROWS, EMBED_ROWS = 1 << 18, 1 << 13
NGRAMS = (3, 4, 5, 6)
#: Bytes of text that go through the network together.
SLICE_BYTES = 1 << 20
#: Labelled documents of each class that the fit reads at most.
PER_CLASS = 2_500
#: Clean documents for each toxic one in that bound.
CLEAN_SHARE = 2
#: Bytes of text of both classes that the fit reads at most.
FIT_BYTES = 64 << 20
#: Toxic documents for which the network gets clean windows at least, and folds of the tables while it learns.
LEAST_TOXIC, FOLDS = 500, 4


@dataclass
class Vocabulary:
    """Distinct words of a slice: hashes and their character n-grams (flat, with the first of each word)."""

    hashes: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    counts: np.ndarray


def vocabulary(lower: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The distinct words and, for every word, its place among them."""
    hashes = word_hashes(lower, starts, stops)
    distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = (stops - starts)[place]
    # Each distinct word between a mark of its beginning and one of its end.
    marked = sizes + 2
    first = np.concatenate([[0], np.cumsum(marked)[:-1]]) if len(marked) else np.zeros(0, np.int64)
    text = np.zeros(int(marked.sum()) + NGRAMS[-1], np.uint64)
    flat = np.arange(int(sizes.sum()))
    inner = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    shift = np.repeat(np.arange(len(sizes)) * 2 + 1, sizes)
    text[flat + shift] = lower[flat + np.repeat(starts[place] - inner, sizes)].astype(np.uint64) + np.uint64(3)
    text[first] = 1
    text[first + marked - 1] = 2
    left = np.repeat(first + marked, marked) - np.arange(int(marked.sum()))  # bytes up to the end of the word
    n = len(left)
    grams, owners, h = [], [], np.zeros(n, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), marked)
    for size in range(1, NGRAMS[-1] + 1):
        h = h * PRIME + text[size - 1 : size - 1 + n]
        if size in NGRAMS:
            fits = left >= size
            grams.append(mixed(h[fits] + np.uint64(size)))
            owners.append(owner[fits])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(sizes))
    return Vocabulary(distinct, grams[order], np.cumsum(counts) - counts, counts), inverse


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def windows_of(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window: starts every STRIDE words, the last one reaches the text's end."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return begins[text] + nth * STRIDE, text


@dataclass
class Network:
    """Log-odds tables and trained weights. A row of zeros stands for words past a window's end."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    prior: float
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def weights(seed: int = 11) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        inputs = 3 + WORD_DIM + CHAR_DIM
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        out = {"word": scale(EMBED_ROWS, WORD_DIM) * 3, "char": scale(EMBED_ROWS, CHAR_DIM) * 3}
        for d in ("f", "b"):
            out |= {f"W{d}": scale(inputs, 3 * HIDDEN), f"U{d}": scale(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        out |= {"A": scale(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": scale(ATTENTION, 1)[:, 0], "o": scale(2 * HIDDEN, 1)[:, 0], "z": np.full(1, -2.0, np.float32)}
        return out

    def inputs(self, vocab: Vocabulary) -> np.ndarray:
        """One row for each distinct word, and a row of zeros at the end."""
        n = len(vocab.hashes)
        x = np.zeros((n + 1, 3 + WORD_DIM + CHAR_DIM), np.float32)
        if n:
            x[:n, 0] = self.word_odds[vocab.hashes % np.uint64(LOG_ODDS_ROWS)]
            gram = self.gram_odds[vocab.grams % np.uint64(LOG_ODDS_ROWS)]
            x[:n, 1] = np.maximum.reduceat(gram, vocab.first)
            x[:n, 2] = np.add.reduceat(gram, vocab.first) / vocab.counts
            x[:n, 3 : 3 + WORD_DIM] = self.w["word"][vocab.hashes % np.uint64(EMBED_ROWS)]
            chars = self.w["char"][vocab.grams % np.uint64(EMBED_ROWS)]
            x[:n, 3 + WORD_DIM :] = np.add.reduceat(chars, vocab.first, axis=0) / vocab.counts[:, None]
        return x

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; index (T, B) into x, mask (T, B) of words that exist."""
        T, B = index.shape
        states = np.zeros((T, B, 2 * HIDDEN), np.float32)
        saved: dict = {}
        for d, steps in (("f", range(T)), ("b", range(T - 1, -1, -1))):
            projected = x @ self.w[f"W{d}"] + self.w[f"c{d}"]
            U, h = self.w[f"U{d}"], np.zeros((B, HIDDEN), np.float32)
            part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            trail = []
            for t in steps:
                p = projected[index[t]]
                gates = _sigmoid(p[:, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
                r, u = gates[:, :HIDDEN], gates[:, HIDDEN:]
                q = r * h
                c = np.tanh(p[:, 2 * HIDDEN :] + q @ U[:, 2 * HIDDEN :])
                new = h + u * (c - h) * mask[t][:, None]
                if keep:
                    trail.append((t, h, r, u, q, c))
                h = new
                states[t, :, part] = h
            saved[d] = trail
        e = np.tanh(states @ self.w["A"] + self.w["a"])
        scores = np.where(mask > 0, e @ self.w["v"], np.float32(-1e9))
        scores -= scores.max(axis=0)
        alpha = np.exp(scores) * mask
        alpha /= np.maximum(alpha.sum(axis=0), np.float32(1e-9))
        context = np.einsum("tb,tbh->bh", alpha, states)
        saved |= {"states": states, "e": e, "alpha": alpha, "context": context}
        return context @ self.w["o"] + self.w["z"][0], saved

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, saved: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but the embeddings, and that of the input rows."""
        g: dict[str, np.ndarray] = {"o": saved["context"].T @ dlogit, "z": np.array([dlogit.sum()], np.float32)}
        states, e, alpha = saved["states"], saved["e"], saved["alpha"]
        dcontext = dlogit[:, None] * self.w["o"]
        dalpha = np.einsum("bh,tbh->tb", dcontext, states)
        dstates = alpha[:, :, None] * dcontext
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", dscore, e)
        de = dscore[:, :, None] * self.w["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", states, de), de.sum(axis=(0, 1))
        dstates += de @ self.w["A"].T
        dx = np.zeros_like(x)
        for d in ("f", "b"):
            U, part = self.w[f"U{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            dU, dp_sum = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32)
            dh = np.zeros((index.shape[1], HIDDEN), np.float32)
            for t, h, r, u, q, c in reversed(saved[d]):
                dh = dh + dstates[t, :, part]
                m = mask[t][:, None]
                dc = dh * u * m * (1 - c * c)
                dq = dc @ U[:, 2 * HIDDEN :].T
                dgate = np.concatenate([dq * h * r * (1 - r), dh * (c - h) * m * u * (1 - u)], axis=1)
                dU[:, 2 * HIDDEN :] += q.T @ dc
                dU[:, : 2 * HIDDEN] += h.T @ dgate
                dp = np.concatenate([dgate, dc], axis=1)
                np.add.at(dp_sum, index[t], dp)
                dh = dh * (1 - u * m) + dq * r + dgate @ U[:, : 2 * HIDDEN].T
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = dU, x.T @ dp_sum, dp_sum.sum(axis=0)
            dx += dp_sum @ self.w[f"W{d}"].T
        return g, dx

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest window probability of each text."""
        lower, starts, stops, begins = words_of(raw, offsets)
        vocab, word = vocabulary(lower, starts, stops)
        if not self.w:
            return np.full(len(offsets) - 1, self.prior)
        x = self.inputs(vocab)
        first, text = windows_of(np.diff(begins), begins[:-1])
        word = np.append(word, len(vocab.hashes))
        best = np.full(len(offsets) - 1, -np.inf, np.float32)
        for a in range(0, len(first), 4096):
            at = first[a : a + 4096] + np.arange(WINDOW)[:, None]
            real = at < begins[text[a : a + 4096] + 1]
            logits, _ = self.forward(x, word[np.where(real, at, len(word) - 1)], real.astype(np.float32))
            np.maximum.at(best, text[a : a + 4096], logits)
        return 1 / (1 + np.exp(-best.astype(np.float64)))


def _odds(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-odds by table row from the numbers of toxic and of clean documents that hold it; 0 if hardly met."""
    out = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    out[(a + b) < 3] = 0
    return (np.clip(out, -4, 6) / 2).astype(np.float32)


@dataclass
class _Example:
    """A labelled window: its distinct words and, for each place, which of them stands there."""

    vocab: Vocabulary
    place: np.ndarray
    label: float
    fold: int


def _example(vocab: Vocabulary, words: np.ndarray, label: float, fold: int) -> _Example:
    own, place = np.unique(words, return_inverse=True)
    counts = vocab.counts[own]
    flat = np.arange(int(counts.sum())) + np.repeat(vocab.first[own] - (np.cumsum(counts) - counts), counts)
    # Only places in tables of LOG_ODDS_ROWS rows, of which EMBED_ROWS is a divisor, are read from hashes.
    hashes, grams = ((x % np.uint64(LOG_ODDS_ROWS)).astype(np.uint32) for x in (vocab.hashes[own], vocab.grams[flat]))
    return _Example(Vocabulary(hashes, grams, np.cumsum(counts) - counts, counts), place, label, fold)


def _joined(examples: list[_Example]) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, index, mask, labels) of a batch of windows."""
    index, mask = np.zeros((WINDOW, len(examples)), np.int64), np.zeros((WINDOW, len(examples)), np.float32)
    base = 0
    for j, x in enumerate(examples):
        index[: len(x.place), j] = base + x.place
        mask[: len(x.place), j] = 1
        base += len(x.vocab.hashes)
    index[mask == 0] = base
    counts = np.concatenate([x.vocab.counts for x in examples])
    vocab = Vocabulary(np.concatenate([x.vocab.hashes for x in examples]), np.concatenate([x.vocab.grams for x in examples]), np.cumsum(counts) - counts, counts)
    return vocab, index, mask, np.array([x.label for x in examples], np.float32)


def fit_texts(texts: list[str], labels: np.ndarray, epochs: int = 5, batch: int = 96, least_steps: int = 120, rate: float = 0.01, seed: int = 5) -> Network:
    """Train on whole texts with document labels (0 or 1). Memory holds the texts, the tables and the windows."""
    labels = np.asarray(labels).astype(bool)
    n1, n0 = int(labels.sum()), int((~labels).sum())
    prior = (n1 + 1) / (n1 + n0 + 2)
    zeros = np.zeros(LOG_ODDS_ROWS, np.float32)
    if not n1 or not n0:
        return Network(zeros, zeros, prior)

    def parsed(text: str | None) -> tuple[Vocabulary, np.ndarray]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return vocabulary(*words_of(raw, np.array([0, len(raw)]))[:3])

    rng = np.random.default_rng(seed)
    # Folds by the text, so that copies of a document are left out together.
    fold_of = np.array([zlib.crc32((t or "").encode()) % FOLDS for t in texts])
    met = np.zeros((FOLDS, 2, 2, LOG_ODDS_ROWS), np.int32)  # words or grams, clean or toxic
    for text, toxic, fold in zip(texts, labels, fold_of, strict=True):
        vocab, _ = parsed(text)
        for kind, hashes in enumerate((vocab.hashes, vocab.grams)):
            met[fold, kind, int(toxic), np.unique(hashes % np.uint64(LOG_ODDS_ROWS)).astype(np.int64)] += 1
    total = met.sum(axis=0)
    tables = []
    for fold in range(FOLDS):
        rest, own = total - met[fold], fold_of == fold
        m1, m0 = n1 - int((labels & own).sum()), n0 - int((~labels & own).sum())
        tables.append((_odds(rest[0, 1], rest[0, 0], m1, m0), _odds(rest[1, 1], rest[1, 0], m1, m0)))
    net = Network(_odds(total[0, 1], total[0, 0], n1, n0), _odds(total[1, 1], total[1, 0], n1, n0), prior, Network.weights())
    final = (net.word_odds, net.gram_odds)
    clean = rng.permutation(np.flatnonzero(~labels))[: CLEAN_SHARE * max(n1, LEAST_TOXIC)]
    examples: list[_Example] = []
    for i in np.concatenate([np.flatnonzero(labels), clean]):
        vocab, word = parsed(texts[i])
        fold = int(fold_of[i])
        first, _ = windows_of(np.array([len(word)]), np.array([0]))
        odds = np.maximum.reduceat(tables[fold][1][vocab.grams % np.uint64(LOG_ODDS_ROWS)], vocab.first)[word] if len(word) else np.zeros(0)
        top = int(first[int(np.argmax([odds[a : a + WINDOW].max(initial=0) for a in first]))])
        examples.append(_example(vocab, word[top : top + WINDOW], float(labels[i]), fold))
        if not labels[i]:
            other = int(first[rng.integers(len(first))])
            examples.append(_example(vocab, word[other : other + WINDOW], 0.0, fold))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(examples)))):
        order = rng.permutation(len(examples))
        batches = [own[a : a + batch] for fold in range(FOLDS) for own in [[i for i in order if examples[i].fold == fold]] for a in range(0, len(own), batch)]
        for b in rng.permutation(len(batches)):
            vocab, index, mask, target = _joined([examples[i] for i in batches[b]])
            net.word_odds, net.gram_odds = tables[examples[batches[b][0]].fold]
            n = len(vocab.hashes)
            x = net.inputs(vocab)
            logits, saved = net.forward(x, index, mask, keep=True)
            balance = np.where(target > 0, 1.0, 0.5).astype(np.float32)
            g, dx = net.gradients(x, index, mask, saved, ((_sigmoid(logits) - target) * balance / len(target)).astype(np.float32))
            g["word"], g["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
            if n:
                np.add.at(g["word"], (vocab.hashes % np.uint64(EMBED_ROWS)).astype(np.int64), dx[:n, 3 : 3 + WORD_DIM])
                np.add.at(g["char"], (vocab.grams % np.uint64(EMBED_ROWS)).astype(np.int64), np.repeat(dx[:n, 3 + WORD_DIM :] / vocab.counts[:, None], vocab.counts, axis=0))
            step += 1
            for k, grad in g.items():
                m, s = moments[k]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                net.w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.word_odds, net.gram_odds = final
    return net


def sampled_ids(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """(key, label) of per_class toxic and CLEAN_SHARE times as many clean ids at most, those with the smallest hash."""
    known = pick(labels, key=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.max("label").cast("int").alias("label"))
    order = (F.xxhash64("key"), F.col("key"))
    return known.where("label = 1").orderBy(*order).limit(per_class).unionByName(known.where("label = 0").orderBy(*order).limit(per_class * CLEAN_SHARE))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> Network:
    """Fit on (1 + CLEAN_SHARE) x per_class labelled documents and fit_bytes bytes of text at most."""
    chosen = F.broadcast(sampled_ids(labels, id_col, label_col, per_class))
    rows = pick(docs, key=id_col, text=text_col).join(chosen, "key").select("key", "text", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = rows.withColumn("bytes", F.sum("bytes").over(so_far)).where(F.col("bytes") <= fit_bytes // 2).select("key", "text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            known += batch.column("label").to_pylist()
        yield pa.record_batch({"net": pa.array([pickle.dumps(fit_texts(texts, np.array(known, np.int64)))], pa.binary())})

    # One executor task learns; if it is lost, it runs again, from the same sample in the same order.
    ordered = bounded.repartition(1).sortWithinPartitions("key", "text", "label").select("text", "label")
    learned = arrow_map(ordered, learn, "net binary").collect()
    return pickle.loads(learned[0].net) if learned else fit_texts([], np.zeros(0, np.int64))


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for every row."""
    schema = pa.schema([("key", arrow_type(docs, id_col)), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded: the tables and weights have fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield named(schema, key=part.column("key"), score=net.scores(*utf8(part.column("text"))))

    return arrow_map(pick(docs, key=id_col, text=text_col), run, f"{typed(docs, id_col, 'key')}, score double").withColumnRenamed("key", id_col)


def with_scores(docs: DataFrame, net: Network, name: str, text_col: str = "text") -> DataFrame:
    """docs with a score column; only texts go to Python."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for array in texts:
            batch = pa.RecordBatch.from_arrays([array], names=["text"])
            parts = [net.scores(*utf8(part.column("text"))) for part in slices(batch, "text", SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(name, score(F.col(f"`{text_col}`")))
