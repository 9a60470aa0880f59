"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, batches, bounded_sample, bytes_of

BUCKETS = 1 << 20
SIZES = (3, 5, 7)
#: Words whose subwords are held at once in training.
CHUNK = 20_000
#: Words of texts that training and scoring take at a time; rows whose texts scoring holds as bytes at once.
TOGETHER = 200_000
ROWS = 500
#: Distinct words whose score a worker remembers.
REMEMBERED = 150_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each <word> and of the whole word, flat, and where each word's begin."""
    marked = b"".join(b"<" + w + b">" for w in words)
    data = np.frombuffer(marked, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    buckets, owner = [], []
    for n in SIZES:
        at = np.flatnonzero(ends[word] - np.arange(len(data)) >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ data[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(31)
        buckets.append(h)
        owner.append(word[at])
    # the whole word: a polynomial over its bytes, so that any length is one pass
    power = np.ones(int(sizes.max(initial=1)), np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(power, dtype=np.uint64)
    whole = np.add.reduceat((data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends - sizes, sizes)], ends - sizes)
    buckets.append(whole ^ (whole >> np.uint64(29)))
    owner.append(np.arange(len(words)))
    flat, own = np.concatenate(buckets), np.concatenate(owner)
    flat = ((flat * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return flat[order], np.concatenate(([0], np.cumsum(counts)[:-1]))


class Model:
    """Class scores of a text: its words' vectors (each the average of its subwords' embeddings) are
    averaged, over the whole text and over every run of ``window`` words, and a linear softmax is applied to
    each average.  For two classes the log-odds of an average are the average of its words' log-odds.  The
    text's score is a logistic function of two log-odds, those of the most toxic run and those of the
    whole text, so that one insult in a long text is not averaged away.  Subwords that training saw in
    too few texts have no vector and count for nothing."""

    def __init__(self, direction: np.ndarray, bias: float, window: int, scale: tuple[float, float, float] = (1.0, 0.0, 0.0)):
        self.direction, self.bias, self.window, self.scale = direction.astype(np.float32), bias, window, scale

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of each word; the subwords of ``CHUNK`` words are held at once."""
        out = np.zeros(len(words))
        for i in range(0, len(words), CHUNK):
            flat, first = subwords(words[i : i + CHUNK])
            part = self.direction[flat].astype(np.float64)
            out[i : i + CHUNK] = np.add.reduceat(part, first) / np.maximum(np.add.reduceat((part != 0).astype(np.int64), first), 1)
        return out

    def evidence(self, scores: np.ndarray) -> tuple[float, float]:
        """Log-odds of the most toxic run and of the whole text; a text of no words has the bias alone."""
        if not len(scores):
            return self.bias, self.bias
        total = np.concatenate(([0.0], np.cumsum(scores)))
        n = min(self.window, len(scores))
        return self.bias + float((total[n:] - total[:-n]).max()) / n, self.bias + float(total[-1]) / len(scores)

    def probability(self, evidence: list[tuple[float, float]] | np.ndarray) -> np.ndarray:
        x = np.asarray(evidence, np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.scale[:2]) + self.scale[2], -40, 40)))


def _adam(shape, rate: float):
    m, v, t = np.zeros(shape), np.zeros(shape), 0

    def step(value: np.ndarray, grad: np.ndarray) -> None:
        nonlocal m, v, t
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    return step


def fit(texts: list[bytes | None], labels: list[int], dim: int = 4, window: int = 1, least: int = 2, warm: int = 15, epochs: int = 45, shrink: float = 1e-4, seed: int = 5) -> Model:
    """Embeddings and softmax trained jointly by full-batch Adam.  ``warm`` epochs average whole texts; then
    the gradient of each text comes from its most toxic run, as in scoring.  Subwords of fewer than
    ``least`` word-in-text places are left out.  A text in which no run is
    toxic, or a label that all texts share, is fine.  Deterministic."""
    y = np.array(labels, np.int64)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    rng = np.random.default_rng(seed)
    W, b = rng.normal(0, 0.3, (2, dim)), np.zeros(2)
    if not vocabulary or len(set(labels)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 2)  # without labels: not toxic
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))), window)
    places = np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=len(vocabulary))
    # subwords of some words at a time: first to count them, then to keep the active ones
    names = list(vocabulary)
    parts = [(at, names[at : at + CHUNK]) for at in range(0, len(names), CHUNK)]
    seen = np.zeros(BUCKETS)
    for at, part in parts:
        flat, first = subwords(part)
        seen += np.bincount(flat, np.repeat(places[at : at + len(part)], np.diff(np.append(first, len(flat)))), BUCKETS)
    active = np.flatnonzero(seen >= least)
    kept, sizes_of = [], []
    for _, part in parts:
        flat, first = subwords(part)
        stay = seen[flat] >= least
        sizes_of.append(np.add.reduceat(stay.astype(np.int64), first))
        kept.append(np.searchsorted(active, flat[stay]).astype(np.int32))
    flat, n_of = np.concatenate(kept), np.concatenate(sizes_of)
    del kept, sizes_of, seen
    begin = np.concatenate(([0], np.cumsum(n_of)))
    count = np.maximum(n_of, 1)

    def blocks(used: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Words at a time: where they stand in ``used``, their subwords, and whose each is."""
        for i in range(0, len(used), CHUNK):
            u = used[i : i + CHUNK]
            n = n_of[u]
            at = np.repeat(begin[u] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield slice(i, i + len(u)), flat[at], np.repeat(np.arange(len(u)), n)

    E = rng.normal(0, 0.1, (len(active), dim))
    words = np.concatenate(ids)
    sizes = np.array([len(i) for i in ids])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    steps = _adam(E.shape, 0.03), _adam(W.shape, 0.03), _adam(b.shape, 0.03)
    has = np.flatnonzero(sizes)
    everything = np.arange(len(vocabulary))
    # texts with words, some ``TOGETHER`` words of them at a time
    groups = np.split(has, np.flatnonzero(np.diff(ends[has] // TOGETHER)) + 1)
    for epoch in range(warm + epochs):
        if epoch < warm:
            lo, n = starts.copy(), np.maximum(sizes, 1)
        else:
            direction = E @ (W[1] - W[0])
            score = np.concatenate([np.bincount(own, direction[f], at.stop - at.start) for at, f, own in blocks(everything)]) / count
            n = np.clip(sizes, 1, window)
            lo, carry = starts.copy(), 0.0
            for g in groups:  # runs of full length, all at once; those that cross a text's end are left out
                a, z = starts[g[0]], ends[g[-1]]
                total = np.cumsum(np.concatenate(([carry], score[words[a:z]])))
                carry = total[-1]
                run = np.full(z - a, -np.inf)
                if z - a >= window:
                    run[: z - a - window + 1] = total[window:] - total[:-window]
                run[np.arange(a, z) + window > np.repeat(ends[g], sizes[g])] = -np.inf
                best = np.maximum.reduceat(run, starts[g] - a)
                doc = np.repeat(np.arange(len(g)), sizes[g])
                at = np.flatnonzero((run == best[doc]) & np.isfinite(run))
                lo[g[doc[at[::-1]]]] = at[::-1] + a  # the first of equal runs
        # words of the chosen runs, and their texts
        n = np.where(sizes == 0, 0, np.minimum(n, sizes))
        text = np.repeat(np.arange(len(y), dtype=np.int32), n)
        if epoch < warm:
            used, where = everything, words
        else:
            pick = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            used, where = np.unique(words[pick], return_inverse=True)
        vec = np.concatenate([np.stack([np.bincount(own, E[f, d], at.stop - at.start) for d in range(dim)], 1) for at, f, own in blocks(used)]) / count[used][:, None]
        mean = np.stack([np.bincount(text, vec[where, d], len(y)) for d in range(dim)], 1) / np.maximum(n, 1)[:, None]
        logits = mean @ W.T + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = p * weight[:, None]
        grad[np.arange(len(y)), y] -= weight
        g_mean = grad @ W / np.maximum(n, 1)[:, None]
        g_vec = np.stack([np.bincount(where, g_mean[text, d], len(used)) for d in range(dim)], 1) / count[used][:, None]
        g_E = np.zeros(E.shape)
        for at, f, own in blocks(used):
            g = g_vec[at][own]
            for d in range(dim):
                g_E[:, d] += np.bincount(f, g[:, d], len(active))
        steps[0](E, g_E + shrink * E)
        steps[1](W, grad.T @ mean + 1e-5 * W)
        steps[2](b, grad.sum(0))
    direction = np.zeros(BUCKETS)
    direction[active] = E @ (W[1] - W[0])
    model = Model(direction, float(b[1] - b[0]), window)
    # the two log-odds are weighed on the same texts: three numbers, by Newton steps
    score = model.words(names)
    x = np.array([model.evidence(score[i]) for i in ids])
    mid, wide = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mid) / wide, np.ones(len(x))))
    ridge, abc = np.array([1e-2, 1e-2, 0.0]), np.array([1.0, 0.0, 0.0])

    def loss(abc: np.ndarray) -> float:
        return float(np.logaddexp(0, (1 - 2 * y) * (z @ abc)).sum() + 0.5 * (ridge * abc**2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ abc, -40, 40)))
        q = p * (1 - p) + 1e-6
        step = np.linalg.solve((z * q[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * abc)
        while loss(abc - step) > loss(abc) and np.abs(step).max() > 1e-9:
            step /= 2
        abc = abc - step
    weights = abc[:2] / wide
    model.scale = (float(weights[0]), float(weights[1]), float(abc[2] - weights @ mid))
    return model


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_bytes: int = 32 << 20, **options) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, label: 0 or 1; nulls are left out).

    At most ``max_docs`` labelled rows and ``max_bytes`` of text, chosen by a hash of doc_id, go to the driver.
    The labels are sampled before the join, so their side is small enough to broadcast and no text is shuffled.
    """
    rows = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").alias("__l_id"), F.col("label").cast("int").alias("__label"))
    few = bounded_sample(rows.withColumn("__none", F.lit("")), "__l_id", max_docs, max_bytes, "__none").drop("__none")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__l_id"))
    chosen = bounded_sample(joined, "doc_id", max_docs, max_bytes, seed=8)
    got = chosen.select("doc_id", "__label", "text").toArrow().sort_by([("doc_id", "ascending"), ("__label", "ascending"), ("text", "ascending")])
    texts, marks = got["text"].cast(pa.large_binary()).to_pylist(), [int(x > 0) for x in got["__label"].to_pylist()]
    del got
    return fit(texts, marks, **options)


def score(docs: DataFrame, model: Model, keep: list[Column | str] = (), text: bool = False) -> DataFrame:
    """doc_id, score (0 to 1, higher: more likely toxic), predicted (1 if score >= 0.5), the columns ``keep``; ``text``:
    and after ``predicted`` the text as a string, which so passes the worker once.

    One row per input row, over the whole text.  Null and empty texts and texts without words get the score
    of no evidence; repeated rows are scored each; an empty table gives an empty result; other columns are
    ignored.  Words never seen in training score by the character n-grams they share with those that were.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    first = 1 if text else 2
    kept = source.columns[first:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for b in batches(parts):
            odds, pending, size = [], [], 0

            def settle() -> None:
                nonlocal pending, size
                new = list({w for words in pending for w in words if w not in known})
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list({w for words in pending for w in words})
                known.update(zip(new, model.words(new).tolist(), strict=True))
                for words in pending:
                    odds.append(model.evidence(np.fromiter(map(known.__getitem__, words), np.float64, len(words))))
                pending, size = [], 0

            for i in range(0, b.num_rows, ROWS):
                for t in bytes_of(b.column(1).slice(i, ROWS)):
                    pending.append(words_of(t))
                    size += len(pending[-1])
                    if size > TOGETHER:
                        settle()
            settle()
            p = model.probability(odds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(b.column(first + i) for i in range(len(kept)))], ["doc_id", "score", "predicted", *kept]
            )

    made = StructType([source.schema[0], *StructType.fromDDL("score double, predicted int").fields, *source.schema.fields[first:]])
    return source.mapInArrow(run, made)
