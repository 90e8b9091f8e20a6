"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings; filters of several
widths slide over the whole text, each keeps its maximum, and a logistic layer weighs the maxima. The
driver fits it on a bounded sample of labelled rows; executors score all texts, chunk by chunk. A score
depends on the text alone. Thresholds are chosen for each language on rows held back from the fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import textkit as K
from thicket.llm.shared import beside, fresh

BUCKETS, DIM, FILTERS, WIDTHS, BEGINNINGS = 1 << 16, 8, 8, (1, 2, 3), (3, 4, 5)
#: Bounds of the sample that a model is fitted on: rows of each label, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
EPOCHS, BATCH, RATE = 4, 32, 0.05
THRESHOLD = 0.3
PAD = max(WIDTHS)


def features(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each distinct word (its hash's and its beginnings'), the distinct word at each place, and
    each document's first and end place. PAD places of no word (index -1) close each document."""
    points, starts, ends = K.words(chunk)
    hashes = K.hash_spans(points, starts, ends)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    order = np.argsort(s)
    columns = [hashes[at]]
    for k in BEGINNINGS:
        part = np.empty(len(at), np.uint64)
        part[order] = K.hash_spans(points, s[order], np.minimum(s + k, e)[order])
        columns.append(K.mix64(part + np.uint64(k)))
    buckets = (np.stack(columns, axis=1) % np.uint64(BUCKETS)).astype(np.int32) if len(at) else np.empty((0, 1 + len(BEGINNINGS)), np.int32)
    first, end = np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends)
    n = end - first
    places = np.full(int((n + PAD).sum()), -1, np.int64)
    last = np.cumsum(n + PAD)
    begin = last - (n + PAD)
    places[K.ragged(begin, n)] = which[K.ragged(first, n)]
    return buckets, places, begin, last


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, buckets: np.ndarray, places: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' responses at each place; windows that would reach into the next
        document have none."""
        own = np.zeros((len(buckets) + 1, DIM), np.float32)  # the last row stands for no word
        for k in range(buckets.shape[1]):
            own[:-1] += self.embedding[buckets[:, k]]
        out = []
        for width, kernel in self.filters.items():
            total = (own @ kernel[0])[places]
            for j in range(1, width):
                total[:-j] += (own @ kernel[j])[places[j:]]
                total[last - j] = -np.inf
            out.append(total)
        return out

    def logits(self, chunk: K.Chunk) -> np.ndarray:
        buckets, places, begin, last = features(chunk)
        pooled = np.concatenate([np.maximum.reduceat(r, begin, axis=0) for r in self.responses(buckets, places, last)], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.offset

    def score(self, chunk: K.Chunk) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(chunk).astype(np.float64) + b, -30, 30)))


def _start(chunks: list, labels: list[np.ndarray], rng: np.random.Generator) -> Model:
    """Random but for the first dimension: a bucket's shrunken log odds of toxic against other documents,
    which the first filter of width 1 reads."""
    with_, docs = np.zeros((2, BUCKETS)), np.zeros(2)
    for (buckets, places, begin, last), y in zip(chunks, labels, strict=True):
        for a, b, label in zip(begin.tolist(), (last - PAD).tolist(), y.tolist(), strict=True):
            with_[label, np.unique(buckets[places[a:b]])] += 1
            docs[label] += 1
    seen = with_.sum(axis=0)
    odds = np.log((with_[1] + 0.5) / (docs[1] + 1)) - np.log((with_[0] + 0.5) / (docs[0] + 1))
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.where(seen > 0, odds * seen / (seen + 10), 0) / 4
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    filters[1][0, :, 0] = np.eye(DIM, dtype=np.float32)[0]
    n = FILTERS * len(WIDTHS)
    weight = rng.normal(0, 0.1, n).astype(np.float32)
    weight[0] = 1.0
    return Model(embedding, filters, np.zeros(n, np.float32), weight, -1.0)


def fit(texts: list[str], labels: np.ndarray, languages: list[str], positive_share: float, seed: int = 7) -> Model:
    """Fit on texts with labels 0 and 1, and calibrate on every fifth: scores to the share of label 1 among
    all labelled rows, thresholds by language (THRESHOLD where few rows of a language are held back).

    Without texts of both labels the model scores ``positive_share`` everywhere.
    """
    rng = np.random.default_rng(seed)
    part = [i for i in range(len(texts)) if i % 5 != 4]
    held = [i for i in range(len(texts)) if i % 5 == 4]
    part = [part[i] for i in rng.permutation(len(part))]
    y = np.asarray(labels, np.int64)
    base = float(np.clip(positive_share, 1e-3, 1 - 1e-3))
    if len(set(y[part].tolist())) < 2:
        model = _start([], [], rng)
        model.scale = (0.0, float(np.log(base / (1 - base))))
        return model
    groups = [part[i : i + BATCH] for i in range(0, len(part), BATCH)]
    chunks = [features(next(K.chunks(pa.array([texts[i] for i in g]), 1 << 40))) for g in groups]
    model = _start(chunks, [y[g] for g in groups], rng)
    squares = {"e": np.full((BUCKETS, 1), 1e-3, np.float32), "v": np.full_like(model.weight, 1e-3), "b": np.full_like(model.bias, 1e-3), "o": 1e-3}
    squares |= {w: np.full_like(k, 1e-3) for w, k in model.filters.items()}
    for _ in range(EPOCHS):
        for c in rng.permutation(len(chunks)):
            _step(model, squares, chunks[c], y[groups[c]])
    _calibrate(model, [texts[i] for i in held], y[held], [languages[i] for i in held], base)
    return model


def _step(model: Model, squares: dict, chunk: tuple, y: np.ndarray) -> None:
    """One step of AdaGrad; only the places that gave a maximum have a gradient."""
    buckets, places, begin, last = chunk
    responses = model.responses(buckets, places, last)
    spans = list(zip(begin.tolist(), last.tolist(), strict=True))
    best = [np.stack([r[a:b].argmax(axis=0) + a for a, b in spans]) for r in responses]
    pooled = np.concatenate([np.take_along_axis(r, at, axis=0) for r, at in zip(responses, best, strict=True)], axis=1) + model.bias
    hidden = np.maximum(pooled, 0)
    wrong = ((1 / (1 + np.exp(-np.clip(hidden @ model.weight + model.offset, -30, 30))) - y) / len(y)).astype(np.float32)
    back = wrong[:, None] * model.weight * (pooled > 0)

    def move(value, gradient, key):
        squares[key] += gradient**2
        value -= RATE * gradient / np.sqrt(squares[key])

    own = np.zeros((len(buckets) + 1, DIM), np.float32)
    for k in range(buckets.shape[1]):
        own[:-1] += model.embedding[buckets[:, k]]
    word_gradient = np.zeros_like(own)
    kernel_gradients = {}
    for i, (width, kernel) in enumerate(model.filters.items()):
        delta = back[:, i * FILTERS : (i + 1) * FILTERS]
        gradient = np.zeros_like(kernel)
        for j in range(width):
            word = places[best[i] + j]
            gradient[j] = np.einsum("dfk,df->kf", own[word], delta)
            np.add.at(word_gradient, word.ravel(), (delta[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
        kernel_gradients[width] = gradient
    move(model.weight, hidden.T @ wrong + 1e-4 * model.weight, "v")
    move(model.bias, back.sum(axis=0), "b")
    squares["o"] += float(wrong.sum()) ** 2
    model.offset -= RATE * float(wrong.sum()) / np.sqrt(squares["o"])
    for width, gradient in kernel_gradients.items():
        move(model.filters[width], gradient, width)
    touched = np.flatnonzero(np.abs(word_gradient[:-1]).sum(axis=1) > 0)
    rows = buckets[touched].ravel()
    gradient = np.repeat(word_gradient[touched], buckets.shape[1], axis=0)
    np.add.at(squares["e"], (rows, 0), (gradient**2).mean(axis=1))
    np.add.at(model.embedding, rows, -RATE * gradient / np.sqrt(squares["e"][rows]))


def _calibrate(model: Model, texts: list[str], y: np.ndarray, languages: list[str], base: float) -> None:
    if len(set(y.tolist())) < 2:
        return
    logits = np.concatenate([model.logits(c) for c in K.chunks(pa.array(texts, pa.string()))]).astype(np.float64)
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit of two numbers, with a little weight decay on both
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([(weight * (p - y) * logits).sum() + 0.1 * (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        h = weight * p * (1 - p)
        hessian = np.array([[(h * logits**2).sum() + 0.1, (h * logits).sum()], [(h * logits).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    model.scale = (max(a, 0.05), b)
    scores = 1 / (1 + np.exp(-np.clip(model.scale[0] * logits + model.scale[1], -30, 30)))
    for language in sorted({x for x in languages if x is not None}):
        own = np.array([x == language for x in languages])
        if y[own].sum() < 20 or (1 - y[own]).sum() < 20:
            continue
        tried = np.arange(0.1, 0.91, 0.05)
        fs = []
        for t in tried:
            hit = (scores[own] >= t) * weight[own]
            fs.append(2 * (hit * y[own]).sum() / max(1e-9, hit.sum() + (weight[own] * y[own]).sum()))
        top = tried[np.array(fs) >= max(fs) - 1e-9]
        model.thresholds[language] = float(top[np.argmin(np.abs(top - THRESHOLD))])


def fold(doc_id: str = "doc_id"):
    """Whether a row is held out from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on at most ``rows`` rows of each label, chosen by a hash of the id from labelled rows
    that aren't held out; texts over SAMPLE_CHARS characters aren't in the sample. Rows whose label or id
    is null are not labelled; a document with several labels has the largest, and of several texts of one id
    the least by its hash is taken. No more than 2 * ``rows`` texts reach the driver, whatever ids repeat."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~fold(doc_id)).groupBy(doc_id).agg(F.max("toxic").cast("int").alias("toxic"))
    count = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    short = docs.where(F.length(own) <= SAMPLE_CHARS)
    # Which ids are fit to be chosen is settled before any text is read: ids have a short text and a label.
    fit_ids = known.join(short.select(doc_id), doc_id, "left_semi")
    sides = [fit_ids.where(F.col("toxic") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(rows) for y in (0, 1)]
    chosen = F.broadcast(sides[0].unionAll(sides[1]))
    picked = short.select(doc_id, F.struct(F.xxhash64(own).alias("h"), own.alias("text"), language.alias("lang")).alias("row")).join(chosen, doc_id)
    one = picked.groupBy(doc_id, "toxic").agg(F.min("row").alias("row"))
    found = one.select(F.col("row.text").alias("_text"), F.col("row.lang").alias("_lang"), "toxic", F.xxhash64(doc_id).alias("_order"), doc_id).toPandas().sort_values(["_order", doc_id])
    total = sum(count.values())
    return fit(found["_text"].tolist(), found["toxic"].to_numpy(), found["_lang"].tolist(), count.get(True, 0) / total if total else 0.0)


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the whole text's score in ``out`` (replaced if it is there). A null text
    counts as empty; empty texts have a score too. Rows stand each for itself; no rows give none."""
    again = fresh(docs, text)
    rows, keep, schema = beside(docs.withColumn(again, F.col(text)), again, "string", [out])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = np.empty(batch.num_rows)
            for chunk in K.chunks(texts):
                scores[chunk.lo : chunk.hi] = model.score(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], [*keep, out])

    return rows.mapInArrow(run, f"{schema}`{out}` double")


def rejected(score, language, model: Model):
    """Whether a score reaches its language's threshold, THRESHOLD for languages without their own."""
    limit = F.lit(THRESHOLD)
    for name, at in sorted(model.thresholds.items()):
        limit = F.when(language == name, F.lit(at)).otherwise(limit)
    return score >= limit
