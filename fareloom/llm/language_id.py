"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.sampling import bounded_sample
from fareloom.llm.text import as_text, parts

UNKNOWN = "und"
BUCKETS = 1 << 12
DIMENSIONS = 16
#: Labelled documents of each language that the fit uses at most.
PER_LANGUAGE = 600
EPOCHS = 12
#: Share of the calibration documents below the point from which a limit of rejection is taken.
REJECTED_SHARE = 0.001
#: Part of every language's subwords that may be any bucket at all.
STRAY = 0.02

_LETTER = regex.compile(r"\p{L}")


def subwords(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the whole text, inside words and across their edges.

    Everything but letters (and other bytes beyond ASCII) counts as one kind of
    gap; trigrams around a gap's middle are left out.
    """
    return _buckets(_codes(text))


def _codes(text: str) -> np.ndarray:
    """A code per byte of the text between two gaps; gaps are 32."""
    table = np.full(256, 32, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    return table[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]


def _buckets(codes: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each code but the first and last, gaps left out."""
    x = codes.astype(np.uint32)
    kept = x[1:-1] != 32
    grams = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16)))[kept]
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def bucket_counts(text: str, step: int = 1 << 20) -> np.ndarray:
    """How often each bucket occurs; long texts are read in slices, each trigram in the slice of its middle."""
    codes, total = _codes(text), np.zeros(BUCKETS, np.float32)
    for low in range(0, len(codes) - 2, step):
        total += np.bincount(_buckets(codes[low : low + step + 2]), minlength=BUCKETS)
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0
    #: For each language, the log of how much likelier than by chance each bucket is in it.
    profiles: np.ndarray | None = None
    #: For each language, the least mean of its profile over a text that is not rejected.
    lowest: np.ndarray | None = None

    def logits(self, counts: np.ndarray) -> np.ndarray:
        """Rows of bucket counts to logits: the average embedding through the linear layer."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
        return (counts @ self.embedding / total) @ self.weights + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)

    def typical(self, counts: np.ndarray) -> np.ndarray:
        """Rows of bucket counts to the mean of each language's profile over them."""
        return counts @ self.profiles.T / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)

    def rejects(self, counts: np.ndarray, best: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Whether a text is told with too little confidence, or unlike what its language was learned from."""
        unlike = self.typical(counts)[np.arange(len(best)), best] < self.lowest[best]
        return (sure < self.limit) | unlike


def fit_model(counts: list[np.ndarray], labels: list[str], seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on four fifths of the documents; the rest calibrate.

    Calibration picks the temperature of least log loss and two limits of
    rejection, each midway between what all but REJECTED_SHARE of the rightly
    told calibration documents reach and what a text gets that tells nothing:
    for the confidence an even chance, for the likeness to a language the mean
    of its profile over all buckets. The second limit rejects scripts and
    languages that were not learned, and letters in no order, of which a
    softmax may be quite sure.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    x = np.stack(counts) if counts else np.zeros((0, BUCKETS), np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1.0)
    rng = np.random.default_rng(seed)
    model = LanguageModel(
        languages,
        rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32),
        np.zeros((DIMENSIONS, len(languages)), np.float32),
        np.zeros(len(languages), np.float32),
    )
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    shares = [x[train[y[train] == k]].mean(axis=0) if (y[train] == k).any() else np.zeros(BUCKETS) for k in range(len(languages))]
    model.profiles = np.log((1 - STRAY) * BUCKETS * np.array(shares).reshape(-1, BUCKETS) + STRAY).astype(np.float32)
    model.lowest = model.profiles.mean(axis=1)
    if len(languages) < 2:
        _set_limits(model, x[held], y[held])
        return model
    model.weights[:] = rng.normal(0, 0.1, model.weights.shape)
    batch = 16
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        rng.shuffle(train)
        for low in range(0, len(train), batch):
            rows = train[low : low + batch]
            inside = x[rows] @ model.embedding
            error = _softmax(inside @ model.weights + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ model.weights.T
            model.weights -= rate * inside.T @ error
            model.bias -= rate * error.sum(axis=0)
            seen = np.flatnonzero(x[rows].any(axis=0))
            model.embedding[seen] -= 50 * rate * (x[np.ix_(rows, seen)].T @ back)
    if len(held):
        logits = model.logits(x[held])
        grid = np.geomspace(0.2, 5, 33)
        losses = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        _set_limits(model, x[held], y[held])
    return model


def _set_limits(model: LanguageModel, x: np.ndarray, y: np.ndarray) -> None:
    if not len(y):
        return
    chances = model.probabilities(x)
    right = np.flatnonzero(chances.argmax(axis=1) == y)
    if not len(right):
        return
    reached = np.quantile(chances[right, y[right]], REJECTED_SHARE)
    model.limit = float((reached + 1 / len(model.languages)) / 2)
    typical, blind = model.typical(x[right])[np.arange(len(right)), y[right]], model.profiles.mean(axis=1)
    for k in np.unique(y[right]):
        model.lowest[k] = (np.quantile(typical[y[right] == k], REJECTED_SHARE) + blind[k]) / 2


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", **settings) -> LanguageModel:
    """Fit on at most PER_LANGUAGE documents of each language; their counts come to the driver, not their texts."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    per = settings.get("per_language", PER_LANGUAGE)
    sample = bounded_sample(rows.where("text is not null"), "lang", "key", per).orderBy(F.xxhash64("key"), "key", "lang")
    found = sample.select("lang", _sparse_counts(F.col("text")).alias("c")).collect()
    dense = []
    for row in found:
        counts = np.zeros(BUCKETS, np.float32)
        counts[row["c"]["bucket"]] = row["c"]["times"]
        dense.append(counts)
    return fit_model(dense, [r["lang"] for r in found])


def _sparse_counts(text: Column) -> Column:
    kind = pa.struct([("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            out = []
            for text in as_text(texts):
                counts = bucket_counts(text)
                seen = np.flatnonzero(counts)
                out.append({"bucket": seen, "times": counts[seen]})
            yield pa.array(out, kind)

    return F.arrow_udf(run, "struct<bucket:array<int>,times:array<float>>")(text)


def identify(text: Column, model: LanguageModel) -> Column:
    """struct<lang, score, rejected> of whole texts.

    ``lang`` is ``und`` with score 0 for null texts and texts without a letter,
    or if no language was learned; these are rejected, and so are texts below
    the model's limit of confidence or of likeness to their language.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            langs, scores, out = [], [], []
            whole = as_text(texts)
            for low in range(0, len(whole), 256):
                part = whole[low : low + 256]
                lettered = [bool(model.languages) and _LETTER.search(t) is not None for t in part]
                counts = np.stack([bucket_counts(t) for t in part])
                if model.languages:
                    chances = model.probabilities(counts)
                    best = chances.argmax(axis=1)
                    sure = chances[np.arange(len(part)), best]
                    langs += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                    scores += [float(s) if ok else 0.0 for s, ok in zip(sure, lettered)]
                    out += [bool(r) or not ok for r, ok in zip(model.rejects(counts, best, sure), lettered)]
                else:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    out += [True] * len(part)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())],
                fields=list(kind),
            )

    return F.arrow_udf(run, "struct<lang:string,score:double,rejected:boolean>")(text)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang, score, rejected), a row per row of ``docs``; an empty table gives none."""
    found = docs.select(F.col(doc_id).alias("doc_id"), identify(F.col(text), model).alias("found"))
    return found.select("doc_id", "found.*")


def drop_unidentified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    return docs.where(~identify(F.col(text), model)["rejected"])
