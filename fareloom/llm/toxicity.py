"""Toxicity: a small convolutional network over hashed word embeddings, trained in shards whose networks are averaged."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.text import WordBlock, WordHasher, as_text, blocks, mixed, parts
from fareloom.staging import stage

BUCKETS = 1 << 16
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: A word is the sum of the rows of the whole word and of its first bytes.
BEGINNINGS = (4, 5)
#: Labelled documents that one shard has about, and the bytes of word rows at which it is cut.
SHARD = 2000
SHARD_BYTES = 1 << 23
EPOCHS = 6
#: One labelled document in so many sets the thresholds and trains nothing.
HELD = 5
#: Fixed-point steps of a parameter while shards are added up, so that the order of the additions changes nothing.
FIXED = 1 << 32
#: Cells per unit of a logit, in which the held documents are counted for the thresholds.
CELLS = 64
SEED = 11
#: How a row of the embedding is stored.
ROW = np.uint16
#: Bits of the bitmap of labelled ids; fixed, whatever the input.
LISTED_BITS = 1 << 26
#: The score at which a document counts as toxic; the calibration puts each language's threshold there.
CUT = 0.7

# Common words that tell the language of a text, for the thresholds only.
COMMON_WORDS = {
    "en": "the and of to in is that it for was with on are be this as at by from or an",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les et des en un une du que est pour dans qui pas sur au ce par il",
    "es": "el los y del las por con una para es se lo como más pero sus al su no o",
}
OTHER = "other"


def language_words(hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes of the common words in order, the language of each, and the languages."""
    names = list(COMMON_WORDS)
    pairs = []
    for at, words in enumerate(COMMON_WORDS.values()):
        block = hasher.read([words.encode()])
        pairs += [(int(h), at) for h in block.hashes()]
    pairs.sort()
    return np.array([h for h, _ in pairs], np.uint64), np.array([a for _, a in pairs]), names


class Reader:
    """Turns a block of lower-cased texts into word rows and a language each."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.common, self.language_of, self.languages = language_words(self.hasher)

    def rows(self, block: WordBlock) -> np.ndarray:
        """(words, 1 + len(BEGINNINGS)) embedding rows; each kind of feature has its own hash."""
        features = [block.hashes()]
        for size in BEGINNINGS:
            features.append(block.hashes(block.starts, np.minimum(block.starts + size, block.ends)))
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        return np.stack([mixed(f + np.uint64(i)) >> shift for i, f in enumerate(features)], axis=1).astype(np.int32)

    def language(self, block: WordBlock) -> list[str]:
        """The language with most common words; OTHER if there is none."""
        hashes = block.hashes()
        place = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        at = np.flatnonzero(self.common[place] == hashes)
        texts = len(block.first) - 1
        doc = np.searchsorted(block.first, at, side="right") - 1
        size = len(self.languages)
        votes = np.bincount(doc * size + self.language_of[place[at]], minlength=texts * size).reshape(texts, size)
        best = votes.argmax(axis=1)
        return [self.languages[b] if votes[i, b] else OTHER for i, b in enumerate(best)]


@dataclass
class ConvNet:
    """Parameters of the network, and each language's threshold as a logit."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, first: np.ndarray, places: bool = False):
        """(texts, filters) maxima over all windows, and if asked for the window of each maximum.

        A text is followed by blank words, so that one shorter than a filter
        still has a window.
        """
        pad = max(WIDTHS) - 1
        texts = len(first) - 1
        sizes = np.diff(first)
        begin = first[:-1] + pad * np.arange(texts)
        x = np.zeros((len(rows) + pad * texts, DIMENSIONS), np.float32)
        at = np.arange(len(rows)) + np.repeat(pad * np.arange(texts), sizes)
        x[at] = self.embedding[rows].sum(axis=1)
        best, where = [], []
        last = np.repeat(begin + np.maximum(sizes, 1), sizes + pad)
        index = np.arange(len(x))
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            z = np.full((len(x), FILTERS), bias, np.float32)
            for j in range(width):
                z[: len(x) - j] += x[j:] @ kernel[j]
            z[index + max(width - 1, 0) >= np.maximum(last, np.repeat(begin + width, sizes + pad))] = -np.inf
            top = np.maximum.reduceat(z, begin, axis=0)
            best.append(top)
            if places:
                where.append(
                    np.stack([b + z[b : b + n + pad].argmax(axis=0) for b, n in zip(begin.tolist(), sizes.tolist())])
                )
        return (np.concatenate(best, axis=1), where, x, at) if places else np.concatenate(best, axis=1)

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, first), 0) @ self.weights + self.bias

    def score(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        """Chances that are CUT exactly at the threshold of the text's language."""
        base = self.thresholds.get(OTHER, 0.0)
        at = np.array([self.thresholds.get(x, base) for x in languages])
        z = np.clip(logits - at, -50, 50) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def start() -> tuple[ConvNet, ConvNet]:
    """An untrained network, and Adagrad's sums of squares in the same shape."""
    rng = np.random.default_rng(SEED)
    filters = FILTERS * len(WIDTHS)
    net = ConvNet(
        rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.5 / w**0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, filters).astype(np.float32),
        0.0,
    )
    squares = deepcopy(net)
    for p in (squares.embedding, *squares.kernels, *squares.biases, squares.weights):
        p[:] = 1e-4
    squares.bias = 1e-4
    return net, squares


def dense(net: ConvNet) -> np.ndarray:
    """All but the embedding in rows of its width, the last one filled up with zeros."""
    flat = np.concatenate([*(k.ravel() for k in net.kernels), *net.biases, net.weights, [net.bias]])
    return np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def set_rows(net: ConvNet, rows: np.ndarray, values: np.ndarray) -> None:
    """Put ``values`` into the rows of the embedding, and of ``dense`` behind it."""
    inside = rows < BUCKETS
    net.embedding[rows[inside]] = values[inside]
    table = dense(net)
    table[rows[~inside] - BUCKETS] = values[~inside]
    flat, at = table.ravel(), 0
    for p in (*net.kernels, *net.biases, net.weights):
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    net.bias = float(flat[at])


def train(net: ConvNet, squares: ConvNet, texts: list[np.ndarray], labels: np.ndarray, share: np.ndarray, seed: list[int]) -> np.ndarray:
    """One pass of Adagrad on the logistic loss, in place; a document of label c weighs ``share[c]``.

    The gradient runs through the windows of the maxima. Returns the embedding
    rows that changed.
    """
    rate, batch = 0.05, 16
    changed = np.zeros(BUCKETS, bool)
    pairs = list(zip((net.embedding, *net.kernels, *net.biases, net.weights), (squares.embedding, *squares.kernels, *squares.biases, squares.weights)))

    def step(k: int, grad: np.ndarray, rows=slice(None)) -> None:
        param, memory = pairs[k]
        memory[rows] += grad**2
        param[rows] -= rate * grad / np.sqrt(memory[rows])

    order = np.random.default_rng(seed).permutation(len(texts))
    for low in range(0, len(order), batch):
        picked = order[low : low + batch]
        rows = np.concatenate([texts[i] for i in picked])
        first = np.cumsum([0] + [len(texts[i]) for i in picked])
        top, where, x, at = net.pooled(rows, first, places=True)
        hidden = np.maximum(top, 0)
        z = hidden @ net.weights + net.bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[picked]) * share[labels[picked]] / len(picked)
        back = (error[:, None] * net.weights[None, :] * (top > 0)).astype(np.float32)
        grad_x = np.zeros_like(x)
        grads = []
        for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(kernel)
            for j in range(width):
                places = np.minimum(where[k] + j, len(x) - 1)
                grad[j] = np.einsum("tfd,tf->df", x[places], g)
                np.add.at(grad_x, places.ravel(), (g[:, :, None] * kernel[j].T[None]).reshape(-1, DIMENSIONS))
            grads.append((grad, g.sum(axis=0)))
        for k, (grad, bias) in enumerate(grads):
            step(1 + k, grad)
            step(1 + len(WIDTHS) + k, bias)
        step(1 + 2 * len(WIDTHS), (hidden.T @ error).astype(np.float32))
        squares.bias += float(error.sum() ** 2)
        net.bias -= float(rate * error.sum() / squares.bias**0.5)
        words = np.flatnonzero(grad_x[at].any(axis=1))
        seen, back_to = np.unique(rows[words], return_inverse=True)
        total = np.zeros((len(seen), DIMENSIONS), np.float32)
        np.add.at(total, back_to.ravel(), np.repeat(grad_x[at[words]], rows.shape[1], axis=0))
        step(0, total, seen)
        changed[seen] = True
    return np.flatnonzero(changed)


def threshold(cells: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit of least error, from the documents of each label in each cell in order; the middle of the best gap."""
    missed = np.concatenate(([0], np.cumsum(toxic)))
    wrong = clean.sum() - np.concatenate(([0], np.cumsum(clean)))
    best = np.flatnonzero(missed + wrong == (missed + wrong).min())
    k = best[len(best) // 2]
    low = np.concatenate(([cells[0] - CELLS], cells + 1))
    high = np.concatenate((cells, [cells[-1] + 1 + CELLS]))
    return float(low[k] + high[k]) / 2 / CELLS


def calibrate(net: ConvNet, counts: list[tuple[str, int, int, int]]) -> None:
    """A threshold for each language with enough documents of both classes; the others take the common one.

    ``counts`` are (language, cell, toxic documents, clean documents).
    """

    def of(rows: list) -> tuple[float, int, int]:
        cells, place = np.unique([r[1] for r in rows], return_inverse=True)
        toxic, clean = (np.bincount(place, [r[k] for r in rows], len(cells)).astype(np.int64) for k in (2, 3))
        return threshold(cells, toxic, clean), int(toxic.sum()), int(clean.sum())

    if not sum(r[2] for r in counts) or not sum(r[3] for r in counts):
        return
    net.thresholds[OTHER] = common = of(counts)[0]
    for language in sorted({r[0] for r in counts} - {OTHER}):
        own, toxic, clean = of([r for r in counts if r[0] == language])
        if toxic >= 20 and clean >= 20:
            weight = toxic / (toxic + 20)  # few documents say little about where the threshold lies
            net.thresholds[language] = weight * own + (1 - weight) * common


def _listed(marks: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of labelled ids; no more rows than it has 64-bit words reach the driver."""
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit(LISTED_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = marks.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(LISTED_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return bits.view(np.uint8)


def _word_rows(listed):
    """(doc_id, language, rows) of (text, key, doc_id) whose ``key``, the hash of the id, is in the bitmap; rows are packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bits = Reader(), listed.value
        for texts, keys, ids in parts(tuple(batch.columns) for batch in batches):
            slot = keys.to_numpy(zero_copy_only=False) & (len(bits) * 8 - 1)
            held = pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)
            packed, languages = [], []
            for _, part in blocks([t.lower().encode("utf-8", "surrogatepass") for t in as_text(texts.filter(held))]):
                block = reader.hasher.read(part)
                rows = reader.rows(block)
                languages += reader.language(block)
                packed += [rows[a:b].astype(ROW).tobytes() for a, b in zip(block.first, block.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids.filter(held), pa.array(languages, pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "language", "rows"]
            )

    return run


PACKED = "held boolean, shard int, part int, labels array<int>, languages array<string>, texts array<binary>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (held, shard, doc_id, label, language, rows) in order, as one row for each shard, or each ``SHARD_BYTES`` of it.

    A row without ``rows`` brings the label of its id; the documents of that id
    follow it. Documents without such a row are left out.
    """
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.binary())]
    names = ["held", "shard", "part", "labels", "languages", "texts"]
    now, part, size, found, marked, mark = None, 0, 0, [], None, None

    def row() -> pa.RecordBatch:
        values = [*now, part, *(list(c) for c in zip(*found))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        held, shard, ids, labels, *rest = (batch.column(c).to_pylist() for c in ("held", "shard", "doc_id", "label", "language", "rows"))
        for key, doc_id, label, (language, rows) in zip(zip(held, shard), ids, labels, zip(*rest)):
            if rows is None:
                marked, mark = doc_id, label
                continue
            if doc_id != marked:
                continue
            if found and (key != now or size >= SHARD_BYTES):
                yield row()
                part, size, found = (part + 1 if key == now else 0), 0, []
            now, size = key, size + len(rows)
            found.append((mark, language, rows))
    if found:
        yield row()


def _shards(docs: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    """All labelled documents as word rows, a row per shard; a written table with a file per row, so that shards spread over tasks.

    Labels and documents meet in the exchange that deals them into shards, so
    a text goes through none but that. The bitmap keeps most documents
    without a label out of it; on far larger input it fills and lets more
    pass, and the rows themselves decide.
    """
    kind = docs.select("doc_id").union(marks.select("doc_id")).schema["doc_id"].dataType
    docs, marks = (d.withColumn("doc_id", F.col("doc_id").cast(kind)) for d in (docs.where("doc_id is not null"), marks))
    listed = docs.sparkSession.sparkContext.broadcast(_listed(marks))
    keyed = docs.select("text", F.xxhash64("doc_id").alias("key"), "doc_id")
    rows = keyed.mapInArrow(_word_rows(listed), f"doc_id {kind.simpleString()}, language string, rows binary")
    rows = rows.unionByName(marks.select("doc_id", F.col("label").cast("int")), allowMissingColumns=True).select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0).alias("held"),
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit(2), "doc_id").alias("place"),
        "doc_id", "label", "language", "rows",
    )
    # nulls come first, so the label stands before the documents of its id
    dealt = rows.repartition(2 * shards, "held", "shard").sortWithinPartitions("held", "shard", "place", "doc_id", "rows")
    return stage(dealt.mapInArrow(_pack, PACKED), "toxicity-shards", maxRecordsPerFile=1)


def _texts(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, ROW).astype(np.int32).reshape(-1, 1 + len(BEGINNINGS)) for t in packed]


def _sums() -> list[str]:
    return [f"{kind}{i}" for kind in ("value", "square") for i in range(DIMENSIONS)]


def _passed(net: ConvNet, squares: ConvNet, share: np.ndarray, epoch: int):
    """The rows of the network that a pass over each shard changes, and their sums of squares, as fixed-point numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                shard, part, labels, packed = (batch.column(c)[at].as_py() for c in ("shard", "part", "labels", "texts"))
                mine, memory = deepcopy(net), deepcopy(squares)
                rows = train(mine, memory, _texts(packed), np.array(labels), share, [SEED, epoch, shard, part])
                values = [np.concatenate((n.embedding[rows], dense(n))) for n in (mine, memory)]
                fixed = np.rint(np.concatenate(values, axis=1).astype(np.float64) * FIXED).astype(np.int64)
                names = np.concatenate((rows, BUCKETS + np.arange(len(fixed) - len(rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), *(pa.array(np.ascontiguousarray(c)) for c in fixed.T)], names=["row", *_sums()]
                )

    return run


def _cells(net: ConvNet):
    """(language, label, cell) of every document of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                labels, languages, packed = (batch.column(c)[at].as_py() for c in ("labels", "languages", "texts"))
                logits = np.array([net.logits(t, np.array([0, len(t)]))[0] for t in _texts(packed)])
                cells = np.floor(np.clip(logits, -100, 100) * CELLS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(languages, pa.string()), pa.array(labels, pa.int32()), pa.array(cells)], names=["language", "label", "cell"]
                )

    return run


def learn(docs: DataFrame, marks: DataFrame) -> ConvNet:
    """Fit on all documents of ``marks`` (doc_id, label): four fifths train the network, the rest set the thresholds.

    The documents are dealt into shards by a hash of their id. In each epoch
    every shard trains a copy of the network on all its documents, and a
    parameter becomes its mean over the shards that changed it. The driver
    gets the parameters, and counts of the held documents by language, label
    and cell of their logit; how many there are does not grow with the table.
    The same table always gives the same network.
    """
    packed = _shards(docs, marks, max(1, -(-marks.count() // SHARD)))
    trainers = packed.where("not held")
    toxic = F.expr("aggregate(labels, 0L, (n, label) -> n + label)")
    found = trainers.agg(F.sum(F.size("labels").cast("bigint")).alias("n"), F.sum(toxic).alias("toxic")).first()
    net, squares = start()
    n, toxic = found["n"] or 0, found["toxic"] or 0
    if not 0 < toxic < n:
        net.weights[:] = 0
        net.bias = 50.0 if toxic else -50.0
        return net
    share = np.array([0.5 * n / (n - toxic), 0.5 * n / toxic])
    schema = "row int, " + ", ".join(f"{c} bigint" for c in _sums())
    for epoch in range(EPOCHS):
        changes = trainers.select("shard", "part", "labels", "texts").mapInArrow(_passed(net, squares, share, epoch), schema)
        means = changes.groupBy("row").agg(F.count("*").alias("shards"), *(F.sum(c).alias(c) for c in _sums())).toArrow()
        rows, counts = (means.column(c).to_numpy() for c in ("row", "shards"))
        values = np.stack([means.column(c).to_numpy() for c in _sums()], axis=1) / FIXED / counts[:, None]
        set_rows(net, rows, values[:, :DIMENSIONS])
        set_rows(squares, rows, values[:, DIMENSIONS:])
    held = packed.where("held").select("labels", "languages", "texts")
    cells = held.mapInArrow(_cells(net), "language string, label int, cell int").groupBy("language", "cell")
    counts = cells.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    calibrate(net, [tuple(r) for r in counts.collect()])
    return net


def score(text: Column, net: ConvNet) -> Column:
    """struct<score, language> of whole texts."""
    kind = pa.struct([("score", pa.float64()), ("language", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for texts in parts(batches):
            scores, languages = [], []
            for _, part in blocks([t.lower().encode("utf-8", "surrogatepass") for t in as_text(texts)], 1 << 18):
                block = reader.hasher.read(part)
                named = reader.language(block)
                scores += net.score(net.logits(reader.rows(block), block.first), named).tolist()
                languages += named
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(languages, pa.string())], fields=list(kind)
            )

    return F.arrow_udf(run, "struct<score:double,language:string>")(text)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
) -> DataFrame:
    """(doc_id, score, language), a row per row of ``docs``; at CUT and above a text counts as toxic.

    The network learns from all labelled documents for which ``learn_from``, a
    condition on ``doc_id``, holds. The language is read
    off the text's common words and chooses the threshold. A document with
    several labels counts with the largest; null ids and labels other than 0
    and 1 teach nothing. Null and empty texts are scored like others. If a
    class has no row, all scores are near 0, or near 1 if only label 1 occurs.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(learn_from)
    marks = marks.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    net = learn(rows, marks)
    return rows.select("doc_id", score(F.col("text"), net).alias("found")).select("doc_id", "found.*")
