"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of ASCII letters and digits and of non-ASCII characters, lower-cased. It has five hashed embeddings: two of the
whole word, so that two words are confused only if they meet in both tables, and one each of its first four, six and eight bytes, so
that an inflected word is like its stem. Filters of several widths slide over a document's words; each filter's
maximum over the whole document, after a rectifier, goes into a logistic layer. Embeddings start from the smoothed log-odds of
their bucket plus noise; a bucket that no training document has stays zero and is neutral. Thresholds are calibrated by language
on all labelled rows that the fit didn't see; the score itself never sees the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argil.llm._labels import held_out, labelled, sample
from argil.llm._text import cut, hash_spans, raw, read, slices

#: Most training rows of each class, and most words that they have together: a proven bound of what reaches the driver, 10 bytes a
#: word. Whole texts are learnt from; one that would go beyond the bound is left out of the sample.
SAMPLE, SAMPLE_WORDS = 4000, 8_000_000
BUCKETS, TABLES, DIM, WIDTHS, FILTERS = 1 << 16, 5, 4, (1, 2, 3), 8
STEMS = (4, 6, 8)
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.01, 1e-4, 7
THRESHOLD = 0.5
#: Between these a language's own threshold may lie; few calibration rows would else put it anywhere between two scores. The threshold
#: of all rows weighs in it like so many rows.
BOUNDS, PRIOR = (0.2, 0.8), 50
#: Calibration counts rows in bins of the score's log-odds, so many a unit and up to this far from zero, for so many languages.
BINS, FAR, LANGS = 64, 16, 200
_CHUNK = 1 << 18

_FOLD = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_TOKEN = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets ``(n, TABLES)`` of all words of a slice, and the first word of each row."""
    data = _FOLD[data]
    n = len(data) - 8
    inside = _TOKEN[data[:n]]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge], stop[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    h = hash_spans(data, starts, ends)
    stems = [hash_spans(data, starts, np.minimum(ends, starts + n), n) for n in STEMS]
    hashed = np.stack([x & np.uint64(BUCKETS - 1) for x in (h, h >> np.uint64(32), *stems)], axis=1).astype(np.uint16)
    return hashed, np.searchsorted(starts, offsets)


@dataclass
class Model:
    """Parameters; ``filters[w]`` has shape (w, TABLES * DIM, FILTERS)."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def embed(self, hashed: np.ndarray) -> np.ndarray:
        return np.concatenate([self.embedding[k][hashed[:, k]] for k in range(TABLES)], axis=1)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at each place, (n, widths * FILTERS); a filter may run over the end into zeros."""
        outs = []
        for w in WIDTHS:
            y = x @ self.filters[w][0]
            for j in range(1, w):
                y[: len(x) - j] += x[j:] @ self.filters[w][j]
            outs.append(y)
        return np.concatenate(outs, axis=1)

    def pool(self, hashed: np.ndarray) -> np.ndarray:
        """Maximum of each filter over one document, piece by piece so that a long text needs no more memory."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        for at in range(0, len(hashed), _CHUNK):
            y = self.convolve(self.embed(hashed[at : at + _CHUNK + max(WIDTHS) - 1]))
            np.maximum(best, y[:_CHUNK].max(axis=0), out=best)
        return best

    def scores(self, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each document of a slice. A document without a word scores by the bias alone."""
        pooled = np.full((len(first) - 1, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        row = 0
        while row < len(pooled):
            to = max(row + 1, int(np.searchsorted(first, first[row] + _CHUNK, side="right")) - 1)
            if to == row + 1:
                pooled[row] = self.pool(hashed[first[row] : first[to]])
            else:
                # one row of zeros after each document, so that no filter sees two of them
                n = np.diff(first[row : to + 1])
                spaced = np.zeros((int(n.sum() + len(n) * 2), TABLES * DIM), dtype=np.float32)
                begin = np.concatenate(([0], np.cumsum(n + 2)[:-1]))
                spaced[np.arange(int(n.sum())) + 2 * np.repeat(np.arange(len(n)), n)] = self.embed(hashed[first[row] : first[to]])
                y = self.convolve(spaced)
                y[begin + n] = y[begin + n + 1] = -np.inf
                pooled[row:to] = np.maximum.reduceat(y, begin, axis=0)
            row = to
        return 1 / (1 + np.exp(-(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)))


def _initial(docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    embedding = np.zeros((TABLES, BUCKETS, DIM), dtype=np.float32)
    for k in range(TABLES):
        n = np.zeros((2, BUCKETS))
        for hashed, label in zip(docs, y):
            n[int(label)][np.unique(hashed[:, k])] += 1
        total = n.sum(axis=0)
        odds = np.log((n[1] + 0.5) / (y.sum() + 1)) - np.log((n[0] + 0.5) / (len(y) - y.sum() + 1))
        seen = total > 0
        embedding[k][seen] = rng.normal(0, 0.05, (int(seen.sum()), DIM))
        embedding[k][seen, 0] = (odds * total / (total + 10))[seen]
    filters = {w: rng.normal(0, 0.1, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, ::DIM, : FILTERS // 2] += 0.5 / w
    size = len(WIDTHS) * FILTERS
    return Model(embedding, filters, np.zeros(size, dtype=np.float32), rng.normal(0, 0.1, size).astype(np.float32), 0.0)


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam on the logistic loss. ``docs`` are buckets. Only the place at which a filter is largest gets a gradient."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.float32)
    m = _initial(docs, y, rng)
    dense = [*m.filters.values(), m.bias, m.out]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    sparse = np.zeros_like(m.embedding)  # sum of squared gradients, as Adagrad has it
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            step += 1
            grads = [np.zeros_like(p) for p in dense]
            bias_grad, places, pieces = 0.0, [], []
            for i in batch:
                hashed = docs[i]
                x = m.embed(hashed) if len(hashed) else np.zeros((1, TABLES * DIM), dtype=np.float32)
                out = m.convolve(x)
                best = out.argmax(axis=0)
                z = out[best, np.arange(out.shape[1])] + m.bias
                a = np.maximum(z, 0)
                d = float(1 / (1 + np.exp(-(a @ m.out + m.out_bias))) - y[i]) / len(batch)
                bias_grad += d
                grads[-1] += d * a
                dz = d * m.out * (z > 0)
                grads[-2] += dz
                for k, w in enumerate(WIDTHS):
                    for j in range(w):
                        at = best[k * FILTERS : (k + 1) * FILTERS] + j
                        ok = at < len(x)
                        g = dz[k * FILTERS : (k + 1) * FILTERS] * ok
                        at = np.minimum(at, len(x) - 1)
                        grads[k][j] += x[at].T * g
                        if len(hashed):
                            places.append(hashed[at])
                            pieces.append(m.filters[w][j].T * g[:, None])
            for p, g, (first, second) in zip(dense, grads, memory):
                g = g + DECAY * p
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            m.out_bias -= RATE * bias_grad * 10
            if places:
                at, piece = np.concatenate(places), np.concatenate(pieces)
                for k in range(TABLES):
                    g = piece[:, k * DIM : (k + 1) * DIM]
                    rows, inverse = np.unique(at[:, k], return_inverse=True)
                    total = np.zeros((len(rows), DIM), dtype=np.float32)
                    np.add.at(total, inverse, g)
                    sparse[k][rows] += total * total
                    m.embedding[k][rows] -= 5 * RATE * total / (np.sqrt(sparse[k][rows]) + 1e-6)
    return m


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of best F1, half-way between two scores; the highest of equally good ones."""
    order = np.argsort(-scores, kind="stable")
    s, t, w = scores[order], y[order], weight[order]
    hits, n = np.cumsum(t * w), np.cumsum(w)
    f1 = 2 * hits / (n + hits[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # a threshold can't part equal scores
    best = int(f1.argmax())
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0.0)) / 2)


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str | None], count: np.ndarray) -> dict[str | None, float]:
    """Threshold of each language with both classes; "" is that of all rows, for any other language and for none.

    A row is all documents of one score, class and language; ``count`` is ``(n, 2)``: how many were seen, and for how many they stand.
    A language's threshold is the one of its best F1 and that of all rows, averaged as log-odds by ``n`` rows seen and ``PRIOR``: the
    fewer the rows, the nearer to that of all.
    """
    if not 0 < y.sum() < len(y):
        return {}
    logit = lambda p: np.log(p) - np.log1p(-p)
    common = best_threshold(scores, y, count[:, 1])
    found: dict[str | None, float] = {"": common}
    names = np.array([x if x is not None else "" for x in langs], dtype=object)
    for name in sorted(set(names) - {""}):
        own = names == name
        if 0 < y[own].sum() < own.sum():
            n = count[own, 0].sum()
            each = np.clip([best_threshold(scores[own], y[own], count[own, 1]), common], 1e-6, 1 - 1e-6)
            found[name] = float(1 / (1 + np.exp(-(n * logit(each[0]) + PRIOR * logit(each[1])) / (n + PRIOR))))
    return found


def unseen(docs: DataFrame, labels: DataFrame, label: str, model: Model, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """Scores, classes, languages and numbers of all labelled rows of ``docs(doc_id, lang, text)`` but the ``trained``: a row for each
    bin, class and language, so that their number is bounded. Documents are scored where they are read; texts never move."""
    shared = docs.sparkSession.sparkContext.broadcast((model, np.sort(trained)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trained = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pa.array(~np.isin(part.column(0).to_numpy(), trained)))
                if not part.num_rows:
                    continue
                hashed, first = tokens(*raw(part.column(2)))
                # one by one, so that a score doesn't hang on its neighbours
                scores = np.array([model.scores(hashed[a:b], np.array([0, b - a]))[0] for a, b in zip(first[:-1], first[1:])], dtype=np.float64)
                odds = np.log(np.clip(scores, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(scores, 1e-12, 1 - 1e-12))
                bins = np.floor(np.clip(odds, -FAR, FAR) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bins)], names=["doc_id", "lang", "bin"])

    scored = docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, lang string, bin int")
    one = scored.join(labelled(labels, label), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "bin")).alias("x"), F.min("label").alias("label"))
    rows = cut(one.groupBy("x.lang", "x.bin", "label").count())
    often = [r.lang for r in rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()]
    found = rows.groupBy(F.when(F.col("lang").isin(often), F.col("lang")).alias("lang"), "bin", "label").agg(F.sum("count").alias("n")).orderBy("lang", "bin", "label").toArrow()
    scores = 1 / (1 + np.exp(-(found.column("bin").to_numpy() + 0.5) / BINS))
    return scores, found.column("label").to_numpy(), found.column("lang").to_pylist(), found.column("n").to_numpy()


def _views(words: pa.ChunkedArray) -> list[np.ndarray]:
    """The buckets of each row of a binary column, where they lie: nothing is copied, as the sample is the most that the driver holds."""
    found = []
    for chunk in words.chunks:
        chunk = chunk.cast(pa.large_binary())
        _, ends, data = chunk.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        data = np.frombuffer(data or b"", dtype=np.uint8)
        found += [data[a:b].view(np.uint16).reshape(-1, TABLES) for a, b in zip(ends[:-1], ends[1:])]
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, words: int = SAMPLE_WORDS, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> tuple[Model, dict]:
    """Train on four fifths of a bounded sample of labelled rows, and calibrate thresholds by language on all the others.

    The sample takes another share of each class than the table has. What is left of a class therefore stands for all of it.
    Rows without an id, a label of 0 or 1, or a document are passed over, and so are ids with contradicting labels and held-out ids.
    Of rows that share an id one is learnt from, that with the smallest words as they are hashed. Without labels, or of one class
    only, all documents score alike, and no language has a threshold of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, first = tokens(*raw(part.column(part.schema.get_field_index("text"))))
                own = [hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], names=["doc_id", "label", "words"])

    lang = F.col(lang_column) if lang_column else F.lit(None)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col(text_column).alias("text"))
    labels = labels.withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = rows.join(F.broadcast(sample(labels, label, most)), "doc_id").select("doc_id", "label", "text")
    hashed = cut(chosen.mapInArrow(run, "doc_id long, label int, words binary").groupBy("doc_id", "label").agg(F.min("words").alias("words")))
    sizes = hashed.select("doc_id", "label", F.octet_length("words").cast("long").alias("size"), F.xxhash64("doc_id").alias("h")).toArrow().sort_by([("label", "ascending"), ("h", "ascending")])
    fits, room = [], {0: words, 1: words}
    for i, y, size in zip(*(sizes.column(c).to_pylist() for c in ("doc_id", "label", "size"))):
        if size // (2 * TABLES) <= room[y]:
            fits.append(i)
            room[y] -= size // (2 * TABLES)
    within = hashed if len(fits) == len(sizes) else hashed.filter(F.col("doc_id").isin(fits))
    found = within.toArrow()
    order = np.argsort(found.column("doc_id").to_numpy())
    texts = _views(found.column("words"))
    texts = [texts[i] for i in order.tolist()]
    ids, y = (found.column(c).to_numpy()[order] for c in ("doc_id", "label"))
    del found
    if not 0 < y.sum() < len(y):
        rng = np.random.default_rng(SEED)
        m = _initial(texts, y.astype(np.float32), rng)
        m.out[:] = 0
        m.out_bias = 6.0 if len(y) and y.all() else -6.0
        return m, {}
    seen = np.arange(len(y)) % 5 != 4
    model = train([t for t, a in zip(texts, seen) if a], y[seen])
    del texts
    pa.default_memory_pool().release_unused()
    scores, classes, langs, n = unseen(rows, labels, label, model, ids[seen])
    left = np.bincount(classes, n, 2)
    count = np.stack([n, n * ((left + np.bincount(y[seen], minlength=2)) / np.maximum(left, 1))[classes]], axis=1)
    level = calibrate(scores, classes, langs, count).get("", THRESHOLD)
    # the best threshold over all languages becomes THRESHOLD
    shift = np.log(level / (1 - level)) if 0 < level < 1 else 0.0
    model.out_bias -= shift
    moved = 1 / (1 + (1 / scores - 1) * np.exp(shift))
    return model, {k: float(np.clip(v, *BOUNDS)) for k, v in calibrate(moved, classes, langs, count).items()}


def score(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; a null or empty text scores too. A column of that name is replaced, unless it is the
    text's own, which is an error. Other columns, nulls in them and repeated rows pass through; no rows, no rows."""
    if text_column == score_column:
        raise ValueError("the score needs a column of its own")
    parameters = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    rest = [c for c in docs.columns if c != score_column]
    place = rest.index(text_column)
    schema = docs.select(*rest).schema.add(score_column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                hashed, first = tokens(*raw(part.column(place)))
                scores = parameters.value.scores(hashed, first).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=schema.names)

    return docs.select(*rest).mapInArrow(run, schema)


def threshold(by_lang: dict, lang_column: str = "lang") -> Column:
    """The calibrated threshold of a row's language."""
    value = F.lit(float(by_lang.get("", THRESHOLD)))
    for name, x in by_lang.items():
        if name:
            value = F.when(F.col(lang_column) == name, F.lit(x)).otherwise(value)
    return value


def keep(docs: DataFrame, model: Model, by_lang: dict, lang_column: str = "lang") -> DataFrame:
    """The documents that score below the threshold of their language, or of all where it is null or has none. Columns stay as they
    are, whatever their names; repeated rows stay or go together."""
    own = "__score" + "_" * max(map(len, docs.columns))
    return score(docs, model, score_column=own).filter(F.col(own) < threshold(by_lang, lang_column)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: toxicity score of every document, and the verdict by the threshold of its language; one without an id isn't held
    out."""
    docs = read(spark, sf_dir, "documents")
    model, by_lang = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "lang", "text"), model)
    flagged = (F.col("score") >= threshold(by_lang)).alias("flagged")
    return scored.select("doc_id", held_out("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), flagged)
