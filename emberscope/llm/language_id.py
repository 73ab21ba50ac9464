"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Training uses follow-the-regularised-leader with elastic-net penalties on a bounded sample,
``SAMPLE`` distinct labelled texts for each language (those with the smallest hashes), which also give the
document frequencies of TF-IDF; every tenth of them is left out of the updates and fits the temperature that calibrates the probabilities.  Prediction
runs over every whole text in Arrow batches with the model broadcast (languages * 2**BITS
weights).  Language, source and id of a row are never inputs of its prediction.

A text that is null or has no letter is ``und`` with score 0.  Rows with null language are not
learned from; with no labelled row at all everything is ``und``.  Repeated rows each get their
prediction.  Equal probabilities go to the language first in code-point order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import small_batches, tidy


SAMPLE, BITS, GRAMS, EPOCHS = 1000, 15, (1, 2, 3), 4
#: FTRL-proximal: learning rate and its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
#: ``accepted`` rejects documents whose best language isn't likelier than all others together, and those
#: that are this surely of another language than the one they claim.
LEAST, SURE = 0.5, 0.9


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the letters, words set apart by one space: places and 1 + log counts; None without a letter."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower())
    if not any(map(str.isalpha, words)):
        return None
    codes = np.frombuffer(f" {words.strip()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashes = []
    for n in GRAMS:
        h = np.full(max(len(codes) - n + 1, 0), n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        hashes.append(h >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(hashes), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (1 + np.log(counts[at])).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, f: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, tf = f
        x = tf * self.idf[at]
        return self.weights[:, at] @ (x / np.sqrt((x * x).sum() or 1.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text)
        if f is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(f) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """A model from (text, language) rows, in their order."""
    languages = sorted({lang for _, lang in rows})
    known = {lang: i for i, lang in enumerate(languages)}
    data = [(f, known[lang]) for text, lang in rows if (f := features(text)) is not None]
    held, used = data[::10], [d for i, d in enumerate(data) if i % 10] or data
    df = np.zeros(1 << BITS)
    for (at, _), _ in used:
        df[at] += 1
    model = Model(languages, np.log((1 + len(used)) / (1 + df)) + 1, np.zeros((len(languages), 1 << BITS)))
    z, n, w = np.zeros_like(model.weights), np.zeros_like(model.weights), model.weights
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            (at, tf), y = used[i]
            x = tf * model.idf[at]
            x /= np.sqrt((x * x).sum())
            z_at, n_at = z[:, at], n[:, at]
            w_at = np.where(np.abs(z_at) <= L1, 0.0, -(z_at - np.sign(z_at) * L1) / ((BETA + np.sqrt(n_at)) / ALPHA + L2))
            p = softmax(w_at @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            more = n_at + g * g
            z[:, at] = z_at + g - (np.sqrt(more) - np.sqrt(n_at)) / ALPHA * w_at
            n[:, at] = more
    w[:] = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    model.temperature = calibrated([(model.logits(f), y) for f, y in held])
    return model


def calibrated(logits: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss, by golden section on its logarithm.

    Labels count as wrong once in len(logits) + 2, so rows that are all told apart don't make every score 1.
    """
    wrong = 1 / (len(logits) + 2)

    def loss(log_t: float) -> float:
        total = 0.0
        for v, y in logits:
            p = np.log(softmax(v / np.exp(log_t)) + 1e-300)
            total -= (1 - wrong) * p[y] + wrong * p.mean()
        return total

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40 if logits else 0):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2)) if logits else 1.0


def sample(docs: DataFrame, label: str = "lang", text: str = "text", size: int = SAMPLE) -> DataFrame:
    """(h, lang, text) of a few more than ``size`` distinct texts for each language, the same ones on each run.

    Languages' counts of distinct texts set the part of the hash range from which they come; copies of
    one are a single row, and are put together before they are shuffled.
    """
    rows = docs.select(docs[text].alias("text"), docs[label].alias("lang")).filter("text is not null and lang is not null")
    rows = rows.withColumn("_hash", F.xxhash64("text", "lang")).withColumn("h", F.abs(F.col("_hash") % (1 << 30)) / float(1 << 30))
    # One row for each language, of which the model holds 2**BITS weights anyway.
    counts = [(r.lang, (1.2 * size + 30) / r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("_hash", 0.02).alias("n")).collect()]
    part = F.broadcast(docs.sparkSession.createDataFrame(counts, "_lang string, part double"))
    return rows.join(part, F.col("lang") == F.col("_lang")).filter("h <= part").select("h", "lang", "text").distinct()


def trained(docs: DataFrame, label: str = "lang", text: str = "text", size: int = SAMPLE) -> Model:
    """A model of ``docs``; one task holds the bounded sample, the driver only gets the weights."""

    def run(batches):
        import pyarrow as pa

        rows, taken = [], {}
        for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["lang"], r["text"])):
            if taken.setdefault(r["lang"], 0) < size:
                taken[r["lang"]] += 1
                rows.append((r["text"], r["lang"]))
        m = fit(rows)
        yield pa.RecordBatch.from_pydict({"languages": [m.languages], "idf": [m.idf.tobytes()], "weights": [m.weights.tobytes()], "temperature": [m.temperature]})

    one = sample(docs, label, text, size).repartition(1).mapInArrow(tidy(run), "languages array<string>, idf binary, weights binary, temperature double").first()
    if one is None:  # Spark drops the task where it knows that there are no rows
        return fit([])
    weights = np.frombuffer(bytes(one.weights)).reshape(len(one.languages), 1 << BITS)
    return Model(list(one.languages), np.frombuffer(bytes(one.idf)), weights, one.temperature)


def predictor(parts):
    """Over Arrow batches whose last column is text: in its place, language and score.

    ``parts`` is a broadcast of a model's fields: a broadcast of a ``Model`` would need this package on the workers.
    """

    def run(batches):
        import pyarrow as pa

        model = Model(*parts.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            own = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("_text"))
    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    parts = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature))
    out = rows.mapInArrow(tidy(predictor(parts)), f"{kinds}lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from; a null id counts as one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those not held out."""
    few = docs.select("doc_id", "text", "lang")
    model = trained(few.filter(~held_out(few["doc_id"])))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def accepted(docs: DataFrame, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose language is known with probability ``least`` or more, by a model of the rows not held out.

    A row that claims a language goes too if the model is ``sure`` of another one; a null claim is no claim.
    """
    few = docs.select("doc_id", "text", "lang")
    model = trained(few.filter(~held_out(few["doc_id"])))
    names = docs.columns
    rows = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(names)], docs["lang"].alias("_claim"), docs["text"].alias("text"))
    out = predict(rows, model, keep=(*[f"_c{i}" for i in range(len(names))], "_claim"))
    other = F.coalesce(F.col("_claim") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= sure)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & ~other).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
