"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 4 characters of the lower-cased text, hashed to a fixed number of slots. Document
frequencies, and with them the inverse document frequencies, are counted over all training documents. The
weights are trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a bounded
sample of the training documents, and the probabilities are calibrated with one temperature, chosen by the
negative log-likelihood of a second bounded sample.

Term frequencies are shares of a text's n-grams, so a text's logits are means over its n-grams and no text
needs a table of its own: one pass over the whole text adds up a few numbers for each character.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, row_id, slices, values

ORDERS, SLOTS = (1, 2, 3, 4), 1 << 16
#: Bounds of the samples that the weights and the temperature are fitted on.
TRAIN_DOCS, CALIBRATION_DOCS = 1600, 400
#: Of the features, so that the penalties and rates suit shares of a text.
SCALE = 10.0
UNDETERMINED = "und"
_MULT = np.uint32(0x9E3779B1)


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the slots of its n-grams, text after text, and where each text's begin (one more at the end).
    Runs of characters that are no letters, and the end after a letter, count as one space; those at the beginning
    don't count."""
    if not texts:
        return []
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter, folded = _tables()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.array([len(t) for t in texts]) + 1, out=starts[1:])
    letters = is_letter[code]
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of a run of others stands for all
    kept = np.zeros(len(code) + 1, np.int32)
    np.cumsum(keep, out=kept[1:], dtype=np.int32)
    starts = kept[starts].astype(np.int64)
    h = folded[code[keep]]
    out, step = [], h * _MULT
    h = np.zeros(len(step), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: max(0, len(step) - n + 1)] * np.uint32(0x01000193)) ^ step[n - 1 :]
        if n in ORDERS:
            x = h * _MULT
            slot = ((x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
            if n > 1:  # those that reach into the next text go
                inside = np.ones(len(slot), bool)
                for back in range(1, n):
                    at = starts[1:] - back
                    inside[at[(at >= starts[:-1]) & (at < len(slot))]] = False
                slot = slot[inside]
            sizes = np.maximum(0, np.diff(starts) - n + 1)
            out.append((slot, np.concatenate([[0], np.cumsum(sizes)])))
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of a text's n-grams, and how often each occurs."""
    n = np.zeros(SLOTS, np.int64)
    for slot, _ in grams([text]):
        n += np.bincount(slot, minlength=SLOTS)
    used = np.flatnonzero(n)
    return used, n[used]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one character; 32 for others."""
    n = 0x110000
    low = (32 if not c.isalpha() else ord(x) if len(x := c.lower()) == 1 else ord(c) for c in map(chr, range(n)))
    return np.fromiter(map(str.isalpha, map(chr, range(n))), bool, n), np.fromiter(low, np.uint32, n)


def has_letter(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # slots x languages, the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        sums, n, columns = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.ascontiguousarray(self.weights.T)
        for slot, starts in grams(texts):
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                for k, column in enumerate(columns):
                    sums[some, k] += np.add.reduceat(column[slot], starts[some])
            n += np.diff(starts)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.empty(0)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        best, known = p.argmax(axis=1), has_letter(texts)
        return [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(slots: list[np.ndarray], tf: list[np.ndarray], y: np.ndarray, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x k) and bias of multinomial logistic regression, by FTRL-Proximal with an elastic net."""
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for d in rng.permutation(len(y)):
            i, x = slots[d], tf[d]
            w = weights(i)
            p = softmax((x @ w)[None])[0]
            p[y[d]] -= 1
            g = x[:, None] * p
            ni = n[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * w
            n[i] = ni + g * g
    w = weights(np.arange(SLOTS + 1))
    return w[:SLOTS], w[SLOTS]


def occurring(texts: list[str]) -> np.ndarray:
    """In how many of the texts each slot occurs."""
    seen = np.zeros((len(texts), SLOTS), bool)
    for slot, starts in grams(texts):
        seen.ravel()[np.repeat(np.arange(len(texts), dtype=np.int64) * SLOTS, np.diff(starts)) + slot] = True
    return np.add.reduce(seen, axis=0, dtype=np.uint8).astype(np.int64)


def frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all training texts (column t) each slot occurs, and the number of texts."""

    def run(batches):
        total, n = np.zeros(SLOTS, np.int64), 0
        for part in slices(batches, "t", 1 << 20):
            texts = [x.decode() for x in as_bytes(part, "t")]
            for at in range(0, len(texts), 64):
                total += occurring(texts[at : at + 64])
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, SLOTS, 1024)), pa.array([*total.reshape(-1, 1024).tolist()], pa.list_(pa.int64())), pa.array([n] * (SLOTS // 1024), pa.int64())], names=["b", "df", "n"])

    parts = train.select("t").mapInArrow(run, "b long, df array<long>, n long")
    sums = F.array(*[F.sum(F.col("df")[k]) for k in range(1024)])
    rows = parts.groupBy("b").agg(sums.alias("df"), F.sum("n").alias("n")).collect()  # SLOTS numbers
    df = np.zeros(SLOTS, np.int64)
    for r in rows:
        df[r.b : r.b + 1024] = r.df
    return df, rows[0].n if rows else 0


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from the rows whose text and label are not null. docs: training rows only.

    The samples are those rows with the least hashes of the text and id for each label, so they do not depend
    on how rows are dealt out.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y"), row_id(id_col).alias("i"))
    langs = sorted(r.y for r in rows.select("y").distinct().collect())  # languages
    if not langs:
        return Model([], np.zeros((SLOTS, 0)), np.zeros(0), 1.0)
    df, n = frequencies(rows)
    idf = np.log((n + 1) / (df + 1)) + 1
    each = max(1, (TRAIN_DOCS + CALIBRATION_DOCS) // len(langs))
    least = F.struct(F.xxhash64("i", F.lit("sample")).alias("h"), F.col("i"))
    # the threshold of hashes that keeps about twice the sample, then exactly the least ones of each label
    per = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, 2 * each / k + 50 / k))) for y, k in per.items()])
    near = rows.where((F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)) < share)
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(least))).where(F.col("r") <= each).select("y", "r", "t")

    def count(batches):
        for part in slices(batches, "t", 1 << 20):
            found = [counts(x.decode()) for x in as_bytes(part, "t")]
            yield pa.RecordBatch.from_arrays([values(part, "y"), values(part, "r"), pa.array([u.astype("<i4").tobytes() for u, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["y", "r", "u", "c"])

    taken = sorted(sample.mapInArrow(count, "y string, r int, u binary, c binary").collect(), key=lambda r: (r.y, r.r))  # the bounded sample
    slots, tf = [], []
    for r in taken:
        u, c = np.frombuffer(r.u, "<i4"), np.frombuffer(r.c, "<i4")
        slots.append(np.append(u, SLOTS))
        tf.append(np.append(c / max(1, c.sum()) * idf[u] * SCALE, 1.0))
    y = np.array([langs.index(r.y) for r in taken])
    held = np.arange(len(y)) % ((TRAIN_DOCS + CALIBRATION_DOCS) // CALIBRATION_DOCS) == 1
    use, check = np.flatnonzero(~held), np.flatnonzero(held)
    w, b = ftrl([slots[i] for i in use], [tf[i] for i in use], y[use], len(langs))
    model = Model(langs, w * idf[:, None] * SCALE, b, 1.0)
    if len(check):
        z = np.stack([tf[i][:-1] @ w[slots[i][:-1]] for i in check]) + b
        model.temperature = float(min((-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean(), t) for t in np.geomspace(0.05, 20, 60))[1])
    return model


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """given, a struct of all columns of a row, with lang_pred and score of its whole text. Columns of docs may have
    any names; see predict for the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers

    def run(batches):
        m = shared.value
        for part in slices(batches, "text", 1 << 20):
            lang, score = m.predict([x.decode() for x in as_bytes(part, "text")])
            yield pa.RecordBatch.from_arrays([values(part, "given"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["given", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["given"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score of every whole text, beside the id and the columns in keep.

    lang_pred is und, with score 0, for null texts and those without a letter, or if nothing was learned. Null
    ids stay null; repeated rows come out repeated; an empty table gives an empty table. Kept columns named lang_pred
    or score come out beside the prediction's; judged() holds them apart.
    """
    names = [id_col, *(keep or [])]
    needed = docs.select(*dict.fromkeys([*(f"`{c}`" for c in names), f"`{text_col}`"]))
    return judged(needed, model, text_col).select(*[F.col(f"given.`{c}`") for c in names], "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Documents that are kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text"), model, keep=["held_out"])
