"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits (up to five languages: all splits in two; more: the best of several seeded random
codes). One logistic classifier over hashed character n-grams (1 to 3, of the lower-cased letters with every other run as
one gap, square roots of their shares) predicts each bit. Decoding weighs each bit's logistic loss by how well that bit was
learned for the language, takes the language with the least loss, and flags the text where the next one is near.

The classifiers are fitted on a bounded sample: SAMPLE_ROWS texts in all, the same number for each language but two at least,
those with the smallest hash of doc_id. Any number of languages is learned. Everything else runs over all rows and whole texts; a row's prediction depends on its text alone.

Defined cases: a null text or one without a letter is `und` with score 0; rows with a null lang, a null text or a null
doc_id are not learned from; a null doc_id is not held out; repeated rows get equal predictions; other columns are ignored;
with no language to learn from every prediction is `und`; with one language it is that one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.llm import textkit
from ripplegraph.runtime import ship

SLOTS = 4096
SAMPLE_ROWS = 2000
AMBIGUOUS, LEAST_SCORE = 0.7, 0.3
OUT = "lang_pred string, score double, ambiguous boolean"


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed character n-grams, a row for each text; a text without letters is all zeros."""
    codes, bounds = textkit.code_points([t.lower() for t in texts])
    letter = textkit._kinds()[codes] == 2
    codes = np.where(letter, codes, 0).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
    c, n = codes[keep], int(keep.sum())
    counts = np.zeros(len(texts) * SLOTS)
    h = np.zeros(n, np.uint64)
    for k in range(3):
        h = h[: n - k] * np.uint64(0x100000001B3) + c[k:] + np.uint64(1)
        if not len(h):
            break
        whole = owner[k:] == owner[: n - k]
        slot = owner[: n - k][whole] * SLOTS + (textkit.mix(h[whole] + np.uint64(k << 56)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(slot, minlength=len(counts))
    counts = counts.reshape(len(texts), SLOTS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def code_matrix(k: int) -> np.ndarray:
    """Codewords (k rows) of +1 and -1."""
    if k <= 5:
        return np.array([[1, *bits] for bits in product((1, -1), repeat=k - 1)][1:], np.float32).T
    bits, best = 10 * int(np.ceil(np.log2(k))), None
    for seed in range(16):
        m = np.random.default_rng(seed).choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        m = m[:, np.abs(m.sum(0)) < k]
        nearest = -np.inf
        for lo in range(0, k, 512):
            same = m[lo : lo + 512] @ m.T
            same[np.arange(len(same)), np.arange(lo, lo + len(same))] = -np.inf
            nearest = max(nearest, float(same.max()))
        if best is None or nearest < best[0]:
            best = (nearest, m)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, each row sums to the number of bits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        x = features(texts)
        known = x.any(1)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        margins = x @ self.weights + self.bias
        if len(self.languages) == 1:
            loss = np.zeros((len(texts), 1))
        else:
            loss = np.logaddexp(0, -margins) @ (self.trust * (self.code > 0)).T + np.logaddexp(0, margins) @ (self.trust * (self.code < 0)).T
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = np.where(known, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score.tolist(), (known & (score < AMBIGUOUS)).tolist()


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression for each bit, by accelerated gradient steps; ridge 1e-5."""
    names = sorted(set(languages))
    if len(names) < 2:
        one = np.zeros((len(names), 1), np.float32)
        return Model(names, one, np.zeros((SLOTS, 1), np.float32), one[:1].ravel(), one)
    code, mine = code_matrix(len(names)), np.array([names.index(v) for v in languages])
    y = code[mine]
    w = last = np.zeros((SLOTS, code.shape[1]), np.float32)
    b = last_b = np.zeros(code.shape[1], np.float32)
    for i in range(250):
        push = i / (i + 3)
        vw, vb = w + push * (w - last), b + push * (b - last_b)
        g = -y / (1 + np.exp(y * (x @ vw + vb))) / len(x)
        last, last_b = w, b
        w, b = vw - 6 * (x.T @ g + 1e-5 * vw), vb - 2 * g.sum(0)
    right = (x @ w + b) * y > 0
    trust = np.stack([right[mine == k].mean(0) for k in range(len(names))]) + 1e-3
    return Model(names, code, w, b, (trust * code.shape[1] / trust.sum(1, keepdims=True)).astype(np.float32))


def _hash_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b["lang"].to_pylist()
        for at, texts in textkit.chunks(b["text"].to_pylist(), most=256):
            rows = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(langs[at : at + len(texts)], pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"])


def train(labelled: DataFrame) -> Model:
    """labelled(doc_id, text, lang)."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()  # as many rows as languages
    each = max(2, SAMPLE_ROWS // max(len(counts), 1))
    # hashes below this share hold about three times the rows wanted, so that no language brings more to its one window task
    share = spark.createDataFrame([(r["lang"], min(1.0, 3 * each / r["count"] + 1e-6)) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = (draw / float(1 << 30)) < F.col("share")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text")))  # each task keeps so many rows before the shuffle, too
    some = rows.join(F.broadcast(share), "lang").where(near).select("lang", "doc_id", "text", draw.alias("draw")).withColumn("nth", nth).where(F.col("nth") <= each)
    got = some.select("lang", "text").mapInArrow(_hash_features, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, SLOTS).astype(np.float32)
    return fit(x, got["lang"].to_pylist())


def predict(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of documents (which has text), and lang_pred, score, ambiguous."""
    ship(documents.sparkSession)
    kind = documents.select(*keep).schema

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in textkit.chunks(b["text"].to_pylist(), most=256):
                lang, score, unsure = model.predict(texts)
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predicted, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), OUT]))


def accept(documents: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of documents whose text has a language (not `und`) with at least that score, with all their columns."""

    def decider():
        def decide(texts: list[str]) -> np.ndarray:
            lang, score, _ = model.predict(texts)
            return (np.array(lang, object) != "und") & (np.array(score) >= least)

        return decide

    return textkit.keep_where(documents, decider, most=256)


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(5, 0)))
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
