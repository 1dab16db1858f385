"""Language identification by averaged hashed subword embeddings.

Subwords are the 2- to 4-character windows of letters, with one boundary mark
on either side of a word, hashed into ``BUCKETS`` rows of an embedding table. A
text is the mean of its subwords' embeddings, a linear softmax gives the
languages. Table and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows; everything is predicted.
A fifth of the sample is held back to calibrate: a temperature that minimises
its log loss, and a confidence below which a prediction is rejected
(``accepted`` is false), set so that ``REJECTED`` of its right predictions fall
below.

As the softmax is linear, the mean embedding times its weights is the mean of
one number per subword and language, so prediction looks up those numbers.

Null text and text without letters are ``und`` with score 0, not accepted; so is
every text if there is nothing to learn from. Case doesn't matter. Whole texts
are read, in segments of fixed size. Of rows that share a key the least (lang,
text) is learned from; all repeated rows are predicted alike. Between languages
of equal probability the first in the alphabet is taken. A row without a key
counts as held out. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.llm.shared import arrow_function

BUCKETS = 1 << 13
DIMENSION = 16
#: Bound of the training sample: rows of a language, and rows in all.
ROWS_PER_LANGUAGE, ROWS = 500, 4000
#: Passes over the sample, and more until there are so many steps.
EPOCHS, STEPS, BATCH, RATE, SEED = 30, 600, 32, 8.0, 7
REJECTED = 0.005
SEGMENT = 1 << 19
UNKNOWN = "und"

RESULT = "struct<lang:string,score:double>"
RESULT_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])
FEATURES = "struct<bucket:array<int>,share:array<float>>"
FEATURES_ARROW = pa.struct([("bucket", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters as code points, all else 0, three zeros after each text; where each text begins."""
    joined = "\0\0\0" + "".join(f"{(t or '').lower()}\0\0\0" for t in texts) + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[~_letters()[codes]] = 0
    ends = np.cumsum([len((t or "").lower()) + 3 for t in texts])
    return codes, np.concatenate([[0], ends]) + 2  # the mark before a text belongs to its first window


def subwords(codes: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the 2-, 3- and 4-character windows that start in [begin, end)."""
    c = [codes[begin + k : end + k] for k in range(4)]
    inner = c[1] != 0
    hashed = c[0] * np.uint32(0x9E3779B1) + c[1] * np.uint32(0x85EBCA77)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n, valid in ((2, inner), (3, inner), (4, inner & (c[2] != 0) if len(c[2]) else inner)):
        if n > 2:
            hashed = hashed * np.uint32(0xC2B2AE3D) + c[n - 1] * np.uint32(0x27D4EB2F)
        at = np.flatnonzero(valid)
        mixed = hashed[at]
        mixed ^= mixed >> np.uint32(15)
        yield at + begin, ((mixed * np.uint32(0x2C1B3C6D + 2 * n)) >> shift).astype(np.int32)


def _segments(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    for a in range(int(starts[0]), int(starts[-1]), SEGMENT):
        yield a, min(a + SEGMENT, int(starts[-1]))


@arrow_function(FEATURES)
def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Share of each bucket among a text's subwords; at most BUCKETS numbers."""
    for texts in batches:
        out = []
        for text in texts:
            codes, starts = _codes([text.as_py()])
            total = np.zeros(BUCKETS)
            for a, b in _segments(codes, starts):
                for _, buckets in subwords(codes, a, b):
                    total += np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(total)
            out.append({"bucket": at.astype(np.int32), "share": (total[at] / max(1, total.sum())).astype(np.float32)})
        yield pa.array(out, FEATURES_ARROW)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent. x: rows of bucket shares. Returns a number per bucket and language, and biases."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (x.shape[1], DIMENSION)).astype(np.float32)
    weights, bias = np.zeros((DIMENSION, n_languages), np.float32), np.zeros(n_languages, np.float32)
    wanted = np.eye(n_languages, dtype=np.float32)[y]
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(x)))
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            rows = order[k : k + BATCH]
            mean = x[rows] @ table
            wrong = (softmax(mean @ weights + bias) - wanted[rows]) / len(rows)
            back = wrong @ weights.T
            weights -= rate * (mean.T @ wrong)
            bias -= rate / 8 * wrong.sum(axis=0)
            table -= rate * (x[rows].T @ back)
    return table @ weights, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature by least log loss on a grid, and the confidence that REJECTED of the right predictions don't reach."""
    if not len(y):
        return 1.0, 0.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(logits / temperature)
    right = sure.max(axis=1)[sure.argmax(axis=1) == y]
    return temperature, float(np.quantile(right, REJECTED)) if len(right) else 0.0


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 2 when divided by 4. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Model from at most ROWS labelled rows, ROWS_PER_LANGUAGE of each language, those of the least hashes."""
    hashed = F.xxhash64(F.col(key))
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    counts = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "_lang").limit(ROWS)
    # a share of each language that leaves about four times the rows wanted, so that the window below never meets a whole language
    keyed = labelled.select(F.col(lang).alias("_lang"), hashed.alias("_hash"), F.col(key).alias("_key")).join(F.broadcast(counts), "_lang")
    keyed = keyed.where(F.pmod("_hash", F.lit(1 << 30)) < 4.0 * ROWS_PER_LANGUAGE / F.col("_rows") * (1 << 30))
    order = W.partitionBy("_lang").orderBy("_hash", "_key")
    ids = keyed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ROWS_PER_LANGUAGE)
    ids = ids.orderBy("_n", "_lang").limit(ROWS).select("_key").distinct()
    sample = labelled.join(F.broadcast(ids), F.col(key) == F.col("_key"), "left_semi")  # at most ROWS ids
    per_key = sample.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(F.col(lang).alias("lang"), F.col(text).alias("text")), F.struct(lang, text)).alias("row"))
    rows = sorted(per_key.select("_key", "row.lang", features(F.col("row.text")).alias("f")).toLocalIterator(), key=lambda r: (zlib.crc32(f"fold{r['_key']}".encode()), r["_key"]))
    rows = [r for r in rows if r["f"]["bucket"]]
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return {"languages": [], "temperature": 1.0, "least": 0.0}
    x, y = np.zeros((len(rows), BUCKETS), np.float32), np.array([languages.index(r["lang"]) for r in rows])
    for k, r in enumerate(rows):
        x[k, r["f"]["bucket"]] = r["f"]["share"]
    cut = len(rows) // 5
    table, bias = train(x[cut:], y[cut:], len(languages))
    temperature, least = calibrate(x[:cut] @ table + bias, y[:cut])
    return {"languages": languages, "table": table.astype(np.float32), "bias": bias.astype(np.float64), "temperature": temperature, "least": least}


def scores(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Mean numbers per text and language, and subwords per text."""
    codes, starts = _codes(texts)
    total, n = np.zeros((len(texts), len(model["languages"]))), np.zeros(len(texts), np.int64)
    for a, b in _segments(codes, starts):
        first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
        edges = np.maximum(starts[first : last + 1], a)
        for at, buckets in subwords(codes, a, b):
            cut = np.searchsorted(at, np.append(edges, b))
            some = np.flatnonzero(np.diff(cut))
            if not len(some):
                continue
            n[first + some] += np.diff(cut)[some]
            for k in range(total.shape[1]):
                total[first + some, k] += np.add.reduceat(model["table"][:, k][buckets].astype(np.float64), cut[some])
    return total / np.maximum(n, 1)[:, None], n


def predictor(model: dict, spark):
    """A column function: text to RESULT."""
    everywhere = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = everywhere.value
        if "table" in own:
            own = own | {"table": np.asfortranarray(own["table"])}
        for texts in batches:
            out, texts = [], texts.to_pylist()
            if not own["languages"]:
                yield pa.array([{"lang": UNKNOWN, "score": 0.0}] * len(texts), RESULT_ARROW)
                continue
            mean, n = scores(own, texts)
            sure = softmax((mean + own["bias"]) / own["temperature"])
            for best, score, count in zip(sure.argmax(axis=1), sure.max(axis=1), n, strict=True):
                out.append({"lang": own["languages"][best], "score": float(score)} if count else {"lang": UNKNOWN, "score": 0.0})
            yield pa.array(out, RESULT_ARROW)

    return predict


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per text: key, held_out, lang_pred, score, accepted."""
    model = fit(docs, key, text, lang)
    found = docs.select(key, predictor(model, docs.sparkSession)(F.col(text)).alias("p"))
    return found.select(key, held_out(F.col(key)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), ((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= model["least"])).alias("accepted"))
