"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows; the log-probability matrix (2 ** BITS
rows, one column per language, float32) is broadcast and its size is checked. Scoring is a sparse
sum: a text's n-gram hashes pick matrix rows, and numpy adds them up over the whole text.

Defined cases: null text, or one without a letter, is `und` with score 0; null lang is never learned;
with nothing to learn from every text is `und`; equal scores go to the first language by code point;
repeated rows are scored alike; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.common import slices, small_batches, table
from holdfast.llm.units import release

BITS = 16
ORDERS = (1, 2, 3)
#: Rows that training reads, about; taken by a hash of id and text, half in proportion, half in equal quotas by language.
MAX_TRAIN = 20_000
#: Rows of a language that are learned at least, if it has them.
LEAST = 100
#: Bytes that the broadcast matrix may have: 2 ** BITS rows of 4 bytes for each language, so 256 languages.
MAX_MATRIX = 64 << 20
ALPHA = 0.1
UNKNOWN = "und"
#: Code points of a text that are hashed at once.
CHUNK = 1 << 17
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def features(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the lower-cased text, by chunks; letters, with other runs as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for start in range(0, len(points), CHUNK):
        # a chunk ends with the first characters of the next one, so no n-gram is lost between them
        chunk = points[start : start + CHUNK + max(ORDERS) - 1]
        plain = (chunk < 128) & ~((chunk >= 97) & (chunk <= 122))
        chunk = np.where(plain, np.uint32(32), chunk)
        keep = np.ones(len(chunk), bool)
        keep[1:] = ~((chunk[1:] == 32) & (chunk[:-1] == 32))
        chunk = chunk[keep]
        state = np.zeros(len(chunk), np.uint32)
        for n in ORDERS:
            if len(chunk) < n:
                break
            head = state[: len(chunk) - n + 1]
            state = (head ^ chunk[n - 1 :]) * _MIX[n % 3]
            state ^= state >> np.uint32(15)
            yield (state * _MIX[0]) >> np.uint32(32 - BITS)


def _counter(index: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros((len(index), 1 << BITS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for found in features(text):
                    sums[index[lang]] += np.bincount(found, minlength=1 << BITS)
        row, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(sums[row, slot])], ["row", "slot", "n"])

    return count


def _column(counts: pd.DataFrame) -> pd.DataFrame:
    """The log-probabilities of one language, from at most 2 ** BITS counts."""
    sums = np.zeros(1 << BITS)
    sums[counts["slot"]] = counts["n"]
    logs = np.log((sums + ALPHA) / (sums.sum() + ALPHA * (1 << BITS)))
    return pd.DataFrame({"row": counts["row"].iloc[:1], "logs": [logs.astype(np.float32).tobytes()]})


def train(rows: DataFrame, max_rows: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """rows (doc_id, text, lang) -> languages by code point, log-probability matrix, log priors.

    The driver gets the languages and a column of the matrix for each, never documents or counts.
    """
    rows = small_batches(rows).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_MATRIX // (4 << BITS) + 1).collect()}
    langs = sorted(sizes)
    if len(langs) * (4 << BITS) > MAX_MATRIX:
        raise ValueError(f"more than {MAX_MATRIX // (4 << BITS)} languages to learn: lower BITS or raise MAX_MATRIX")
    total = sum(sizes.values())
    matrix, priors = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros(len(langs))
    if not langs:
        return langs, matrix, priors
    if total > max_rows:
        # half of the rows in proportion, half in equal quotas, so that rare languages are learned at every size
        quota = max(max_rows / 2 / len(langs), LEAST)
        parts = {x: int(min(1.0, max(max_rows / 2 / total, quota / n)) * 1_000_000_000) for x, n in sizes.items()}
        part = F.element_at(F.create_map(*[F.lit(v) for x in langs for v in (x, parts[x])]), F.col("lang"))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < part)
    counted = rows.select("text", "lang").mapInArrow(_counter({x: i for i, x in enumerate(langs)}), "row int, slot int, n long")
    docs = np.array([1.0 + sizes[x] for x in langs])
    matrix[:] = np.float32(-BITS * np.log(2.0))  # a language whose sampled texts have no n-gram tells nothing
    columns = counted.groupBy("row", "slot").agg(F.sum("n").alias("n")).groupBy("row").applyInPandas(_column, "row int, logs binary")
    for r in columns.toLocalIterator():
        matrix[:, r["row"]] = np.frombuffer(r["logs"], np.float32)
    return langs, matrix, np.log(docs / docs.sum())


def classify(text: str | None, langs: list[str], matrix: np.ndarray, priors: np.ndarray) -> tuple[str, float]:
    if text is None or not langs or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0
    sums = priors.astype(np.float64)
    for found in features(text):
        sums = sums + matrix[found].sum(axis=0, dtype=np.float64)
    odds = np.exp(sums - sums.max())
    best = int(np.argmax(sums))
    return langs[best], float(odds[best] / odds.sum())


def annotate(docs: DataFrame, model) -> DataFrame:
    """All columns of docs, and lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    names = [f.name for f in schema.fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            found = [classify(x, *sent.value) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    return small_batches(docs).mapInArrow(score, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    return annotate(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is recognised; all columns stay as they are."""
    model = train(docs)
    marked = annotate(docs, model)
    return marked.toDF(*docs.columns, "_hf_lang", "_hf_score").filter((F.col("_hf_lang") != UNKNOWN) & (F.col("_hf_score") >= min_score)).select(*docs.columns)
