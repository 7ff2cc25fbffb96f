"""Language identification by error-correcting output codes (operator 9).

Each bit of a language's codeword is predicted by a binary classifier over byte trigrams; the language
whose codeword has the smallest weighted loss is chosen, and a small lead over the next flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import fold, in_slices, solid

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Languages whose counts a task holds at once.
HELD = 256
#: A lead under this share of the total loss makes a prediction ambiguous.
AMBIGUOUS = 0.02
RESULTS = {"lang_pred": StringType(), "score": DoubleType(), "runner_up": StringType(), "ambiguous": BooleanType()}
#: Languages that are learned at most.
LANGUAGES = 256
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter reads as a blank.
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MANY_BLANKS = regex.compile(rb"  +")


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1: every split of up to five classes, else the most distant of some random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        return np.stack([np.where(splits >> c & 1, 1.0, -1.0) if c < classes - 1 else -np.ones(len(splits)) for c in range(classes)])
    bits, draw = int(np.ceil(10 * np.log2(classes))), np.random.default_rng(seed)
    best, best_gap = None, -1.0
    for _ in range(64):
        code = np.where(draw.random((classes, bits)) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < classes]
        gap = ((code[:, None, :] != code[None, :, :]).sum(-1) + np.eye(classes) * bits).min()
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x (BUCKETS and one of weight 0)
    trust: np.ndarray  # of each bit, sums to 1


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, one after another, and where each text's begin."""
    raws = [b" " + _MANY_BLANKS.sub(b" ", t.lower().encode("utf-8", "replace").translate(_BLANKS)).strip() + b" " for t in texts]
    raws = [r if len(r) >= 3 else b"   " for r in raws]
    whole = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint32)
    code = (whole[:-2] << 16) | (whole[1:-1] << 8) | whole[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)
    code = np.append(code, np.int32([BUCKETS, BUCKETS]))
    ends = np.cumsum([len(r) for r in raws])
    for k in (1, 2):  # what reaches over a text's end belongs to none; that bucket has no weight
        code[ends - k] = BUCKETS
    return code, np.concatenate([[0], ends[:-1]]).astype(np.int64)


def fit(docs: DataFrame, most: int = LANGUAGES) -> LanguageModel:
    """Counts of trigrams by language over all rows of docs that have a text and a lang, added up by Spark.

    The ``most`` languages with the most rows (of as many, the first by name) are learned, so the driver gets one number for
    each bucket of so many languages, however many documents and names of languages there are.
    """

    def given(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": got[at]})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for part in in_slices(iter([frame]), "text"):
                for lang, own in part.groupby("lang"):
                    got = np.bincount(_grams(own["text"].tolist())[0], minlength=BUCKETS + 1)[:BUCKETS]
                    sums[lang] = sums.get(lang, 0) + got
                    if len(sums) >= HELD:
                        yield from given(sums)
                        sums.clear()
        yield from given(sums)

    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    learned = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most).select("lang")
    rows = labelled.join(F.broadcast(learned), "lang").select("text", "lang").mapInPandas(solid(count), "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    shares = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        shares[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    shares /= shares.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights, trust = np.zeros((code.shape[1], BUCKETS + 1)), np.ones(code.shape[1])
    if len(languages) > 1:
        for bit in range(code.shape[1]):
            yes, no = shares[code[:, bit] > 0].mean(0), shares[code[:, bit] < 0].mean(0)
            weights[bit, :BUCKETS] = np.log(yes) - np.log(no)
            trust[bit] = ((yes - no) * weights[bit, :BUCKETS]).sum()  # how far apart the two sides are
    return LanguageModel(languages, code, weights.astype(np.float32), trust / trust.sum())


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic loss of every codeword, for rows of margins."""
    signed = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -signed) * model.trust).sum(-1)
    return loss, np.argsort(loss, axis=1, kind="stable")


def predict_columns(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score, runner_up, ambiguous of every text (replacing columns so named); one narrow stage, the model has a fixed size.

    A text that is null or has no letter is `und` with score 0 and is ambiguous, and so is every text if the
    model knows no language. With one language, every text with a letter is that one, score 1. score is the
    softmax of the losses times the square root of the number of trigrams; at equal losses the language that
    comes first by name is taken. A very long text is read whole, in memory in proportion to it. Repeated rows and
    other columns change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in in_slices(frames, "text"):
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            known = np.array([bool(m.languages) and LETTER.search(t) is not None for t in texts], dtype=bool)
            best, score, second = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.full(len(texts), None, dtype=object)
            unsure = np.ones(len(texts), dtype=bool)
            at = np.flatnonzero(known)
            if len(at):
                grams, starts = _grams([texts[i] for i in at])
                n = np.diff(np.append(starts, len(grams))) - 2.0
                margins = np.stack([np.add.reduceat(w[grams], starts) for w in m.weights], axis=1) / n[:, None]
                loss, order = decode(m, margins)
                rows = np.arange(len(at))
                lead = loss[rows, order[:, 1]] - loss[rows, order[:, 0]] if len(m.languages) > 1 else np.ones(len(at))
                odds = np.exp(-(loss - loss.min(1, keepdims=True)) * 8 * np.sqrt(n)[:, None])
                best[at] = np.array(m.languages, dtype=object)[order[:, 0]]
                score[at] = (odds / odds.sum(1, keepdims=True))[rows, order[:, 0]]
                if len(m.languages) > 1:
                    second[at] = np.array(m.languages, dtype=object)[order[:, 1]]
                unsure[at] = lead < AMBIGUOUS * loss.sum(1)
            yield part.assign(lang_pred=best, score=score, runner_up=second, ambiguous=unsure)

    docs = docs.drop(*RESULTS)
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in RESULTS.items())])
    return docs.mapInPandas(solid(run), schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id and the results of predict_columns()."""
    return predict_columns(docs.select("doc_id", "text"), model).drop("text")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(5) != 0)
