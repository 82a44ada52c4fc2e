"""Language identification with string kernels: Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import as_map, fold

#: n-grams of 1, 2 and 3 characters are hashed into so many slots; letters themselves are exact code points.
GRAMS = 1 << 19
_FIRST, _SECOND, _THIRD = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def letters(text: str) -> np.ndarray:
    """The code points of the lower-cased text's letters; each run of other characters is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 97) & (points <= 122), points, 0).astype(np.uint64)
    wide = np.flatnonzero(points > 127)
    if len(wide):
        kinds, at = np.unique(points[wide], return_inverse=True)
        alpha = np.array([chr(p).isalpha() for p in kinds.tolist()])
        out[wide] = np.where(alpha, kinds, 0)[at]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
    return out[keep]


def presence(text: str, flags: np.ndarray) -> np.ndarray:
    """Marks the text's n-grams in `flags` (all zero before) and gives their slots; repeated ones repeat."""
    one = (letters(f" {text} ") + np.uint64(1)) * _FIRST
    two = (one[:-1] ^ one[:-1] >> np.uint64(29)) * _SECOND + one[1:]
    three = (two[:-1] ^ two[:-1] >> np.uint64(31)) * _THIRD + one[2:]
    grams = np.concatenate([one, two, three])
    grams = ((grams ^ grams >> np.uint64(32)) * _SECOND >> np.uint64(64 - 19)).astype(np.int64)
    flags[grams] = 1
    return grams


@dataclass
class LanguageModel:
    """langs; grams: the landmarks' n-grams; landmarks: their presence, normalised (grams x landmarks); weights: landmarks x langs."""

    langs: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """texts x langs: regression outputs, from the kernel matrix of the batch with the landmarks."""
        x = np.zeros((len(texts), len(self.grams)), np.float32)
        flags = np.zeros(GRAMS, np.uint8)
        for k, text in enumerate(texts):
            grams = presence(text, flags)
            x[k] = flags[self.grams]
            count = np.count_nonzero(flags)
            x[k] /= np.sqrt(count)
            flags[grams] = 0
        return (x @ self.landmarks).astype(np.float64) @ self.weights


def fit(docs: DataFrame, folds: int = 5, left_out: int = 0, per_lang: int = 500, landmarks: int = 40, ridge: float = 1e-3) -> LanguageModel:
    """Fits on a sample of labelled documents that are not in fold `left_out`.

    The sample has about `per_lang` documents of each language (all, where
    there are fewer), chosen by a hash of the id; this bound holds at every
    corpus size.  The blended-spectrum kernel of two texts counts the n-grams
    of 1 to 3 characters that both have, over the geometric mean of what each
    has.  `landmarks` texts a language span the feature space of the Nystroem
    approximation; ridge regression there gives one weight vector a language.
    Without a labelled document the model has no language.  Ids may be of any
    type; other columns are ignored; repeated rows count as often as they
    stand.
    """
    usable = docs.select("doc_id", "lang", "text").where((fold(F.col("doc_id"), folds) != left_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) / 1e6
    sample = usable.where(draw < share).select(F.xxhash64("doc_id", F.lit("order")).alias("draw"), "lang", "text")

    def over(batch):
        flags, out = np.zeros(GRAMS, np.uint8), []
        for t in batch.column(2).to_pylist():
            grams = presence(t, flags)
            out.append(np.flatnonzero(flags).astype(np.int32))
            flags[grams] = 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["draw", "lang", "grams"])

    rows = as_map(sample, over, "draw long, lang string, grams array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["grams"]))
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(np.array(r["grams"]))
    chosen = [g for k in langs for g in by_lang.get(k, [])[:: max(1, len(by_lang.get(k, [])) // landmarks)][:landmarks]]
    grams = np.unique(np.concatenate(chosen))
    z = np.zeros((len(grams), len(chosen)), np.float32)
    for j, g in enumerate(chosen):
        z[np.searchsorted(grams, g), j] = 1 / np.sqrt(len(g))
    place = np.full(GRAMS, -1)
    place[grams] = np.arange(len(grams))
    kernel = np.zeros((len(rows), len(chosen)))
    for i, r in enumerate(rows):
        own = place[r["grams"]]
        kernel[i] = z[own[own >= 0]].sum(0) / np.sqrt(len(r["grams"]))
    values, vectors = np.linalg.eigh((z.T @ z).astype(float))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    share = np.array([len(by_lang.get(r["lang"])) for r in rows], float)
    y = np.array([[float(r["lang"] == k) for k in langs] for r in rows])
    balanced = features / share[:, None] * (len(rows) / len(langs))
    beta = np.linalg.solve(features.T @ balanced + ridge * len(rows) * np.eye(features.shape[1]), balanced.T @ y)
    return LanguageModel(langs, grams, z, root @ beta)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch: int = 64) -> DataFrame:
    """`keep`, lang_pred and score (0 to 1) of every whole text.

    `und` with score 0 stands for null texts, texts without a letter, and all
    texts if the model knows no language.  The score is the winner's share of
    the positive regression outputs; ties go to the language first by name.
    Very long texts cost their length; equal texts get equal rows; an empty
    table gives no row; other columns are ignored.
    """
    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL("lang_pred string, score double").fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(arrow):
        m = shared.value
        texts = [t or "" for t in arrow.column(len(keep)).to_pylist()]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if m.langs and any(map(str.isalpha, t))]
        for b in range(0, len(known), batch):
            part = known[b:b + batch]
            out = m.scores([texts[k] for k in part])
            positive = out.clip(1e-9)
            best = out.argmax(1)
            for k, j, s in zip(part, best.tolist(), (positive[range(len(part)), best] / positive.sum(1)).tolist(), strict=True):
                langs[k], scores[k] = m.langs[j], s
        yield pa.RecordBatch.from_arrays([*arrow.columns[:len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)
