"""Language identification in two steps: the family, then one language in it.

Features are hashed byte n-grams of the whole lower-cased text. Linear support
vector machines (squared hinge) tell each family from the rest; inside a family
one machine for every pair of languages votes. They are fitted on a bounded
sample of labelled rows; prediction covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Families of the languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr ug uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg ms su tl",
    "cjk": "ja ko zh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed features; most labelled rows used for fitting, in all and a language.
DIMENSIONS, SAMPLE_ROWS, SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 4096, 8000, 500, 400
UNDETERMINED = "und"

# ASCII letters and all non-ASCII bytes stay; the rest are word breaks.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], "other")


def features(text: str) -> np.ndarray:
    """Hashed counts of the 2-, 3- and 4-byte grams, damped, of length one."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.float32)
    code = raw
    for size in (2, 3, 4):
        if len(raw) < size:
            break
        code = (code[:-1] << np.uint32(8)) | raw[size - 1 :]
        with np.errstate(over="ignore"):
            slot = ((code ^ np.uint32(size * 0x1F123BB5)) * np.uint32(2654435769)) >> np.uint32(20)
        total += np.bincount(slot, minlength=DIMENSIONS)
    total = np.log1p(total)
    norm = float(np.linalg.norm(total))
    return total / norm if norm else total


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; the last one is the
    bias. Accelerated gradient steps, classes weighed alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        probe = x.T @ (weight * (x @ probe))
        size = float(np.linalg.norm(probe))
        probe /= size
    step = 1 / (1 + 2 * penalty * size * 1.1)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * penalty * (x.T @ (weight * y * slack)))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        labels_of = np.array(labels)
        of = np.array([family_of(v) for v in labels])
        families = sorted(set(of.tolist()))
        languages = {f: sorted(set(labels_of[of == f].tolist())) for f in families}
        rest = [fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in families] if len(families) > 1 else []
        pairs = {}
        for family in families:
            ab = list(combinations(range(len(languages[family])), 2))
            weights = []
            for a, b in ab:
                first, second = languages[family][a], languages[family][b]
                mine = (labels_of == first) | (labels_of == second)
                weights.append(fit_svm(x[mine], np.where(labels_of[mine] == first, 1.0, -1.0)))
            pairs[family] = (ab, np.array(weights, np.float32))
        return cls(families, languages, np.array(rest, np.float32), pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        def chance(weights: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-3.0 * (x @ weights[:, :-1].T + weights[:, -1])))

        if len(self.families) > 1:
            sure = chance(self.family_weights)
            sure /= sure.sum(axis=1, keepdims=True)
        else:
            sure = np.ones((len(x), 1))
        best = sure.argmax(axis=1)
        names, scores = [""] * len(x), [0.0] * len(x)
        votes = {}
        for number, family in enumerate(self.families):
            languages, (ab, weights) = self.languages[family], self.pairs[family]
            mean = np.ones((len(x), len(languages)))
            if ab:
                won, mean = chance(weights), np.zeros((len(x), len(languages)))
                for k, (a, b) in enumerate(ab):
                    mean[:, a] += won[:, k]
                    mean[:, b] += 1 - won[:, k]
                mean /= len(languages) - 1
            votes[number] = (languages, mean)
        for row, number in enumerate(best.tolist()):
            languages, mean = votes[number]
            choice = int(mean[row].argmax())
            names[row] = languages[choice]
            scores[row] = float(min(1.0, sure[row, number] * mean[row, choice]))
        return names, scores


def fit(labelled: DataFrame) -> Model | None:
    """Fit on ``doc_id, text, lang`` rows: up to SAMPLE_PER_LANGUAGE of each
    language, those with the smallest hash of id and text, SAMPLE_ROWS in all.
    None where there is nothing to learn from."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = rows.select("lang", "h").withColumn("n", order).where(F.col("n") <= SAMPLE_PER_LANGUAGE)
    upto = first.groupBy("lang").agg(F.max("h").alias("upto")).limit(MAX_LANGUAGES + 1).collect()
    if len(upto) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not upto:
        return None
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(upto))
    bound = F.element_at(F.create_map(*[F.lit(v) for r in upto for v in (r.lang, r.upto)]), F.col("lang"))
    sample = rows.where(F.col("h") <= bound).withColumn("n", order).where(F.col("n") <= each)

    @F.pandas_udf("binary")
    def packed(text):
        return text.map(lambda t: features(t).tobytes())

    got = sample.select("lang", packed("text").alias("x")).orderBy("lang", "h").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got])
    return Model.fit(x, [r.lang for r in got])


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        known = [i for i, letters in enumerate(batch.column("letters").to_pylist()) if letters and model is not None]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), 512):
            part = known[at : at + 512]
            for i, name, score in zip(part, *model.predict(np.stack([features(texts[i]) for i in part]))):
                names[i], scores[i] = name, score
        made = {"lang_pred": names, "score": scores}
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema
        )


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, from its text alone.

    A text without a letter, an empty or a null one is undetermined, with score
    0, as is everything where nothing was learned. Repeated rows give repeated
    results; an empty table none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("lang_pred string, score double")])
    return source.mapInArrow(lambda b: _predict(b, sent.value, to_arrow_schema(schema)), schema)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the labelled
    documents that are not held out, predicted for all. A null id is not held
    out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    predicted = identify(docs, model)
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score")
