"""Quality scores from compression with dictionaries of good and of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.folds import draw, held_out
from tallyforge.session import ship_package

#: Bounds of the fit: labelled documents a class for the dictionaries, bytes a class given to the
#: dictionary builder, and labelled documents in all for the calibration.
DICT_DOCS, DICT_BYTES, CALIBRATION_DOCS = 4000, 12_000_000, 12_000
DICT_SIZE, LEVEL, SEGMENT = 112_640, 3, 2048


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries (of label 0 and 1) and the calibration of what they show."""

    bad: bytes
    good: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def features(self, texts: list[str]) -> np.ndarray:
        return _features(self.bad, self.good, texts)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - np.array(self.mean)) / np.array(self.scale)] @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _compressors(*dictionaries: bytes):
    import zstandard

    made = []
    for d in dictionaries:
        held = zstandard.ZstdCompressionDict(d)
        if d:
            held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def _features(bad: bytes, good: bytes, texts: list[str]) -> np.ndarray:
    """For every whole text, compressed in segments: the normalised difference of the compressed
    sizes, the compressed share, the log of the size, and the difference times that log."""
    packs = _compressors(bad, good)
    out = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        parts = [raw[k : k + SEGMENT] for k in range(0, len(raw), SEGMENT)] or [b""]
        a, b = (sum(len(c.compress(p)) for p in parts) for c in packs)
        size = np.log(max(1, len(raw)))
        gap = (a - b) / max(1, a, b)
        out[i] = gap, b / max(1, len(raw)), size, gap * size
    return out


def build_dictionary(texts: list[str], size: int = DICT_SIZE) -> bytes:
    """A zstandard dictionary of the texts' segments; where they are too few to train one, the text itself."""
    import zstandard

    parts = [p for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for p in (raw[k : k + SEGMENT] for k in range(0, len(raw), SEGMENT))]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(4), np.ones(4))
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(5)
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(5)
        w = w + np.linalg.solve(h, a.T @ (y - p) - 1e-2 * np.r_[0, w[1:]])
    return tuple(mean), tuple(scale), tuple(w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from labelled rows that are not held out.

    A bounded sample is drawn in a fixed pseudo-random order of ids: DICT_DOCS ids a class build the
    dictionaries (DICT_BYTES of whole texts a class), CALIBRATION_DOCS other ids fit the
    calibration. Null labels, ids and texts are left out. Without labels the score is one half.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.withColumn("part", F.pmod(draw(id_col, "part"), F.lit(2))).withColumn("o", draw(id_col, "order"))
    picks = [known.where(f"part = 0 and y = {y}").orderBy("o").limit(DICT_DOCS) for y in (0, 1)]
    picks += [known.where("part = 1").orderBy("o").limit(CALIBRATION_DOCS)]
    ids = picks[0].unionByName(picks[1]).unionByName(picks[2])  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), id_col)
    rows = rows.persist()
    try:
        sample = rows.where("part = 0").withColumn("bytes", F.octet_length("text"))
        texts: list[list[str]] = [[], []]
        for y in (0, 1):
            room = sample.where(f"y = {y}").withColumn("upto", F.expr("sum(bytes) over (order by o, text rows unbounded preceding)"))
            texts[y] = [r.text for r in room.where(F.col("upto") <= DICT_BYTES).select("text").collect()]
        bad, good = map(build_dictionary, texts)
        got = _map_features(rows.where("part = 1").select(F.col("y").cast("long").alias("id"), "text"), "long", bad, good).collect()
    finally:
        rows.unpersist()
    x = np.array([r[1:] for r in got], dtype=float).reshape(-1, 4)
    y = np.array([r[0] for r in got], dtype=float)
    order = np.lexsort((*x.T, y))
    return QualityModel(bad, good, *_logistic(x[order], y[order]))


def _map_features(rows: DataFrame, kind: str, bad: bytes, good: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = _features(bad, good, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(4))], ["id", "x0", "x1", "x2", "x3"])

    return rows.mapInArrow(run, f"id {kind}, x0 double, x1 double, x2 double, x3 double")


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text; null and empty texts are scored as empty.

    Every input row gives one row; extra columns are ignored.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            p = model.score(model.features([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    scored = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
