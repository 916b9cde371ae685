"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.batches import slices
from tallyforge.llm.folds import draw, held_out
from tallyforge.session import ship_package

BINS = 1 << 16
#: Most bits of a codeword; up to seven languages the exhaustive code fits.
MAX_BITS = 63
#: Bound of the sample of learned documents on which bits are weighed and scores calibrated.
WEIGH_DOCS = 5000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # digits in a ring, fractions and powers match, too, but are no letters
#: Bytes outside words become spaces; bytes of other scripts and accents stay.
_WORDS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte trigrams of lower-cased whole texts, and where each text's begin.

    Words are set off by spaces, so that starts and ends of words are trigrams of their own.
    """
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(_WORDS) + b"  " for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    b = np.frombuffer(b"".join(raw) + b"  ", np.uint8).astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
    return h, at


def codewords(k: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """(k, bits) of -1/1: all splits of the languages in two where they fit, else random ones from a fixed seed."""
    if k < 2:
        return np.ones((k, 1))
    if 2 ** (k - 1) - 1 <= max_bits:
        masks = range(1, 2 ** (k - 1))
        return np.array([[1 if m >> i & 1 else -1 for m in masks] for i in range(k)], dtype=float)
    best, far = None, -1
    rng = np.random.default_rng(0)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(k, max_bits))
        apart = (code[:, None] != code[None]).sum(-1)[np.triu_indices(k, 1)].min()
        if apart > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, apart
    return best


@dataclass(frozen=True)
class LanguageModel:
    """langs and their codewords; tables: log-odds of every bin for every bit; bit weights and sharpness."""

    langs: tuple[str, ...]
    code: np.ndarray
    tables: np.ndarray
    bit_weights: np.ndarray
    sharpness: float
    ambiguous_below: float = 0.6

    def margins(self, texts: list[str]) -> np.ndarray:
        """Evidence of every bit: the sum of log-odds over the root of the number of trigrams."""
        out = np.zeros((len(texts), self.tables.shape[1]))
        for i in range(0, len(texts), 64):
            some = texts[i : i + 64]
            h, at = grams(some)
            for k in range(len(some)):
                for lo in range(int(at[k]), int(at[k + 1]), 1 << 16):  # bounds the rows gathered for a very long text
                    out[i + k] += self.tables[h[lo : min(lo + (1 << 16), int(at[k + 1]))]].sum(axis=0, dtype=np.float64)
            out[i : i + len(some)] /= np.sqrt(np.maximum(np.diff(at), 1))[:, None]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row's margins to each codeword, by the logistic loss."""
        bounded = np.clip(margins, -30, 30)
        loss = np.logaddexp(0, -self.code[None] * bounded[:, None, :])
        return (loss * self.bit_weights).sum(-1) / max(self.bit_weights.sum(), 1e-12)

    def decode(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text; 'und' with score 0 if it has no letter."""
        asked = [t is not None and has_letter(t) and bool(self.langs) for t in texts]
        langs, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, a in enumerate(asked) if a]
        if rows:
            loss = self.losses(self.margins([texts[i] for i in rows]))
            p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, b, row in zip(rows, best, p, strict=True):
                langs[i], scores[i], unsure[i] = self.langs[b], row[b], row[b] < self.ambiguous_below
        return langs, scores, unsure


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n) over all rows of (lang, text); a task adds up before it sends."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for i in range(0, len(mine), 256):
                    h, _ = grams(mine[i : i + 256])
                    held[lang] = held.get(lang, 0) + np.bincount(h, minlength=BINS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            for i in range(0, len(at), 10_000):
                some = at[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "bin", "n"])

    return docs.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows with a text and a language that are not held out.

    One pass counts trigrams for each language over all of them; what reaches the driver is a table
    of languages by BINS at most. Each bit's classifier is the log-odds between the languages on its
    two sides. A sample of WEIGH_DOCS documents in a fixed pseudo-random order then weighs the bits by
    how rarely they err and sets how sharp the scores are.
    """
    ship_package(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = _counts(known.select("lang", "text")).toArrow()
    langs = tuple(sorted(set(table["lang"].to_pylist())))
    code = codewords(len(langs))
    n = np.zeros((len(langs), BINS))
    where = {x: i for i, x in enumerate(langs)}
    if langs:
        n[[where[x] for x in table["lang"].to_pylist()], table["bin"].to_numpy()] = table["n"].to_numpy()
    p = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BINS)  # languages weigh alike, however many texts they have
    tables = np.zeros((BINS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = code[:, b] > 0, code[:, b] < 0
        if plus.any() and minus.any():
            tables[:, b] = np.log(p[plus].mean(0)) - np.log(p[minus].mean(0))
    blank = grams([""])[0][0]
    tables[blank] = 0
    model = LanguageModel(langs, code, tables, np.ones(code.shape[1]), 1.0)
    if len(langs) < 2:
        return model
    # Ids are drawn first, so that no text but the drawn ones is sorted or sent.
    ids = known.select("id").orderBy(draw("id", "weigh"), "id").limit(WEIGH_DOCS).distinct()
    some = known.join(F.broadcast(ids), "id").select("id", "lang", "text")

    def run(batches):
        for batch in slices(batches):
            m = model.margins(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(m))], ["lang", "m"])

    got = some.repartition(8).mapInArrow(run, "lang string, m array<double>").toArrow()
    m = np.array(got["m"].to_pylist())
    y = np.array([where[x] for x in got["lang"].to_pylist()])
    order = np.lexsort((*m.T, y))
    m, y = m[order], y[order]
    errs = ((m * code[y]) <= 0).mean(0)
    weights = np.log((1 - errs + 1e-3) / (errs + 1e-3)).clip(0.1)
    model = LanguageModel(langs, code, tables, weights, 1.0)
    loss = model.losses(m)
    best = min((4.0**k for k in range(-2, 5)), key=lambda s: np.mean(np.log(np.exp(-s * (loss - loss.min(1, keepdims=True))).sum(1)) + s * (loss[np.arange(len(y)), y] - loss.min(1))))
    return LanguageModel(langs, code, tables, weights, float(best))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every whole text, a row for each input row.

    lang_pred is 'und' with score 0 for a null text and one without a letter; ambiguous marks scores
    under the model's threshold, and 'und'. Extra columns are ignored.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches):
            langs, scores, unsure = model.decode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    kind = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language the model tells; 'und' rows go. Columns stay as they are."""
    ship_package(docs.sparkSession)
    names = docs.columns

    def run(batches):
        at = names.index(text_col)
        for batch in slices(batches):
            langs, _, _ = model.decode(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN for x in langs]))

    return docs.mapInArrow(run, docs.schema)
