"""Language of notes by family first, then by one-versus-one linear support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm import common

UNDETERMINED = "und"
SAMPLE = 400  # different labelled texts a language is learned from, at most
WIDTH = 4096  # hashed character sequences

# Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "la"),
    "slavic": ("ru", "uk", "bg", "pl", "cs", "sk", "sl", "sr", "hr"),
    "uralic": ("fi", "et", "hu"),
}


def _folded() -> np.ndarray:
    """Bytes in lower case; all ASCII but letters become blanks."""
    table = np.arange(256, dtype=np.uint8)
    for code in range(128):
        table[code] = ord(chr(code).lower()) if chr(code).isalpha() else 32
    return table


FOLD = _folded()


def features(flat: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row of unit length per text: square roots of hashed counts of two and three bytes."""
    out = np.zeros((len(at) - 1, width), dtype=np.float32)
    if not len(flat):
        return out
    low = FOLD[flat]
    # Latin capitals of two bytes (0xC3 0x80-0x9E) in lower case.
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
    low[capital] += 0x20
    b = np.concatenate([low, np.full(2, 32, dtype=np.uint8)]).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) ^ np.roll(b, -1)[:-1] * np.uint32(0x85EBCA77)
    three = two[:-1] ^ b[2:] * np.uint32(0xC2B2AE3D)
    blank = (b[:-2] == 32) & (b[1:-1] == 32)
    shift = np.uint32(32 - int(width).bit_length() + 1)
    two, three = (two[:-1] * np.uint32(0x27D4EB2F)) >> shift, (three * np.uint32(0x165667B1)) >> shift
    for i, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        keep = ~blank[start : max(start, end - 2)]
        counts = np.bincount(two[start : max(start, end - 2)][keep], minlength=width)
        counts = counts + np.bincount(three[start : max(start, end - 2)][keep], minlength=width)
        row = np.sqrt(counts)
        out[i] = row / max(1.0, float(np.linalg.norm(row)))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float64)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = min(cost, max(0.0, alpha[i] - (y[i] * float(w @ x[i]) - 1) / square[i])) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Choice:
    """One-versus-one machines between names."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    @classmethod
    def learn(cls, x: np.ndarray, labels: list[str]) -> Choice:
        names = sorted(set(labels))
        tags = np.array([names.index(v) for v in labels])
        out = cls(names, [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))])
        made = []
        for i, j in out.pairs:
            chosen = np.flatnonzero((tags == i) | (tags == j))
            made.append(train_svm(x[chosen], np.where(tags[chosen] == i, 1.0, -1.0)))
        if made:
            out.weights = np.stack([w for w, _ in made], axis=1)
            out.bias = np.array([b for _, b in made], dtype=np.float32)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of each name, the mean chance against the others."""
        out = np.zeros((len(x), len(self.names)))
        if not self.pairs:
            return out + 1.0
        chance = 1 / (1 + np.exp(-2.0 * np.clip(x @ self.weights + self.bias, -20, 20)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += chance[:, k]
            out[:, j] += 1 - chance[:, k]
        return out / (len(self.names) - 1)


@dataclass
class LanguageModel:
    families: Choice
    members: dict[str, Choice]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        if not self.families.names or not len(x):
            return names.tolist(), scores
        by_family = self.families.scores(x)
        best = by_family.argmax(axis=1)
        for f, family in enumerate(self.families.names):
            rows = np.flatnonzero(best == f)
            if len(rows):
                inside = self.members[family].scores(x[rows])
                pick = inside.argmax(axis=1)
                names[rows] = np.array(self.members[family].names, dtype=object)[pick]
                scores[rows] = by_family[rows, f] * inside[np.arange(len(rows)), pick]
        return names.tolist(), scores


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.pieces(batches, most=1 << 20):
        x = features(*common.utf8(batch.column(batch.schema.get_field_index("content"))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("lang")), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
            names=["lang", "x"],
        )


def learn_languages(labelled: DataFrame, families: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE) -> LanguageModel:
    """A model from notes with a ``lang`` column; rows without ``lang`` are left out.

    At most ``sample`` different texts of each language are learned from, those with the least
    hashes of 64 bits, so that copies, size and order of the table do not matter; that bounds
    what reaches the driver.  Without labelled rows the model knows no language.
    """
    family_of = {lang: family for family, members in (families or FAMILIES).items() for lang in members}
    rows = labelled.select(
        F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull())
    rows = rows.where(F.col("content").rlike(r"\p{L}")).withColumn("h", F.xxhash64("content"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    part = F.lit(0.0)
    for lang, count in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.2 * sample + 100) / count))).otherwise(part)
    # Somewhat more than the sample is drawn by the hash as a fraction, so that only those are ranked.
    drawn = rows.where(F.col("h") / float(1 << 64) + 0.5 <= part) if counts else rows.limit(0)
    drawn = drawn.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    taken = drawn.where(F.col("place") <= sample).drop("place", "h").mapInArrow(common.lean(_sampled), "lang string, x binary").collect()
    taken.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"]), dtype=np.float16) for r in taken], dtype=np.float32).reshape(-1, WIDTH)
    langs = [r["lang"] for r in taken]
    groups = [family_of.get(v, v) for v in langs]
    members = {}
    for family in sorted(set(groups)):
        rows_of = [i for i, g in enumerate(groups) if g == family]
        members[family] = Choice.learn(x[rows_of], [langs[i] for i in rows_of])
    return LanguageModel(Choice.learn(x, groups), members)


def identify_languages(notes: DataFrame, model: LanguageModel) -> DataFrame:
    """``vault, path, lang_pred, score`` of every note, from its whole text.

    The family is chosen first and the language within it; ``score`` (0 to 1) is
    the product of both chances.  A NULL or empty text, one without any letter, and
    every text under a model without languages is ``und`` with score 0.
    Repeated rows each get their row; an empty table gives no rows.
    """
    shared = notes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, most=1 << 20):
            names, scores = shared.value.predict(features(*common.utf8(batch.column(2))))
            letters = batch.column(3).to_pylist()
            names = [n if has else UNDETERMINED for n, has in zip(names, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, scores, 0.0), pa.float64())],
                names=["vault", "path", "lang_pred", "score"],
            )

    return (
        common.keyed(notes)
        .withColumn("letters", F.col("content").rlike(r"\p{L}"))
        .mapInArrow(common.lean(run), "vault string, path string, lang_pred string, score double")
    )
