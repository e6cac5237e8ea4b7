"""Language identification by nearest centroid: TF-IDF vectors of byte n-grams, several clustered centroids per language, rejection by distance.

Document frequencies are counted over all training rows with a letter. Centroids are clustered from a bounded
sample of labelled rows, at most SAMPLE_ROWS in all, taken by least hash of id and text in each language. A text is rejected
if its cosine to the nearest centroid is lower than nearly all labelled texts with about as many different
n-grams have. Not its length: a long text that repeats a few words has a low cosine in any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_column, arrow_schema, fresh, lean, small_table, text_bytes

DIMS = 4096
NGRAMS = (1, 2, 3, 4)
SAMPLE_ROWS = 2400
CENTROIDS = 3
#: A cluster of a smaller share of its language's rows gives no centroid.
LEAST_SHARE = 0.05
#: A cutoff is MARGIN times the cosine below which a share of ODD of the band's labelled rows lies, but not under FLOOR
#: times their median; bands of fewer than BAND_ROWS rows borrow their neighbours', without a floor beyond the next.
ODD, MARGIN, FLOOR, BAND_ROWS = 0.005, 0.9, 0.65, 50
BANDS = 25
SHORT = 8
BINS = 512
_LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of the lower-cased text, whose ASCII non-letters are spaces."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(DIMS)
    key = np.zeros(len(b), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(b) < n:
            break
        key = key[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in NGRAMS:
            mixed = key * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out += np.bincount(mixed >> np.uint32(20), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, one row per text; a text without n-grams is all zeros."""
    rows = np.stack([np.log1p(counts(t)) for t in texts]) * idf if texts else np.zeros((0, DIMS))
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0).astype(np.float32)


def _bands(rows: np.ndarray) -> np.ndarray:
    """The band of each vector: half octaves of its number of different n-grams."""
    return np.ceil(2 * np.log2(np.maximum((rows > 0).sum(1), 1))).astype(int)


def cutoffs(seen: np.ndarray) -> np.ndarray:
    """The least cosine of each band that is not rejected, of counts of labelled rows by band and cosine in BINS steps.

    Below the bands that have rows the cosine is taken to fall as the square root of the number of n-grams.
    """
    known = np.flatnonzero(seen.sum(1))
    if not len(known):
        return np.zeros(BANDS)
    out = []
    for band in known:
        pooled = np.zeros(seen.shape[1], np.int64)
        for far in range(BANDS):
            for b in {band - far, band + far}:
                if 0 <= b < BANDS:
                    pooled += seen[b]
            if pooled.sum() >= BAND_ROWS:
                break
        upto = pooled.cumsum()
        low, middle = ((upto > share * upto[-1]).argmax() / BINS for share in (ODD, 0.5))
        out.append(max(MARGIN * low, FLOOR * middle if far < 2 else 0.0))
    at = np.arange(BANDS)
    return np.interp(at, known, out) * 2.0 ** (np.minimum(at - known[0], 0) / 4)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least_cosine: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine to its nearest centroid in 0..1, and whether that is too far off."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = vectors(texts, self.idf)
        near, bands = rows @ self.centroids.T, _bands(rows)
        best = near.argmax(1) if len(texts) else []
        labels, scores, rejected = [], [], []
        for i, text in enumerate(texts):
            if not has_letter(text):
                labels.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            cosine = float(min(1.0, max(0.0, near[i, best[i]])))
            labels.append(self.languages[best[i]])
            scores.append(cosine)
            # too short a text can't be told from one in another language
            rejected.append(len(text.encode("utf-8", "replace")) >= SHORT and cosine < self.least_cosine[bands[i]])
        return labels, scores, rejected


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from the mean's nearest row and then rows far from those chosen, short of the farthest few.

    Clusters of a single row or less than LEAST_SHARE of the rows are left out: they are odd rows, not a kind of text.
    """
    mean = rows.mean(0)
    chosen = [int((rows @ mean).argmax())]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ rows[chosen].T).max(1)
        chosen.append(int(nearest.argsort(kind="stable")[int(LEAST_SHARE * len(rows))]))
    centres = rows[chosen].copy()
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (owner == c).any():
                centres[c] = rows[owner == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    held = np.bincount((rows @ centres.T).argmax(1), minlength=len(centres))
    # the mean of all is a centroid too, so that a cluster of odd rows does not cost the others theirs
    whole = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return np.vstack([centres[held >= max(2, LEAST_SHARE * len(rows))], whole])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from all rows of labelled with a language: document frequencies and cutoffs from each, centroids from a sample.

    At most sample_rows rows are sampled, equally many per language, by the hash of their ids and texts; rows
    alike in both are taken once. Of more than sample_rows languages the most frequent sample_rows are learned.
    Null and letterless texts are not learned from.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df_schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType())])
    to = arrow_schema(df_schema)

    @lean
    def frequencies(batches):
        total, seen = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for text in text_bytes(b, "text"):
                if has_letter(text := text.decode("utf-8", "replace")):
                    total += counts(text) > 0
                    seen += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)), pa.array(np.concatenate([[seen], total]))], schema=to)

    # DIMS + 1 rows and one row per language come to the driver, whatever the corpus
    df = {r["dim"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, df_schema).groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(d, 0) for d in range(DIMS)]))) + 1
    sampled = _sample(rows, sample_rows)
    vec_schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("v", T.BinaryType())])
    vec_to = arrow_schema(vec_schema)

    @lean
    def embed(batches):
        for b in batches:
            kept = [(lang, t) for lang, t in zip(b.column(0).to_pylist(), text_bytes(b, "text"), strict=True) if has_letter(t.decode("utf-8", "replace"))]
            v = vectors([t.decode("utf-8", "replace") for _, t in kept], idf)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([len(t) for _, t in kept], pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], schema=vec_to)

    found = sorted((r["lang"], r["n_bytes"], bytes(r["v"])) for r in sampled.mapInArrow(embed, vec_schema).collect())
    languages, centroids = [], []
    for lang in sorted({r[0] for r in found}):
        own = np.stack([np.frombuffer(v, np.float32) for x, _, v in found if x == lang])
        centres = clustered(own, CENTROIDS)
        languages += [lang] * len(centres)
        centroids.append(centres)
    if not found:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(BANDS))
    centres = np.vstack(centroids).astype(np.float32)
    hit_schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())])
    hit_to = arrow_schema(hit_schema)

    @lean
    def cosines(batches):
        total = np.zeros(BANDS * (BINS + 1), np.int64)
        for b in batches:
            texts = [t for t in (x.decode("utf-8", "replace") for x in text_bytes(b, "text")) if has_letter(t)]
            for k in range(0, len(texts), 128):
                v = vectors(texts[k : k + 128], idf)
                best = np.clip((v @ centres.T).max(1), 0, 1)
                total += np.bincount(_bands(v) * (BINS + 1) + (best * BINS).astype(int), minlength=len(total))
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], schema=hit_to)

    # at most BANDS * (BINS + 1) rows come to the driver
    seen = np.zeros(BANDS * (BINS + 1), np.int64)
    for r in rows.select("text").mapInArrow(cosines, hit_schema).groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r["place"]] = r["n"]
    return Model(idf, centres, languages, cutoffs(seen.reshape(BANDS, BINS + 1)))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(lang, text) of at most `most` of the rows (id, text, lang): of each language those of least hash, equally many."""
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most).collect()  # at most `most` rows
    each = most // max(1, len(per_lang))
    shares = small_table(rows.sparkSession, [(r["lang"], min(1.0, 2 * each / r["n"])) for r in per_lang], "lang string, share double")
    h = F.xxhash64("id", "text")
    unit = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(shares), "lang").filter(unit < F.col("share")).select("lang", "text", h.alias("h"), unit.alias("unit")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "h"))  # some 2 * each rows of a language
    return some.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "text")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected; one narrow pass over whole texts, which go to
    Python while the other columns stay where they are.

    Texts that are null or without letters are 'und', score 0, rejected. New columns whose names are
    taken get leading underscores. With a model of no languages all rows are 'und'.
    """
    names = ("lang_pred", "score", "rejected")
    kinds = (pa.string(), pa.float64(), pa.bool_())

    @arrow_column(T.StructType([T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
            rows = [model.predict(texts[k : k + 128]) for k in range(0, len(texts), 128)]
            yield pa.StructArray.from_arrays([pa.array([x for r in rows for x in r[i]], t) for i, t in enumerate(kinds)], names=names)

    own = fresh(docs, "found")
    return docs.withColumn(own, found(F.col(text_col))).select(*docs.columns, *(F.col(own)[n].alias(fresh(docs, n)) for n in names))
