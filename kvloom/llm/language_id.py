"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character n-grams. Each language has several centroids, found
by clustering its vectors in a bounded labelled sample; a text gets the language of the nearest one by cosine.
A text is rejected if no language is likely: the mean over its n-grams of log(their share in the language's learnt
rows / an even share) is below `reject` times what nearly all learnt rows of that language reach. Unlike the cosine,
which fills up as a text gets longer, that mean doesn't depend on length; it only varies more in short texts, which
are allowed its standard error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from kvloom.llm.common import blocks, forget, parts, scratch, stored

#: Features, n-gram lengths, labelled rows of each language that are learnt from at most, centroids a language.
FEATURES, GRAMS, SAMPLE, CENTROIDS = 4096, (1, 2, 3, 4), 600, 4
#: A text is rejected if its mean log ratio is below this part of the LOW quantile of the learnt rows', in each language.
REJECT, LOW = 0.25, 0.01
_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def vectors(texts: list[str]):
    """Counts of n-grams, (index of the first text, matrix): letters lower-cased, all else one space."""
    raw = [b" %b " % t.lower().encode("utf-8", "surrogatepass") for t in texts]
    for first, part in blocks(raw, 1 << 19):
        for start in range(0, len(part), 256):
            some = part[start : start + 256]
            buf = _KEPT[np.frombuffer(b"".join(some), np.uint8)]
            doc = np.repeat(np.arange(len(some)), [len(t) for t in some])
            keep = np.append(True, (buf[1:] != 32) | (buf[:-1] != 32) | (doc[1:] != doc[:-1]))
            buf, doc = buf[keep].astype(np.uint64), doc[keep]
            out = np.zeros(len(some) * FEATURES, np.float32)
            for n in GRAMS:
                if len(buf) < n:
                    continue
                code = np.full(len(buf) - n + 1, n, np.uint64)
                for j in range(n):
                    code = code * np.uint64(0x100000001B3) + buf[j : j + len(code)]
                same = doc[: len(code)] == doc[n - 1 :]
                slot = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(FEATURES)
                out += np.bincount(doc[: len(code)][same] * FEATURES + slot[same].astype(np.int64), minlength=len(out)).astype(np.float32)
            yield first + start, out.reshape(len(some), FEATURES)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def mean_ratios(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams, in each language if ratios has a row for each."""
    total = np.maximum(counts.sum(1), 1)
    return ((counts @ ratios.T).T / total).T


def unlikely(counts: np.ndarray, model: dict, reject: float) -> np.ndarray:
    """Whether each text's mean log ratio is too low in every language."""
    # the n-grams of all lengths that start at one place count as one draw
    places = np.maximum(counts.sum(1, keepdims=True) / len(GRAMS), 1)
    return (mean_ratios(counts, model["ratios"]) < reject * model["floor"] - model["spread"] / np.sqrt(places)).all(1)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means; starts: the mean row, then always the farthest one."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = unit(np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4: never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model of at most `sample` labelled rows a language that aren't held out, those of smallest hashed id.

    Reads only text and lang. Each language's share is found from its count, so about 2 * sample rows reach the
    ranking; each language's rows are clustered in one task, and the driver collects what is learnt of it: CENTROIDS
    + 2 rows of FEATURES numbers. None if nothing is labelled.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample / n))])
    near = known.where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) <= part[F.col("lang")])

    def counted(batches):
        forget()
        for b in parts(batches):
            lang, h, ids = (b.column(i).to_pylist() for i in (1, 2, 3))
            for first, m in vectors([t or "" for t in b.column(0).to_pylist()]):
                n = len(m)
                yield pa.RecordBatch.from_arrays([pa.array(lang[first : first + n]), pa.array(h[first : first + n]), pa.array(ids[first : first + n], pa.int64()), pa.array([zlib.compress(r.tobytes(), 1) for r in m], pa.binary())], names=["lang", "h", "doc_id", "v"])

    order = Window.partitionBy("lang").orderBy("h", F.col("doc_id").isNull(), "doc_id")
    picked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("text", "lang", "h", "doc_id")
    rows = stored(picked.mapInArrow(counted, "lang string, h long, doc_id long, v binary"), scratch(docs.sparkSession, "language_rows"))

    def matrix(pdf):
        return np.stack([np.frombuffer(zlib.decompress(v), np.float32) for v in pdf.sort_values(["h", "doc_id"])["v"]])

    def frequencies(pdf):
        import pandas as pd

        m = matrix(pdf)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(m)], "df": [(m > 0).sum(0).astype(np.int64).tobytes()]})

    seen = rows.groupBy("lang").applyInPandas(frequencies, "lang string, n long, df binary").collect()
    df = np.sum([np.frombuffer(r["df"], np.int64) for r in seen], axis=0)
    idf = np.log((1 + sum(r["n"] for r in seen)) / (1 + df)).astype(np.float32) + 1

    def learnt(pdf):
        import pandas as pd

        counts = matrix(pdf).astype(np.float64)
        centroids = clustered(unit(np.log1p(counts) * idf), CENTROIDS).astype(np.float32)
        ratios = np.log((counts.sum(0) + 0.5) / (counts.sum() / FEATURES + 0.5)).astype(np.float32)
        floor = float(np.quantile(mean_ratios(counts, ratios), LOW))
        spread = float(np.sqrt(np.cov(ratios, aweights=counts.sum(0), ddof=0)))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [centroids.tobytes()], "ratios": [ratios.tobytes()], "floor": [floor], "spread": [spread]})

    per = sorted(rows.groupBy("lang").applyInPandas(learnt, "lang string, centroids binary, ratios binary, floor double, spread double").collect(), key=lambda r: r["lang"])
    centroids = [np.frombuffer(r["centroids"], np.float32).reshape(-1, FEATURES) for r in per]
    numbers = {c: np.array([r[c] for r in per]) for c in ("floor", "spread")}
    return {"langs": [r["lang"] for r in per], "idf": idf, "centroids": np.concatenate(centroids), "owner": np.repeat(np.arange(len(per)), [len(c) for c in centroids]), "ratios": np.stack([np.frombuffer(r["ratios"], np.float32) for r in per])} | numbers


def identify(docs: DataFrame, model: dict | None, reject: float = REJECT) -> DataFrame:
    """docs with held_out, lang_pred, score (cosine, 0 to 1) and rejected added, replacing columns of these names.

    Only text is an input of a prediction. lang_pred is `und`, score 0 and rejected true where text is null or
    has no letter, and for all rows if there is no model. Needs columns doc_id and text.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, rejected boolean"
    base = docs.drop("held_out", "lang_pred", "score", "rejected")
    at = base.columns.index("text")

    def run(batches):
        m = known.value
        forget()
        for batch in parts(batches):
            texts = batch.column(at).to_pylist()
            pred, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if m:
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                for first, counts in vectors([texts[i] for i in some]):
                    cos = unit(np.log1p(counts) * m["idf"]) @ m["centroids"].T
                    best = cos.argmax(1)
                    far = unlikely(counts, m, reject)
                    for j, b in enumerate(best.tolist()):
                        i, k = some[first + j], m["owner"][b]
                        pred[i], score[i] = m["langs"][k], float(min(1.0, max(0.0, cos[j, b])))
                        rejected[i] = bool(far[j])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(rejected)], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import StructType

    schema = StructType(base.schema.fields + StructType.fromDDL(fields).fields)
    return base.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
