"""Language identification by hierarchical discrimination.

The language family is predicted first, by one-versus-one linear support vector machines
between families; then one-versus-one machines separate the languages of that family.
Features are hashed character n-grams of the lowered letters, everything else a space.

Each machine is trained in a task of its own on at most `per_language` documents of each
language, the lowest by a seeded hash. The machines are few (languages squared at most)
and of one width, so they travel with the scoring function. Every whole text is scored.

A null text, or one without a letter, is `und` with score 0. Null ids, languages and
sources are allowed; a null language is not learned from. Without a learnable language
every text is `und`. Other columns of the input are not read.
"""

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.llm.grams import code_points, gram_vector, is_letter, train_svm
from quiltframe.llm.sample import among_lowest
from quiltframe.operators.scratch import store

# Families of ISO 639-1 codes. Other languages are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
PER_LANGUAGE = 800
UNKNOWN = "und"
STEEPNESS = 3.0


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), "of " + lang)


def held_out(id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % parts == part


def _features(text: str | None) -> np.ndarray | None:
    codes = code_points((text or "").lower())
    letters = is_letter(codes)
    return gram_vector(np.where(letters, codes, np.uint32(32))) if letters.any() else None


def _nodes(languages: list[str]) -> dict[str, list[list[str]]]:
    """Per name of a choice its options, each a list of languages."""
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family(lang), []).append(lang)
    nodes = {"": [families[f] for f in sorted(families)]}
    return nodes | {f: [[x] for x in families[f]] for f in sorted(families)}


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          learn: Column | None = None, per_language: int = PER_LANGUAGE, seed: int = 11) -> dict:
    """{"nodes", "machines"}: machines[node][i, j] has weights that are positive for option i."""
    rows = docs.select(col(text).alias("text"), col(lang).alias("lang"),
                       F.xxhash64(F.lit(seed), col(id).cast("string"), F.sha2(col(text), 256)).alias("draw"),
                       (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("draw")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    low = F.lit(False)
    for lang_, n in counts:
        low = F.when(F.col("lang") == lang_, among_lowest(F.col("draw"), per_language, n)).otherwise(low)
    sample = rows.where(low).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(v, y) for v, y in zip(map(_features, batch["text"]), batch["lang"]) if v is not None]
            yield pd.DataFrame({"lang": [y for _, y in found], "x": [v.tobytes() for v, _ in found]})

    known = store(sample.select("text", "lang").mapInPandas(vectors, "lang string, x binary"))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())  # one row per language
    nodes = _nodes(languages)
    jobs = [(json.dumps([node, i, j]), lang, i_side)
            for node, options in nodes.items() for i in range(len(options)) for j in range(i)
            for i_side, side in ((True, options[i]), (False, options[j])) for lang in side]
    if not jobs:
        return {"nodes": nodes, "machines": {}}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "x"])
        x = np.stack([np.frombuffer(b, dtype=np.float32) for b in group["x"]])
        w = train_svm(x, group["side"].to_numpy(dtype=bool)).astype(np.float32)
        return pd.DataFrame({"job": group["job"].iloc[:1], "w": [w.tobytes()]})

    table = F.broadcast(docs.sparkSession.createDataFrame(jobs, "job string, lang string, side boolean"))
    fitted = known.join(table, "lang").groupBy("job").applyInPandas(fit, "job string, w binary")
    machines = {tuple(json.loads(r.job)): np.frombuffer(bytes(r.w), dtype=np.float32) for r in fitted.collect()}
    return {"nodes": nodes, "machines": machines}


def _choose(model: dict, node: str, x: np.ndarray) -> tuple[int, float]:
    """The option with most votes, larger margins first on ties, and its likelihood."""
    votes, margins = Counter(), Counter()
    worst: dict[int, float] = {}
    for i in range(len(model["nodes"][node])):
        votes[i] += 0
        for j in range(i):
            w = model["machines"][(node, i, j)]
            margin = float(x @ w[:-1] + w[-1])
            votes[i if margin > 0 else j] += 1
            for k, m in ((i, margin), (j, -margin)):
                margins[k] += m
                worst[k] = min(worst.get(k, m), m)
    best = max(votes, key=lambda k: (votes[k], margins[k], -k))
    return best, 1 / (1 + np.exp(-STEEPNESS * worst[best])) if worst else 1.0


def classify(model: dict, text: str | None) -> tuple[str, float]:
    x = _features(text)
    if x is None or not model["nodes"][""]:
        return UNKNOWN, 0.0
    chosen, likely = _choose(model, "", x)
    languages = model["nodes"][""][chosen]
    inner, more = _choose(model, family(languages[0]), x)
    return languages[inner], float(likely * more)


def identify(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) and a struct `kept` of the named columns, for every row."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(model, t) for t in texts], columns=["lang_pred", "score"])

    kept = [F.struct(*[col(k) for k in keep]).alias("kept")] if keep else []
    rows = docs.select(col(id).alias("id"), predict(col(text)).alias("p"), *kept)
    return rows.select("id", "p.lang_pred", "p.score", *(["kept"] if keep else []))
