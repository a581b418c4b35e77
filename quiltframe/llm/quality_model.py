"""Quality without labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

Labellers vote good (1), bad (0) or abstain (-1) on every whole text, as expressions. Only
the counts of vote patterns over all documents leave Spark (3 to the number of labellers
at most); on them EM estimates the share of good documents and each labeller's vote
probabilities. The posterior of a pattern is the weak label of its documents, also where no
document learned from has that pattern. A logistic
model over hashed character n-grams learns the weak labels of at most `sample` documents,
the lowest by a seeded hash, and then scores every whole text.

Null and empty texts count as texts of no words: every labeller that needs words abstains.
Their score comes from the same model. An empty table gives an empty result. Repeated rows
get equal scores. Other columns of the input are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.llm.grams import code_points, gram_vector, train_logistic
from quiltframe.llm.sample import among_lowest

SAMPLE = 4000
ABSTAIN = -1


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), ABSTAIN).when(bad, 0).when(good, 1).otherwise(ABSTAIN).cast("int")


LABELLERS = ("symbols", "upper", "ended", "distinct", "length", "repeated")


def voted(rows: DataFrame) -> DataFrame:
    """Replace the column `text`, never null, by the labellers' `votes` and itself.

    Shares are of characters, lines or words; a labeller abstains where there are none.
    """
    text = F.col("text")
    words, lines = F.split(text, "\\s+"), F.split(text, "\\s*\\n\\s*")
    # Each measure is computed once; the votes compare it several times.
    measured = rows.withColumns({
        "_chars": F.length(text),
        "_symbols": F.length(F.regexp_replace(text, "[\\p{L}\\p{N}\\s]+", "")),
        "_upper": F.length(F.regexp_replace(text, "\\P{Lu}+", "")),
        "_ended": F.regexp_count(text, F.lit("[.!?][^\\S\\n]*(\\n|$)")),
        "_lines": F.size(F.filter(lines, lambda x: F.length(x) > 0)),
        "_words": F.size(words),
        "_kinds": F.size(F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))),
        "_parts": F.size(lines),
        "_copies": F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))),
    })
    chars, lines = F.nullif(F.col("_chars"), F.lit(0)), F.nullif(F.col("_lines"), F.lit(0))
    shares = measured.withColumns({
        "_symbols": F.col("_symbols") / chars, "_upper": F.col("_upper") / chars,
        "_ended": F.col("_ended") / lines, "_length": F.when(F.col("_chars") > 0, F.col("_chars") / F.col("_words")),
        "_distinct": F.when(F.col("_words") >= 20, F.col("_kinds") / F.col("_words")),
        "_repeated": F.when(F.col("_parts") >= 3, F.col("_copies") / F.col("_parts")),
    })
    v = {n: F.col("_" + n) for n in LABELLERS}
    return shares.select(*rows.columns, F.array(
        _vote(v["symbols"], v["symbols"] > 0.06, v["symbols"] < 0.045),
        _vote(v["upper"], v["upper"] > 0.1, v["upper"] < 0.06),
        _vote(v["ended"], v["ended"] < 0.8, v["ended"] >= 0.95),
        _vote(v["distinct"], v["distinct"] < 0.3, v["distinct"] > 0.5),
        _vote(v["length"], (v["length"] < 4.5) | (v["length"] > 7.2), (v["length"] > 5.2) & (v["length"] < 6.8)),
        _vote(v["repeated"], v["repeated"] > 0.3, v["repeated"] < 0.1)).alias("votes"))


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, P(vote | class) as [labeller, class, vote], and posteriors of the patterns.

    Votes are taken as independent given the class, abstaining as no evidence; the start is the
    majority of votes.
    """
    good = np.clip(((patterns == 1).sum(1) + 0.5) / ((patterns >= 0).sum(1) + 1.0), 0.05, 0.95)
    for _ in range(steps):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        tables = np.stack([[[(w * (patterns[:, k] == v)).sum() + 0.1 for v in (0, 1)] for w in weight]
                           for k in range(patterns.shape[1])])
        tables /= tables.sum(axis=2, keepdims=True)
        logs = np.log([[1 - share], [share]]) + sum(
            np.where(patterns[:, k] >= 0, np.log(tables[k][:, np.maximum(patterns[:, k], 0)]), 0.0)
            for k in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return share, tables, good


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
          seed: int = 5) -> dict:
    """{"share", "tables", "accuracy", "posterior", "weights"}."""
    rows = voted(docs.select(F.coalesce(col(text), F.lit("")).alias("text"), col(id).cast("string").alias("id")))
    counted = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3**6 patterns at most
    if not counted:
        return {"share": 0.5, "tables": None, "accuracy": {}, "posterior": {}, "weights": None}
    counted = sorted((tuple(r.votes), r.n) for r in counted)
    patterns = np.array([p for p, _ in counted])
    share, tables, good = estimate(patterns, np.array([n for _, n in counted], dtype=float))
    posterior = {p: float(g) for (p, _), g in zip(counted, good)}
    accuracy = {n: {"good": tables[k, 1, 1], "bad": tables[k, 0, 0]} for k, n in enumerate(LABELLERS)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "x": [gram_vector(code_points(t)).tobytes() for t in batch["text"]],
                "y": [posterior[tuple(v)] for v in batch["votes"]], "draw": batch["draw"]})

    draw = F.xxhash64(F.lit(seed), "id", F.sha2("text", 256))
    total = int(sum(n for _, n in counted))
    chosen = rows.withColumn("draw", draw).where(among_lowest(F.col("draw"), sample, total)).orderBy(
        "draw").limit(sample)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "x"])
        x = np.stack([np.frombuffer(b, dtype=np.float32) for b in group["x"]])
        w = train_logistic(x, group["y"].to_numpy()).astype(np.float32)
        return pd.DataFrame({"w": [w.tobytes()]})

    known = chosen.mapInPandas(vectors, "x binary, y double, draw bigint")
    weights = known.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "w binary").first()
    return {"share": share, "tables": tables, "accuracy": accuracy, "posterior": posterior,
            "weights": np.frombuffer(bytes(weights.w), dtype=np.float32)}


def weak_label(votes: Column, share: float, tables: np.ndarray) -> Column:
    """The posterior of any votes under the fitted probabilities."""
    logit = F.lit(float(np.log(share / (1 - share))))
    for k, (bad, good) in enumerate(tables):
        against, for_ = (float(x) for x in np.log(good / bad))
        vote = votes[k]
        logit = logit + F.when(vote == 1, for_).when(vote == 0, against).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted, weak_label): the scorer's and the labellers' probability of a good text."""
    weights = model["weights"]

    @F.pandas_udf("double")
    def linear(texts: pd.Series) -> pd.Series:
        return pd.Series([float(gram_vector(code_points(t)) @ weights[:-1] + weights[-1]) for t in texts],
                         dtype="float64")

    rows = docs.select(col(id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    if weights is None:
        return rows.select(F.col("id").alias(id), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"),
                           F.lit(0.5).alias("weak_label"))
    rows = voted(rows).select("id", linear("text").alias("margin"),
                              weak_label(F.col("votes"), model["share"], model["tables"]).alias("weak_label"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    return rows.select(F.col("id").alias(id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                       "weak_label")
