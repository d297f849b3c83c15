"""Quality without labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed
linear scorer trained on the posterior labels.

Each labeller says good (1), poor (-1) or nothing (0).  The counts of the vote patterns over the whole corpus, a table
of at most 3^8 rows, are all that EM needs: it fits a share of good texts and, for each labeller and class, the chances
of its three votes.  A bounded sample of texts with posterior labels then trains a logistic scorer over hashed byte
bigrams and the measures behind the votes, and that scorer rates every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, text_of

#: Rows that the scorer is fitted on, about at most (those whose texts have the smallest hashes).
BOUND = 4000
HASHED, THRESHOLD = 1024, 0.5
STOP = re.compile(r"[.!?]+(?=\s|$)")
_ODD = np.zeros(256)
_ODD[[ord(c) for c in "#$%&*|~^<>{}[]\\=_@+"]] = 1
_BANG = np.zeros(256)
_BANG[[ord(c) for c in "!?"]] = 1

#: (name, measure, poor below, good from, good to, poor above); between the limits a labeller says nothing.
LABELLERS = (
    ("symbols", "odd", -1, -1, 0.004, 0.03),
    ("shouting", "upper", -1, -1, 0.12, 0.3),
    ("repeats", "repeat", -1, -1, 0.1, 0.3),
    ("marks", "bang", -1, -1, 0.05, 0.3),
    ("bars", "lone", -1, -1, 0.02, 0.15),
    ("sentences", "sentence", 1.5, 3, 45, 90),
    ("common", "short", 0.05, 0.2, 0.75, 0.95),
    ("length", "words", 2, 20, 1e12, 1e12),
)
MEASURES = ("odd", "upper", "repeat", "bang", "lone", "sentence", "short", "words", "mean", "lines")


def measures(text: str) -> dict[str, float]:
    """Shares and sizes of one whole text; an empty text has zeros."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    words = text.split()
    n = len(words)
    total = max(1, int(raw.sum()))
    upper = int(raw[65:91].sum())
    letters = upper + int(raw[97:123].sum())
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    return {
        "odd": float(raw @ _ODD) / total,
        "upper": upper / max(1, letters),
        "repeat": 1 - triples / (n - 2) if n > 2 else 0.0,
        "bang": float(raw @ _BANG) / max(1, n),
        "lone": sum([len(w) == 1 and not w.isalnum() for w in words]) / max(1, n),
        "sentence": n / max(1, len(STOP.findall(text))),
        "short": sum([len(w) <= 3 for w in words]) / max(1, n),
        "words": float(n),
        "mean": total / max(1, n),
        "lines": len(set(lines)) / max(1, len(lines)),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    out = []
    for labeller, name, low, good, to, high in LABELLERS:
        v = m[name]
        if m["words"] < 20 and labeller in ("common", "sentences", "shouting"):  # too few words to tell
            out.append(0)
            continue
        out.append(-1 if v < low or v > high else 1 if good <= v <= to else 0)
    return tuple(out)


#: Before the data are seen, a labeller is held to say poor of this share of good texts, with the weight of so many texts
#: for each text of the corpus.  Kinds of poor texts hardly overlap, so with no such weight the likeliest two classes are
#: one such kind against all the rest.
FALSE_ALARMS, WEIGHT = 0.002, 4.0


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 500) -> tuple[float, np.ndarray]:
    """EM over vote patterns: (share of good texts, chances [class, labeller, vote + 1]).

    A vote for poor names a defect, anything else says only that this defect is not seen: what EM estimates for each
    labeller is its false alarms (with a beta prior of mean FALSE_ALARMS) and the share of poor texts it finds; good
    votes and silence share the rest in the proportion they have in the corpus.  Without patterns the start is
    returned."""
    k = len(LABELLERS)
    share, alarm, finds = 0.9, np.full(k, FALSE_ALARMS), np.full(k, 0.25)
    keys = sorted(patterns)
    v = np.array(keys).reshape(-1, k) + 1
    n = np.array([patterns[x] for x in keys], float)
    says_good = np.array([(n * (v[:, j] == 2)).sum() + 1 for j in range(k)]) / np.array([(n * (v[:, j] > 0)).sum() + 2 for j in range(k)])
    chance = np.zeros((2, k, 3))
    for _ in range(rounds):
        for c, poor in ((0, finds), (1, alarm)):
            chance[c] = np.stack([poor, (1 - poor) * (1 - says_good), (1 - poor) * says_good], axis=1)
        if not patterns:
            break
        post = posterior(v, share, chance)
        cries, prior = v == 0, WEIGHT * n.sum() + 100
        alarm = (((n * post)[:, None] * cries).sum(axis=0) + prior * FALSE_ALARMS) / ((n * post).sum() + prior)
        finds = (((n * (1 - post))[:, None] * cries).sum(axis=0) + 0.5) / ((n * (1 - post)).sum() + 2)
        new = float((n * post).sum() + 9) / (n.sum() + 10)
        moved, share = abs(new - share), new
        if moved < 1e-9:
            break
    return share, chance


def posterior(v: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """The chance of good for rows of votes (each + 1)."""
    logs = np.log(chance)
    at = np.arange(v.shape[1])
    gap = np.log(share) - np.log(1 - share) + (logs[1][at, v] - logs[0][at, v]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(gap, -30, 30)))


def features(text: str, m: dict[str, float]) -> np.ndarray:
    """Hashed byte bigrams as shares (square roots), then the measures on even scales, then 1."""
    b = np.frombuffer(text.encode("utf-8", "replace"), "u1").astype("u4")
    counts = np.zeros(HASHED)
    for s in range(0, max(0, len(b) - 1), 1 << 20):
        x = b[s : s + (1 << 20) + 1]
        counts += np.bincount(((x[:-1] * 257 + x[1:]) * np.uint32(2654435761)) >> np.uint32(22), minlength=HASHED)
    scaled = [np.sqrt(m["odd"]), m["upper"], m["repeat"], min(1.0, m["bang"]), m["lone"], min(5.0, np.log1p(m["sentence"])) / 5, m["short"], min(9.0, np.log1p(m["words"])) / 9, min(5.0, np.log1p(m["mean"])) / 5, m["lines"]]
    return np.concatenate((np.sqrt(counts / max(1, len(b) - 1)), scaled, [1.0]))


def fit(docs: DataFrame, bound: int = BOUND, text_col: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    """(share, chances, weights): EM over the votes of all rows, then the scorer over a bounded sample.

    A null text counts as an empty one; repeated rows vote each, but are one text to the scorer.  Other columns are
    ignored.  An empty table gives the start of EM and weights of zero."""
    small_batches(docs.sparkSession)

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join("-0+"[x + 1] for x in votes(measures(t))) for t in batch.column(0).to_pylist()], pa.string())], names=["votes"])

    texts = docs.select(text_of(text_col).alias("t"))
    counted = texts.mapInArrow(vote, "votes string").groupBy("votes").count().collect()  # 3^8 rows at most
    share, chance = estimate({tuple("-0+".index(c) - 1 for c in r["votes"]): r["count"] for r in counted})
    n = sum(r["count"] for r in counted)
    size = len(MEASURES) + HASHED + 1
    if not n:
        return share, chance, np.zeros(size)

    def sample(batches):
        for batch in batches:
            rows, post = [], []
            for t in batch.column(0).to_pylist():
                m = measures(t)
                rows.append(features(t, m).astype("f4").tobytes())
                post.append(float(posterior(np.array([votes(m)]) + 1, share, chance)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(post, pa.float64())], names=["x", "y"])

    # copies of one text share its hash, so they count once: no text fills the sample.  About ``bound`` rows, whatever n
    part = F.shiftrightunsigned(F.xxhash64("t"), 2) < F.lit(min((1 << 62) - 1, ((1 << 62) * bound) // n))
    got = sorted((r["x"], r["y"]) for r in texts.filter(part).distinct().mapInArrow(sample, "x binary, y double").collect())
    if not got:
        return share, chance, np.zeros(size)
    x = np.frombuffer(b"".join(g[0] for g in got), "f4").reshape(len(got), -1).astype(float)
    y = np.array([g[1] for g in got])
    w = np.zeros(size)
    rate, ridge = 4 / (1 + (x * x).sum(axis=1).max()), 1e-5
    speed = np.zeros(size)
    for _ in range(1500):  # gradient steps with momentum over the whole sample
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.95 * speed - rate * (x.T @ (p - y) / len(y) + ridge * w)
        w = w + speed
    return share, chance, w


def rate_texts(docs: DataFrame, weights: np.ndarray, text_col: str = "text", column: str = "quality") -> DataFrame:
    """All columns of ``docs`` and the score, 0 (poor) to 1 (good), of every whole text; null counts as empty.  A
    column with the name of the score is replaced; repeated rows are rated each; an empty table gives an empty one."""
    kept = [c for c in docs.columns if c != column]
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = [features(t, measures(t)) @ weights for t in batch.column(batch.num_columns - 1).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(x, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("_score", pa.float64())]))

    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], text_of(text_col).alias("_t"))
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["_score double"])
    return renamed.mapInArrow(run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], F.col("_score").alias(column))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, _, weights = fit(docs)
    rated = rate_texts(docs, weights, column="score")
    return rated.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
