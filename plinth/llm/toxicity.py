"""A weighted finite-state grammar of abuse, read clause by clause.

The lexicon turns the words of a clause into symbols (insult, harm, intent, target, negation, report, other).  Six
transducers follow, composed into two automata.  Read forwards: an insult transducer, which passes insults on; a threat
transducer, which makes a threat of a harm that follows an intent; and three that mark what follows a target, a negation
or a report.  Read backwards: one that marks what has a target behind it.  So each insult, threat or harm gets a label of
its context.  A clause has, for each label, the weight of its heaviest match; the weights of a text's clauses give its
score.  Insult stems and weights are learned from labelled rows: stems are word beginnings that stand in many unrelated
labelled texts and hardly in clean ones, so inflected forms are found as well.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_mod, read, small_batches, stage_table, text_of

#: Labelled rows of each class that learning uses at most, those with the smallest hashes of their ids.
BOUND = 4000
THRESHOLD = 0.7

SEED_INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "imbecile", "dummkopf", "trottel", "imbécile", "crétin", "estúpido", "pendejo", "trash", "garbage", "clown", "disgusting", "vermin")
HARMS = ("kill", "hurt", "destroy", "murder", "strangle", "töten", "vernichten", "tuer", "détruire", "matar", "destruir")
INTENTS = frozenset("will shall gonna going going i'll we'll werde werden wirst vais allons va voy vamos van".split())
TARGETS = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti he she they them these those people".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't nicht kein keine nie pas jamais sans nunca ni sin".split())
REPORTS = frozenset("said says say told called quoted wrote reported sagte sagt schrieb dit disait dijo dice escribió".split())

CLAUSE = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Kind (insult, threat, harm without intent), target, negation, report.
LABELS = tuple(f"{kind}{t}{n}{r}" for kind in "ivh" for t in "-t" for n in "-n" for r in "-r")
#: A stem stands in SUPPORT families of abusive texts, fewer (4 at least) where there are under 12 times as many.
SHORTEST, LONGEST, SUPPORT, ODDS = 4, 10, 8, 3.0


class Transducer:
    """Deterministic: ``step(state, symbol)`` gives (next state, output symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> tuple:
        """The reachable product automaton over ``symbols``, states numbered from the start at 0."""
        number, todo, arcs = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                nxt, out = self.step(state, symbol)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                arcs[number[state], symbol] = (number[nxt], out)
        return arcs


def _near(symbol: str, mark: str, reach: int) -> Transducer:
    """Marks insults, threats and harms that follow ``symbol`` within ``reach`` words (0: anywhere later in the clause)."""

    def step(left, read_):
        kind = read_[0]
        out = read_ + (mark if left else "-") if kind in "ivh" else read_
        if kind == symbol:
            return (reach or -1), out
        return (left - 1 if left > 0 else left), out

    return Transducer(0, step)


def _insults() -> Transducer:
    """Insults pass; what the lexicon calls an insult right after an intent is still one."""
    return Transducer(0, lambda state, symbol: (state, symbol))


def _threats(reach: int = 4) -> Transducer:
    """A harm within ``reach`` words of an intent is a threat; intents are no longer told from other words."""

    def step(left, symbol):
        if symbol == "w":
            return reach, "o"
        return max(0, left - 1), "v" if symbol == "h" and left else symbol

    return Transducer(0, step)


SYMBOLS = "ihwtnro"


def grammar() -> tuple[dict, dict]:
    """(state, symbol) -> (state, output) of the composed automata, read forwards and backwards."""
    forwards = _insults().then(_threats()).then(_near("t", "t", 5)).then(_near("n", "n", 3)).then(_near("r", "r", 0))
    return forwards.table(SYMBOLS), _near("t", "t", 3).table(SYMBOLS)


def labels_of(symbols: str, forwards: dict, backwards: dict) -> list[str | None]:
    """The label of each symbol of a clause, None where it is no insult, threat or harm."""
    out: list = []
    state = 0
    for s in symbols:
        state, label = forwards[state, s]
        out.append(label if s in "ih" else None)
    state = 0
    for k in range(len(symbols) - 1, -1, -1):
        state, behind = backwards[state, symbols[k]]
        if out[k] and behind[1:] == "t":
            out[k] = out[k][0] + "t" + out[k][2:]
    return out


class Reader:
    """Applies the lexicon and the composed grammar to texts."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems, (self.forwards, self.backwards) = stems, grammar()
        self.sizes = sorted({len(s) for s in stems})
        self.place = {label: i for i, label in enumerate(LABELS)}
        self.find = ahocorasick.Automaton()
        for s in (*stems, *HARMS):
            self.find.add_word(s, s)
        if len(self.find):
            self.find.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        for k in self.sizes:
            if k <= len(word) and word[:k] in self.stems:
                return "i", self.stems[word[:k]]
        if word.startswith(HARMS):
            return "h", ODDS
        return ("w" if word in INTENTS else "t" if word in TARGETS else "n" if word in NEGATIONS else "r" if word in REPORTS else "o"), 0.0

    def features(self, text: str) -> np.ndarray:
        """For each label log(1 + the weights of its clauses), a clause weighing what its heaviest match does."""
        out = np.zeros(len(LABELS))
        low = text.lower()
        done = -1
        for end, _ in self.find.iter(low) if len(self.find) else ():
            if end <= done:
                continue
            lo = max(low.rfind(c, 0, end) for c in ".!?;\n") + 1
            m = CLAUSE.search(low, end)
            done = hi = m.start() if m else len(low)
            found = [self.symbol(w) for w in WORD.findall(low, lo, hi)]
            heaviest: dict[str, float] = {}
            for label, (_, weight) in zip(labels_of("".join(s for s, _ in found), self.forwards, self.backwards), found, strict=True):
                if label:
                    heaviest[label] = max(weight, heaviest.get(label, 0.0))
            for label, weight in heaviest.items():
                out[self.place[label]] += weight
        return np.log1p(out)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton steps for a logistic regression whose weights are drawn towards ``prior`` (the last column is 1)."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, family, text) of the bounded sample; a family is the MinHash of a whole text's word triples, so near
    copies mostly are one."""
    spark = docs.sparkSession
    ids = []
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(fold_mod(F.col("id"), 3) != 1)
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    for toxic, size in sizes.items():
        near = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.1 * bound / size))
        rows = usable.filter(F.col("toxic") == toxic).filter(near).select("id", F.xxhash64("id").alias("h")).collect()  # about 1.1 * bound rows
        ids += [(r["id"], toxic) for r in sorted(rows, key=lambda r: (r["h"] % (1 << 30), r["id"]))[:bound]]
    chosen = spark.createDataFrame(sorted(set(ids)) or [(0, 0)], "id long, toxic int").limit(len(ids))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).join(F.broadcast(chosen), "id")

    def families(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_family(t) for t in batch.column(1).to_pylist()], pa.int64()), batch.column(1)], names=["toxic", "family", "t"])

    return rows.select("toxic", "t").mapInArrow(families, "toxic int, family long, t string")


def _family(text: str) -> int:
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def learn(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Stems with their log odds, and the weights of the labels.

    Seed insults count unless one clean text in a hundred holds them.  Without labelled rows of both classes the seeds
    and the prior weights stand alone.  Null texts are empty, labels that are null or of a null id are left out, and rows
    that share an id are learned from each."""
    sample = _labelled(docs, labels, bound, id_col, text_col)
    small_batches(docs.sparkSession)

    def beginnings(batches):
        for batch in batches:
            stems, families = [], []
            for fam, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(t.lower()))
                found = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                stems += found
                families += [fam] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(families, pa.int64())], names=["stem", "family"])

    sample = stage_table(sample, "labelled-texts")
    counts = {
        k: sample.filter(F.col("toxic") == k).select("family", "t").mapInArrow(beginnings, "stem string, family long").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias(f"n{k}"))
        for k in (0, 1)
    }
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("family").alias("n")).collect()}
    least = max(4, min(SUPPORT, total.get(1, 0) // 12))
    frequent = {r["stem"] for r in counts[0].filter(F.col("stem").isin(*SEED_INSULTS) & (F.col("n0") > 0.01 * total.get(0, 0))).collect()}
    stems = {s: ODDS for s in SEED_INSULTS if s not in frequent}
    if total.get(0) and total.get(1):
        clean = F.coalesce("n0", F.lit(0))
        odds = F.log((F.col("n1") + 0.5) / (total[1] + 1)) - F.log((clean + 0.5) / (total[0] + 1))
        both = counts[1].filter(F.col("n1") >= least).join(counts[0], "stem", "left").filter((odds >= ODDS) & (20 * clean <= F.col("n1")))
        rows = both.select("stem", "n1", odds.alias("odds")).collect()  # beginnings that tell abusive texts of the bounded sample
        ours, good = {r["stem"]: r["n1"] for r in rows}, {r["stem"]: r["odds"] for r in rows}
        for s in sorted(good, key=lambda s: (len(s), s)):
            if any(s[:k] in good for k in range(SHORTEST, len(s))):
                continue
            weight = good[s]
            while longer := [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and ours[x] >= 0.95 * ours[s]]:
                s = min(longer)
            stems[s] = weight
    kinds = {"i": 1.5, "v": 1.5, "h": 0.0}
    prior = np.array([kinds[x[0]] + (0.5 if x[1] == "t" else 0.0) - (0.4 if x[2] == "n" else 0.0) - (0.4 if x[3] == "r" else 0.0) for x in LABELS] + [-3.0])

    def rows(batches):
        reader = Reader(stems)
        for batch in batches:
            x = [reader.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sample.select("toxic", "t").mapInArrow(rows, "toxic int, x array<double>").collect()  # 2 * bound rows at most
    weights = prior
    if total.get(0) and total.get(1):
        got.sort(key=lambda r: (r["toxic"], r["x"]))
        x = np.array([[*r["x"], 1.0] for r in got])
        weights = _logistic(x, np.array([r["toxic"] for r in got], float), prior)
    return stems, weights


def score_texts(docs: DataFrame, stems: dict[str, float], weights: np.ndarray, text_col: str = "text", column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1; null and empty texts get the score of a text without matches.
    A column that has the name of the score is replaced.  Repeated rows are scored each, whole texts always."""
    kept = [c for c in docs.columns if c != column]
    fields = docs.select(*kept).schema
    small_batches(docs.sparkSession)

    def run(batches):
        reader = Reader(stems)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([[*reader.features(t), 1.0] for t in texts]).reshape(len(texts), -1)
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("_score", pa.float64())]))

    # the row travels under names of ours, so clashing or odd names do no harm
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], text_of(text_col).alias("_t"))
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["_score double"])
    return renamed.mapInArrow(run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], F.col("_score").alias(column))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stems, weights = learn(docs, read(spark, sf_dir, "labels"))
    ident = F.col("doc_id")
    scored = score_texts(docs.select("doc_id", "text"), stems, weights, column="score")
    return scored.select("doc_id", (fold_mod(ident, 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
