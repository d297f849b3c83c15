"""A log-bilinear language model trained with noise-contrastive estimation, and the scores it gives to whole texts.

Words are counted over the whole training part.  The most frequent ones, as many as the training tokens allow, and the
end have vectors of their own.  Sorted by their reversed spelling they are cut into about as many classes as a class has
words; every other word belongs to the class in whose range its reversed spelling falls, and is known there as the rest
of the class.  The log-probability of a class, and of an item (own word or rest) inside its class, after the items
before it is the product of its vector with a sum, weighted by position, of theirs, plus a bias.  Both levels are told
from noise by frequency.  Every task trains on its texts from the same start and the weighted mean of the tasks' models
is the next start, so the whole training part is read and no gradient waits for the driver.  Scores use the normalised
model: one product over the classes, and one for each class over its items.  A word of a rest has its discounted share of
the rest's count; words never seen in training share the discounts.  So after any words the probabilities of the known
words, one unseen word a class and the end sum to one.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_mod, read, small_batches, stage_table, text_of

FOLDS, HELD = 7, 2
#: The length of a vector, the words before that count, and where random numbers start.
SIZE, REACH, SEED = 16, 4, 20240302
#: Most frequent words whose counts every worker holds; counts of rarer ones come by a join.
HEAD = 150_000
#: One word with a vector of its own for so many training tokens, and the most that there are.
PER_WORD, VECTORS = 300, 10_000
#: Rounds of training (each reads its share of the texts), noise words for a word, tokens of a task (about) and of a step
#: (at most), steps of a task at least, and the rate.
ROUNDS, NOISE, PER_TASK, STEP, STEPS, RATE = 2, 12, 2_000_000, 16_384, 120, 0.1
END = b""
#: Rows of a product over all classes, so that it stays in a processor's cache.
CACHE = 1024
#: Bytes of text whose words a task counts at once.
AT_ONCE = 32_000_000


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, split at 0x20 and 0x09-0x0D alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts of a column one after another, and where each text's words begin and end."""
    # Arrow 23 lowers a cast slice wrongly, so the cast comes last
    split = pc.ascii_split_whitespace(pc.ascii_lower(column).cast(pa.large_string()))
    flat, cut = split.flatten(), split.offsets.to_numpy()
    some = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty text
    if not some.all():
        flat, cut = flat.filter(pa.array(some)), np.concatenate(([0], np.cumsum(some)))[cut]
    return flat.cast(pa.large_binary()), cut.astype("i8")


def numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray]:
    """``words_in`` a column, its distinct words, and for each word the number of it among those."""
    flat, cut = words_in(column)
    coded = flat.dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at, data = np.frombuffer(at, "i8")[: len(coded.dictionary) + 1].tolist(), (data or pa.py_buffer(b"")).to_pybytes()
    return flat, cut, [data[s:e] for s, e in zip(at, at[1:], strict=False)], coded.indices.to_numpy()  # to_pylist is slow


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("id"), (fold_mod(ident, FOLDS) == HELD).alias("held"), text_of(text_col).alias("t"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the training texts; the end is the empty word.  Each task counts its own words first."""

    def counted(columns):
        words, n = words_in(pa.chunked_array(columns, columns[0].type).combine_chunks()), sum(map(len, columns))
        seen = words[0].value_counts()
        word, times = seen.field("values").cast(pa.binary()), seen.field("counts").cast(pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([word, pa.array([END], pa.binary())]), pa.concat_arrays([times, pa.array([n], pa.int64())])], names=["word", "n"])

    def run(batches):
        columns, size = [], 0
        for batch in batches:
            columns.append(batch.column(0))
            size += batch.column(0).nbytes
            if size > AT_ONCE:
                yield counted(columns)
                columns, size = [], 0
        if columns:
            yield counted(columns)

    return texts.filter("not held").select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Items by number: the words with vectors in order of their reversed spelling, after those of each class its rest."""

    def __init__(self, own: list[bytes]):
        self.words = sorted({END, *own}, key=lambda w: w[::-1])
        n = len(self.words)
        self.count = max(1, round(math.sqrt(n)))
        cut = [n * i // self.count for i in range(self.count + 1)]
        self.least = [self.words[a][::-1] for a in cut[:-1]]
        self.first = np.array([a + i for i, a in enumerate(cut)], "i8")  # of a class; its rest is the last before the next
        self.size = n + self.count
        of = np.repeat(np.arange(self.count), np.diff(cut))
        self.item = dict(zip(self.words, (np.arange(n) + of).tolist(), strict=True))
        self.of = np.repeat(np.arange(self.count), np.diff(self.first))

    def place(self, word: bytes) -> int:
        return bisect_right(self.least, word[::-1]) - 1

    def rest(self, k: int) -> int:
        return int(self.first[k + 1]) - 1

    def items(self, words: list[bytes]) -> list[int]:
        """The items of a text's words and of its end."""
        known, out = self.item, []
        for w in words:
            i = known.get(w)
            out.append(self.rest(self.place(w)) if i is None else i)
        out.append(known[END])
        return out


    def items_in(self, column: pa.Array) -> list[np.ndarray]:
        """``items`` of each text of a column; every distinct word is looked up once."""
        _, cut, distinct, at = numbered(column)
        items = np.array([self.rest(self.place(w)) if i is None else i for w, i in zip(distinct, map(self.item.get, distinct), strict=True)], "i8")[at]
        end = self.item[END]
        return [np.append(items[s:e], end) for s, e in zip(cut, cut[1:], strict=False)]


class Model:
    """source [item, and the start], target and bias by item, the same by class, and the weights of positions."""

    names = ("source", "target", "bias", "class_target", "class_bias", "position")

    def __init__(self, classes: Classes, counts: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.classes = classes
        q = counts + 0.5
        by_class = np.add.reduceat(q, classes.first[:-1])
        self.log_class = np.log(by_class / by_class.sum()).astype("f4")
        self.log_item = np.log(q / by_class[classes.of]).astype("f4")
        small = lambda n: rng.normal(0, 0.1, (n, SIZE)).astype("f4")
        self.source, self.target, self.bias = small(classes.size + 1), small(classes.size), self.log_item.copy()
        self.class_target, self.class_bias = small(classes.count), self.log_class.copy()
        self.position = np.repeat(np.float32(1) / np.arange(1, REACH + 1, dtype="f4")[:, None], SIZE, axis=1)

    def params(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.names]

    def _read(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What stands at REACH and after (see ``windows``), sorted by class: vectors of ``flat``, places of the words in
        it, their contexts (with a one after, for the biases), their items, and where the classes begin."""
        vectors = self.source[flat]
        n = len(flat) - REACH
        context = vectors[REACH - 1 : REACH - 1 + n] * self.position[0]
        for k in range(1, REACH):
            context += vectors[REACH - 1 - k : REACH - 1 - k + n] * self.position[k]
        at = np.nonzero(flat[REACH:] < self.classes.size)[0]
        items = flat[REACH:][at]
        order = np.argsort(items.astype("u2") if self.classes.size < 1 << 16 else items, kind="stable")  # items are numbered by class
        at, items = at[order], items[order]
        there = np.ones((len(at), SIZE + 1), "f4")
        there[:, :SIZE] = context[at]
        return vectors, at, there, items, np.searchsorted(items, self.classes.first)

    def log_probabilities(self, flat: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of the words from REACH on, 0 where none is."""
        _, at, context, items, cut = self._read(flat)
        out = np.zeros(len(flat) - REACH)
        if not len(at):
            return out
        found, of = np.empty(len(at)), self.classes.of[items]
        by_class, by_item = np.column_stack((self.class_target, self.class_bias)), np.column_stack((self.target, self.bias))
        for s in range(0, len(at), CACHE):
            found[s : s + CACHE] = _normalised(context[s : s + CACHE] @ by_class.T, of[s : s + CACHE])
        for k in np.nonzero(np.diff(cut))[0].tolist():
            lo, hi, s, e = self.classes.first[k], self.classes.first[k + 1], cut[k], cut[k + 1]
            found[s:e] += _normalised(context[s:e] @ by_item[lo:hi].T, items[s:e] - lo)
        out[at] = found
        return out

    def gradients(self, flat: np.ndarray) -> list[np.ndarray]:
        """Of the noise-contrastive loss, with normalising constants fixed at one as usual.  Instead of drawn noise
        words, all of a level count by their expected number (NOISE times their frequency)."""
        classes, grads = self.classes, [np.zeros_like(p) for p in self.params()]
        source, target, bias, class_target, class_bias, position = grads
        vectors, at, context, items, cut = self._read(flat)
        of, pull = classes.of[items], np.empty((len(at), SIZE), "f4")
        by_class, by_item = -np.column_stack((self.class_target, self.class_bias)), -np.column_stack((self.target, self.bias))
        for s in range(0, len(at), CACHE):
            here = context[s : s + CACHE]
            err = _told(here, by_class, self.log_class, of[s : s + CACHE])
            both = err.T @ here
            class_target += both[:, :SIZE]
            class_bias += both[:, SIZE]
            pull[s : s + CACHE] = err @ self.class_target
        for k in np.nonzero(np.diff(cut))[0].tolist():
            lo, hi, s, e = classes.first[k], classes.first[k + 1], cut[k], cut[k + 1]
            err = _told(context[s:e], by_item[lo:hi], self.log_item[lo:hi], items[s:e] - lo)
            both = err.T @ context[s:e]
            target[lo:hi], bias[lo:hi] = both[:, :SIZE], both[:, SIZE]
            pull[s:e] += err @ self.target[lo:hi]
        n = len(flat) - REACH
        back = np.zeros((n, SIZE), "f4")
        back[at] = pull
        to = np.zeros((len(flat), SIZE), "f4")
        for k in range(REACH):
            before = slice(REACH - 1 - k, REACH - 1 - k + n)
            to[before] += back * self.position[k]
            position[k] = np.einsum("ij,ij->j", back, vectors[before])
        for j in range(SIZE):
            source[:, j] = np.bincount(flat, weights=to[:, j], minlength=len(source))
        return grads


def _normalised(scores: np.ndarray, right: np.ndarray) -> np.ndarray:
    found = scores[np.arange(len(scores)), right].astype("f8")
    with np.errstate(over="ignore"):
        total = np.exp(scores) @ np.ones(scores.shape[1], "f4")
    if not (np.isfinite(total).all() and total.all()):
        top = scores.max(axis=1)
        return found - top - np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype="f8"))
    return found - np.log(total)


def _told(context: np.ndarray, against: np.ndarray, log_noise: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The gradient by score: expected noise times the chance that it is taken for data, less the doubt about data.
    ``against`` has the vectors and biases with their signs turned."""
    out = context @ against.T
    noise = np.exp(log_noise) * np.float32(NOISE)
    with np.errstate(over="ignore"):
        np.exp(out, out=out)  # times the noise, its odds
        at = np.arange(len(out))
        odds = out[at, right] * noise[right]
    out += 1 / noise
    np.reciprocal(out, out=out)
    out[at, right] -= 1 - 1 / (1 + odds)
    return out


def windows(texts: list, start: int) -> np.ndarray:
    """The items of some texts, REACH starts before each, so that none sees another one."""
    pad = np.full(REACH, start, "i8")
    return np.concatenate([x for t in texts for x in (pad, np.asarray(t, "i8"))]) if texts else pad[:0]


def train(model: Model, feed, step: int, passes: int) -> int:
    """Adaptive gradient steps over batches of texts as items, in place; the number of tokens."""
    params = model.params()
    sums = [np.full_like(p, 1e-6) for p in params]
    tokens = 0
    for texts in feed:
        flat = windows(texts, model.classes.size)
        tokens += sum(map(len, texts))
        for _ in range(passes):
            for s in range(REACH, len(flat), step):
                for p, g, total in zip(params, model.gradients(flat[s - REACH : s + step]), sums, strict=True):
                    total += g * g
                    p -= np.float32(RATE) * g / np.sqrt(total)
    return tokens


def fit(texts: DataFrame, model: Model, tokens: int) -> None:
    """Train ``model`` on the training texts, in place: ROUNDS times the mean of the models of all tasks, by their tokens.

    A task reads about PER_TASK tokens, and goes over small inputs several times.  A model leaves a task as one row of
    SIZE-long vectors for each item, which Spark adds up; the driver sees one sum for each item.
    """
    spark = texts.sparkSession
    tasks = max(1, math.ceil(tokens / ROUNDS / PER_TASK))
    step = max(256, min(STEP, tokens // (ROUNDS * tasks * STEPS)))
    passes = max(1, min(8, math.ceil(STEPS * step * tasks * ROUNDS / max(1, tokens))))
    width = 2 * SIZE + 1
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            import copy

            mine = copy.deepcopy(shared.value)

            def feed():
                for batch in batches:
                    yield mine.classes.items_in(batch.column(0))

            n = train(mine, feed(), step, passes)
            if not n:
                return
            blank = lambda rows, columns: np.zeros((rows, columns), "f4")
            items = np.hstack([mine.source, np.vstack([mine.target, blank(1, SIZE)]), np.append(mine.bias, 0).astype("f4")[:, None]])
            of_class = np.hstack([mine.class_target, blank(len(mine.class_bias), SIZE), mine.class_bias[:, None]])
            rows = np.vstack([items, of_class, np.hstack([mine.position, blank(REACH, SIZE + 1)])]) * np.float64(n)
            for s in range(0, len(rows), 5000):
                part = rows[s : s + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(part), dtype="i4")), pa.array(np.full(len(part), float(n))), *(pa.array(np.ascontiguousarray(part[:, c])) for c in range(width))], names=["row", "n", *(f"c{c}" for c in range(width))])

        mine = texts.filter("not held").filter(F.pmod(F.xxhash64("t"), F.lit(ROUNDS)) == turn).select("t").coalesce(tasks)
        sums = mine.mapInArrow(run, ", ".join(["row int, n double", *(f"c{c} double" for c in range(width))])).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(f"c{c}").alias(f"c{c}") for c in range(width))).toArrow()
        shared.unpersist()
        if not sums.num_rows:
            continue
        order = np.argsort(sums.column("row").to_numpy())
        rows = (np.stack([sums.column(f"c{c}").to_numpy() for c in range(width)], axis=1) / sums.column("n").to_numpy()[:, None])[order].astype("f4")
        n, k = model.classes.size, model.classes.count
        model.source, model.target, model.bias = rows[: n + 1, :SIZE].copy(), rows[:n, SIZE : 2 * SIZE].copy(), rows[:n, -1].copy()
        model.class_target, model.class_bias, model.position = rows[n + 1 : n + 1 + k, :SIZE].copy(), rows[n + 1 : n + 1 + k, -1].copy(), rows[n + 1 + k :, :SIZE].copy()


def count_rests(counts: DataFrame, classes: Classes) -> np.ndarray:
    """For each class the tokens of its rest, the discount, and log10 of an unseen word's share of it."""

    def run(batches):
        total = np.zeros((classes.count, 4), "i8")
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in classes.item:
                    total[classes.place(w)] += (n, 1, n == 1, n == 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.count)), *(pa.array(total[:, i]) for i in range(4))], names=["k", "n", "v", "n1", "n2"])

    out = np.zeros((classes.count, 3))
    for r in counts.select("word", "n").mapInArrow(run, "k long, n long, v long, n1 long, n2 long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n1", "n2"))).collect():
        if r["n"]:
            d = min(0.9, max(0.1, r["n1"] / max(1, r["n1"] + 2 * r["n2"])))
            out[r["k"]] = r["n"], d, math.log10(d * r["v"] / r["n"])
    return out


def _most_frequent(counts: DataFrame, head: int) -> list:
    """The most frequent words, ``head`` at most: those above a count that a histogram of counts gives.  Sixteen steps a
    doubling, so a thousand rows at most; no task or driver sees more words than it keeps."""
    step = F.floor(F.log2("n") * 16).cast("int")
    words = counts.filter(F.length("word") > 0)
    sizes = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    taken, least = 0, None
    for at, size in sizes:
        if taken + size > head:
            break
        taken, least = taken + size, at
    if least is None:
        return []
    return sorted(words.filter(step >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> tuple:
    """(texts, counts, facts, most frequent words, model, rests) of a corpus; see ``score_texts``."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    counts = stage_table(count_words(texts), "word-counts")
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))), F.lit(0)).alias("ends")).first()
    n, ends = int(facts["n"]), int(facts["ends"])
    top = _most_frequent(counts, head)
    own = top[: min(len(top), n // PER_WORD, VECTORS)]
    classes = Classes([bytes(r["word"]) for r in own])
    rests = count_rests(counts, classes)
    seen = np.zeros(classes.size)
    for r in own:
        seen[classes.item[bytes(r["word"])]] = r["n"]
    seen[classes.item[END]] = ends
    for k in range(classes.count):
        seen[classes.rest(k)] = rests[k, 0]
    model = Model(classes, seen)
    fit(texts, model, n)
    return texts, counts, (n, int(facts["v"]), ends), top, model, rests


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end alone.  Repeated rows are scored each; a null id counts as an empty string when
    folds are dealt.  Without training rows every count is zero.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts, counts, (n, v, ends), top, model, rests = learn(docs, id_col, text_col, head)
    classes = model.classes
    number = {bytes(r["word"]): i for i, r in enumerate(top)}
    known = np.array([r["n"] for r in top], "i8")
    item_of = np.array([classes.items([w])[0] for w in number], "i8")
    base_of = math.log10(n + v + 1) if n else 0.0
    # a word of a rest that all workers know: log10 of its share
    share = np.zeros(len(top))
    for i, w in enumerate(number):
        if w not in classes.item:
            tokens, d, _ = rests[classes.of[item_of[i]]]
            share[i] = math.log10((known[i] - d) / tokens)
    shared = spark.sparkContext.broadcast((number, known, item_of, share, model))

    def run(batches):
        number, known, item_of, share, model = shared.value
        classes, part, row = model.classes, TaskContext.get().partitionId(), 0
        base_known = np.log10(known + 1.0) if len(known) else np.zeros(0)
        end = classes.item[END]

        def scored(texts: list[np.ndarray]) -> np.ndarray:
            total = np.zeros(len(texts))
            flat = windows(texts, classes.size)
            owner = np.repeat(np.arange(len(texts)), [len(t) + REACH for t in texts])
            for s in range(REACH, len(flat), 32768):
                total += np.bincount(owner[s : s + 32768], weights=model.log_probabilities(flat[s - REACH : s + 32768]), minlength=len(texts))
            return total / math.log(10)

        for batch in batches:
            flat, cut, distinct, number_of = numbered(batch.column(2))
            found = np.array([number.get(w, -1) for w in distinct], "i8")
            near, place = found >= 0, np.zeros(len(found), "i8")
            odd = np.nonzero(~near)[0]
            place[odd] = [classes.place(distinct[j]) for j in odd.tolist()]
            items, base, shares = classes.first[place + 1] - 1, np.zeros(len(found)), np.zeros(len(found))
            items[near], base[near], shares[near] = item_of[found[near]], base_known[found[near]], share[found[near]]
            size, is_near = np.diff(cut), near[number_of]
            owner = np.repeat(np.arange(len(size)), size)
            sums = [np.bincount(owner, weights=x[number_of], minlength=len(size)) for x in (base, shares)]
            items = items[number_of]
            far = pa.array(~is_near)
            far_cut = pa.array(np.concatenate(([0], np.cumsum(~is_near)))[cut], pa.int32())
            score = scored([np.append(items[s:e], end) for s, e in zip(cut, cut[1:], strict=False)]) + sums[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part << 40) + row + np.arange(len(size)), pa.int64()),
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.bool_()),
                    pa.array(size + 1, pa.int64()),
                    pa.array(np.bincount(owner[is_near], minlength=len(size)), pa.int64()),
                    pa.array(sums[0]),
                    pa.array(score),
                    pa.ListArray.from_arrays(far_cut, flat.filter(far).cast(pa.binary())),
                    pa.ListArray.from_arrays(far_cut, pa.array(place[number_of[~is_near]], pa.int32())),
                ],
                names=["row", "id", "held", "n_tokens", "near", "base", "score", "far", "places"],
            )
            row += len(size)

    scored = stage_table(texts.mapInArrow(run, "row long, id long, held boolean, n_tokens long, near long, base double, score double, far array<binary>, places array<int>"), "scored")
    cell = lambda k: F.element_at(F.array(*[F.lit(float(x)) for x in rests[:, k]]), F.col("place") + 1)
    far = scored.select("row", F.explode(F.arrays_zip("far", "places")).alias("x")).groupBy("row", F.col("x.far").alias("word")).agg(F.count(F.lit(1)).alias("times"), F.any_value("x.places").alias("place"))
    looked = far.join(counts, "word", "left")
    per_row = looked.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("base_far"),
        # a rest without words in training is one unseen word
        F.sum(F.col("times") * F.when(F.col("n").isNull(), cell(2)).otherwise(F.log10((F.col("n") - cell(1)) / cell(0)))).alias("score_far"),
    )
    end = math.log10(ends + 1)
    return scored.drop("far", "places").join(per_row, "row", "left").select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("near") + F.coalesce("known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_far", F.lit(0.0)) + end - F.col("n_tokens") * base_of).alias("base_score"),
        (F.col("score") + F.coalesce("score_far", F.lit(0.0))).alias("score"),
    )


def fold_of(ident: int | None) -> int:
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % FOLDS


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
