"""Near-duplicate texts: a forest of sorted MinHash prefix tries, exact Jaccard verification, distributed components.

Texts with the same set of n-grams are one class first.  Each class has a signature of ``DEEPEST`` MinHash values in each
of ``TREES`` trees.  A tree is the trie of its signatures, kept as the sorted list: how far a signature agrees with its
neighbours there says at which depths it shares a node with anyone.  Classes are compared where they share a node at the
deepest level first.  The similarities of the links found say how many links a depth misses (each link counts as one
over its chance to be found), and matched prefixes are shortened until the recall so estimated reaches the target; a
pair is compared once, in the first tree in which it meets at the first depth at which it does.  Comparisons take
members of one node, in blocks, by the exact Jaccard similarity of their n-grams (as 64-bit hashes); they give counts
and a spanning forest, never lists of pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage_table, text_of
from .components import by_row, compare, meetings, with_payloads

WORDS, SIMILARITY, RECALL, TREES, DEEPEST, SEED = 5, 0.8, 0.999, 24, 10, 20240301
#: Columns of one product when the n-grams of a block are compared.
CHUNK = 8192


def chance(similarity, depth: int, trees: int = TREES):
    """The chance that a pair of this similarity shares a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The depth that reaches the target whatever the links are like; 1 if none does."""
    return next((d for d in range(deepest, 1, -1) if chance(similarity, d, trees) >= recall), 1)


def shorten(links: dict[int, int], depth: int, similarity: float, recall: float, trees: int = TREES) -> int:
    """The depth to search next, ``depth`` itself if the recall reached is enough.

    ``links`` counts the links found so far by thousandths of similarity.  Each stands for one over its chance of being
    found links of the corpus; one more link, right at the threshold, stands for those nobody has seen.
    """
    s = np.array([similarity, *(max(similarity, b / 1000) for b in sorted(links))])
    n = np.array([1.0, *(links[b] for b in sorted(links))])
    n[1:] /= chance(s[1:], depth, trees)
    for d in range(depth, 0, -1):
        if (n * chance(s, d, trees)).sum() >= recall * n.sum():
            return d
    return 1


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased words; a shorter text is one n-gram of all its
    words, a text without words has none."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in text.lower().split()], "u8")
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, "u8")
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray, odd: np.ndarray) -> bytes:
    """Sixteen bits of each MinHash value, big-endian, so that bytes sort as the values do."""
    least = np.full(len(odd), np.iinfo("u8").max, "u8")
    for s in range(0, len(grams), 512):
        np.minimum(least, (grams[None, s : s + 512] * odd[:, None]).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(">u2").tobytes()


def digest_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest() if len(grams) else None


def _signed(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """Rows id, digest of the set of n-grams (null without words), size of the set, sig."""

    def run(batches):
        odd = np.random.default_rng(SEED).integers(0, 2**63, trees * DEEPEST, dtype="u8") * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest_of(g) for g in sets], pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.array([signature(g, odd) if len(g) else None for g in sets], pa.binary())],
                names=["id", "digest", "size", "sig"],
            )

    return docs.mapInArrow(run, "id long, digest binary, size long, sig binary")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values two lists of paths (tree, then values) have in common; none in different trees."""
    return np.where(a[:, 0] == b[:, 0], np.cumprod(a[:, 1:] == b[:, 1:], axis=1).sum(axis=1), 0)


def forest(classes: DataFrame, trees: int, least: int) -> DataFrame:
    """(t, label, digest, deep) of the signatures that share a node of depth ``least`` or more with another one; ``deep``
    is the depth of the deepest such node.

    The signatures of all trees are sorted by range partitions, and each is held against its neighbours.  Equal
    signatures are told apart by their digests, so a frequent one may lie in many partitions; the first and the last
    row of each partition (two rows a partition) mend the seams.
    """
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("sig", t * (2 * DEEPEST) + 1, F.lit(2 * DEEPEST)))
    rows = classes.select("digest", F.posexplode(labels).alias("t", "label"))
    rows = rows.repartitionByRange("t", "label", "digest").sortWithinPartitions("t", "label", "digest")

    def sweep(batches):
        part, held, before, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            path = np.empty((batch.num_rows, DEEPEST + 1), "i4")
            path[:, 0] = batch.column(0).to_numpy()
            path[:, 1:] = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEEPEST)
            same = agreement(path[:-1], path[1:])
            left = np.concatenate(([before], same))
            yield from given(batch.slice(0, batch.num_rows - 1), np.maximum(left[:-1], same), part, 1 if first else 0, False)
            first = first and batch.num_rows == 1
            held, before = batch.slice(batch.num_rows - 1), int(left[-1])
        if held is not None:
            yield from given(held, np.array([before]), part, 1 if first else 0, True)

    def given(batch, deep, part, first, last):
        edge = np.zeros(batch.num_rows, "i4")
        if batch.num_rows:
            edge[0] += first
            edge[-1] += 2 * last
            keep = pa.array((deep >= least) | (edge > 0))
            kept = pa.table([*batch.columns, pa.array(deep.astype("i4")), pa.array(edge), pa.array(np.full(batch.num_rows, part, "i4"))], names=["t", "label", "digest", "deep", "edge", "part"]).filter(keep)
            yield from kept.combine_chunks().to_batches()

    swept = stage_table(rows.select("t", "label", "digest").mapInArrow(sweep, "t int, label binary, digest binary, deep int, edge int, part int"), "forest")
    ends = sorted(swept.filter("edge > 0").select("part", "edge", "t", "label").collect(), key=lambda r: (r["part"], r["edge"] & 2))
    more: dict[tuple[int, int], int] = {}
    path = lambda r: np.array([[r["t"], *np.frombuffer(bytes(r["label"]), ">u2")]], "i4")
    for a, b in zip(ends, ends[1:], strict=False):
        if a["part"] != b["part"]:
            n = int(agreement(path(a), path(b))[0])
            for r in (a, b):
                key = (r["part"], r["edge"])
                more[key] = max(n, more.get(key, 0))
    seams = classes.sparkSession.createDataFrame([(p, e, n) for (p, e), n in sorted(more.items())], "part int, edge int, more int")
    mended = swept.join(F.broadcast(seams), ["part", "edge"], "left").withColumn("deep", F.greatest("deep", F.coalesce("more", F.lit(0))))
    return mended.filter(F.col("deep") >= least).select("t", "label", "digest", "deep")


def _prefixes(trees: int, depth: int, done: int | None):
    """Keys of signatures at a depth, and at the depth searched before."""

    def at(values: np.ndarray, d: int) -> np.ndarray:
        key = np.zeros(values.shape[:2], "u8")
        for k in range(d):
            key = (key ^ values[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key

    def keys(sigs: list[bytes]):
        values = np.frombuffer(b"".join(sigs), ">u2").reshape(len(sigs), trees, DEEPEST).astype("u8")
        return at(values, depth), None if done is None else at(values, done)

    return keys


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.cumsum(seen > 1) - 1
    shared = seen[column] > 1
    owner, column = owner[shared], order[column[shared]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(sets), len(sets)), "f4")
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        lo, hi = np.searchsorted(column, [s, s + CHUNK])
        x = np.zeros((len(sets), min(CHUNK, int(column[hi - 1]) - s + 1)), "f4")
        x[owner[lo:hi], column[lo:hi] - s] = 1
        out += x @ x.T
    return out


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False, depths: list | None = None) -> DataFrame:
    """One row per input row: doc_id, n_links (other rows with a similarity of ``similarity`` or more), class_id (the
    least id of its group of linked rows), kept (doc_id = class_id), and on demand the digest of the set of n-grams.

    Null and blank texts have no n-grams and link with nothing.  Repeated rows, ids included, count each; a class whose
    ids are all null has a null class_id.  Other columns are ignored; an empty table gives an empty one.  The depths
    searched are appended to ``depths``.
    """
    small_batches(docs.sparkSession)
    least = least_depth(similarity, recall, trees)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    signed = stage_table(_signed(texts, words, trees), "signatures")
    classes = stage_table(
        signed.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig")), "text-classes"
    )
    matched = stage_table(forest(classes, trees, least), "matched")
    wanted = classes.join(matched.select("digest").distinct(), "digest", "left_semi")

    # one text of each class; its digest is made again, so rows that share an id do no harm
    def gram_rows(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["digest", "bytes"])

    ids = wanted.select(F.col("first").alias("id"))
    named = texts.join(ids.filter("id is not null").distinct(), "id", "left_semi")
    if not ids.filter("id is null").isEmpty():
        named = named.unionByName(texts.filter("id is null"))
    grams = stage_table(named.select("t").mapInArrow(gram_rows, "digest binary, bytes binary"), "grams").filter("digest is not null").groupBy("digest").agg(F.any_value("bytes").alias("bytes"))
    payloads = stage_table(wanted.select("digest", "copies").join(grams, "digest"), "payloads")

    def near(raw: list[bytes]):
        sets = [np.frombuffer(x, "<u8") for x in raw]
        size, both = np.array([len(s) for s in sets], "f8"), _intersections(sets).astype("f8")
        either = size[:, None] + size - both
        return both >= similarity * either - 1e-9, both / either

    depth, done, found, links = DEEPEST, None, None, {}
    while True:
        if depths is not None:
            depths.append(depth)
        placed = matched.filter(F.col("deep") >= depth).select("t", F.substring("label", 1, 2 * depth).alias("node"), "digest")
        keys = _prefixes(trees, depth, done)
        met = meetings(placed, wanted.select("digest", "size", "sig"), keys, similarity, "texts")
        told = compare(with_payloads(met, payloads), keys, near, "texts")
        for r in told.filter("u is null").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # a thousand rows at most
            links[r["bin"]] = links.get(r["bin"], 0) + r["n"]
        found = told if found is None else found.unionByName(told)
        shorter = max(least, shorten(links, depth, similarity, recall, trees))
        if shorter >= depth:
            break
        depth, done = shorter, depth
    out = by_row(signed, classes, found, "doc_id").withColumnRenamed("component_id", "class_id")
    return out if with_digest else out.drop("digest")


def one_of_each(docs: DataFrame, judged: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the class id of their group; rows with a null id all stay.

    ``judged`` is what ``similar_texts`` gives with the digests.  Where rows share an id, one row of each of its texts
    that is kept stays, and every blank one.
    """
    small_batches(docs.sparkSession)
    ids = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("kept").cast("int")).alias("_kept")).withColumnRenamed("doc_id", "_id")
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")).join(ids.filter("_kept = 1"), "_id")
    once = chosen.filter("_n = 1").select("_row.*")

    def sign(batches):
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                digest = digest_of(shingles(row.column(2).to_pylist()[0], words))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([digest], pa.binary())], schema=pa.schema([*list(row.schema)[:2], pa.field("_digest", pa.binary())]))

    row_type = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"].dataType.simpleString()
    repeated = chosen.filter("_n > 1").select("_row", "_id", "_t").mapInArrow(sign, f"_row {row_type}, _id long, _digest binary")
    texts = judged.filter("kept and digest is not null").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    told = repeated.filter("_digest is not null").join(texts, ["_id", "_digest"]).dropDuplicates(["_id", "_digest"]).select("_row.*")
    return once.unionByName(told).unionByName(repeated.filter("_digest is null").select("_row.*")).unionByName(docs.filter(F.col(id_col).isNull()))


def op2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(read(spark, sf_dir, "documents"))
