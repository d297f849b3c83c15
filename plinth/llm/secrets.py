"""Secrets in texts, with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Matches are placed without any join: the lengths of the pieces between matches and of the matches are summed inside the
row.  For other long tokens an encoding (its alphabet) is inferred; chi-squared uniformity over that alphabet, a runs
test about its middle and the lag-one serial correlation each give a p-value under "drawn at random", and Fisher's rule
combines them.  A band of lengths accepts from the value 0.01 on, which loses about that share of random tokens; only
where a corpus-wide histogram shows a significant excess of ordinary tokens over ``fdr`` is the value raised.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage_table, text_of

# The base patterns, their order and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: (name, pattern of the whole token, alphabet in the order of values), the first that fits is inferred.
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: A cut is the lower end of one of these bins, the second one at least and LAMBDA at most; it is raised on an excess of
#: ordinary tokens that chance gives with a probability under SURE.
BINS, LAMBDA, SURE = 100, 0.5, 0.01
#: Upper ends of the length bands; one more band holds the rest.  Tokens with digits and letters, those of digits alone and
#: those of letters alone have bands of their own.
BANDS = (24, 32, 48, 64, 128)
ALL_BANDS = 3 * (len(BANDS) + 1)
NONE = 2.0


_NO_SPANS = "array<struct<start:bigint,end:bigint,size:bigint>>"


def _let(df: DataFrame, name: str, **steps) -> DataFrame:
    """Add helper columns one after another: each stays one column of a plan, so that no tree is copied into others."""
    for key, make in steps.items():
        df = df.withColumn(f"_{name}_{key}", make(lambda k: F.col(f"_{name}_{k}")))
    return df


def _spans(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds ``_<name>_spans``: array<struct<start,end,size>> of the matches in ``_text``, size being the length of the
    given group.  Positions are running sums, in blocks of the square root of their number: no quadratic copying."""
    size = lambda x: F.char_length(x).cast("long")
    spans, numbers = F.array().cast(_NO_SPANS), F.array().cast("array<bigint>")

    def place(xs: Column, base: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), x["size"].alias("size")))).alias("all"),
        )
        return F.aggregate(xs, F.struct(base.alias("at"), spans.alias("all")), step)["all"]

    return _let(
        df,
        name,
        found=lambda c: F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)),
        checked=lambda c: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else c("found"),
        gaps=lambda c: F.when(F.size(c("found")) > 0, F.transform(F.split("_text", pattern, -1), size)).otherwise(numbers),
        parts=lambda c: F.arrays_zip(F.slice(c("gaps"), F.lit(1), F.size(c("found"))).alias("gap"), F.transform(c("found"), size).alias("len"), F.transform(c("checked"), size).alias("size")),
        block=lambda c: F.greatest(F.ceil(F.sqrt(F.size(c("parts")))).cast("int"), F.lit(1)),
        blocks=lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c("parts")) - 1) / c("block")).cast("int")), lambda b: F.slice(c("parts"), F.greatest(b, F.lit(0)) * c("block") + 1, c("block"))),
        sums=lambda c: F.transform(c("blocks"), lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])),
        bases=lambda c: F.aggregate(c("sums"), F.struct(F.lit(0).cast("long").alias("at"), numbers.alias("all")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"],
        spans=lambda c: F.when(F.size(c("parts")) > 0, F.flatten(F.zip_with(c("blocks"), c("bases"), place))).otherwise(spans),
    )


def with_base_spans(df: DataFrame) -> DataFrame:
    """The spans of each base kind in ``_text``, before their least lengths are asked for."""
    df = _spans(df, "assign", ASSIGN, 2)
    # runs shorter than the least length hold no other match, so the bound can stand in the pattern
    df = _spans(df, "access", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
    return _spans(df, "hex", f"[0-9a-f]{{{LEAST['hex']},}}")


def _upper(z: Column) -> Column:
    """P(Z > z) for a standard normal variable, by a rational approximation (absolute error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(df: DataFrame) -> DataFrame:
    """Adds ``_token_rated``: array<struct<start,end,band,p>> of the long tokens in ``_text`` that hold a digit or a
    letter; p is the combined value under "drawn at random from the inferred alphabet", small for ordinary text."""

    def pick(token: Column, make) -> Column:
        chain = F.when(token.rlike(ENCODINGS[0][1]), make(ENCODINGS[0][2]))
        for _, pattern, alphabet in ENCODINGS[1:]:
            chain = chain.when(token.rlike(pattern), make(alphabet))
        return chain

    zero = F.lit(0.0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, v: a + v)
    two = lambda z: F.ln(F.greatest(2 * _upper(F.abs(z)), F.lit(1e-300)))

    def step(**fields):
        return lambda x: F.struct(*[x[k].alias(k) if v is None else v(x).alias(k) for k, v in fields.items()])

    df = _spans(df, "token", TOKEN)
    return _let(
        df,
        "token",
        mixed=lambda c: F.filter(F.arrays_zip(c("spans").alias("s"), c("found").alias("x")), lambda z: z["x"].rlike("[0-9A-Za-z]")),
        one=lambda c: F.transform(c("mixed"), step(start=lambda z: z["s"]["start"], end=lambda z: z["s"]["end"], band=lambda z: _band(z["x"]), body=lambda z: F.regexp_replace(z["x"], "=+$", ""), alphabet=lambda z: pick(z["x"], F.lit))),
        two=lambda c: F.transform(c("one"), step(start=None, end=None, band=None, body=None, alphabet=None, k=lambda z: F.char_length(z["alphabet"]).cast("double"), chars=lambda z: F.filter(F.split(z["body"], ""), lambda ch: F.char_length(ch) > 0))),
        three=lambda c: F.transform(
            c("two"),
            step(
                start=None, end=None, band=None, k=None, n=lambda z: F.size(z["chars"]).cast("double"),
                values=lambda z: F.transform(z["chars"], lambda ch: F.instr(z["alphabet"], ch).cast("double")),
                squares=lambda z: F.aggregate(F.array_distinct(z["chars"]), zero, lambda a, ch: a + F.pow((F.char_length(z["body"]) - F.char_length(F.replace(z["body"], ch, F.lit("")))).cast("double"), F.lit(2.0))),
                fronts=lambda z: F.slice(z["chars"], F.lit(1), F.greatest(F.size(z["chars"]) - 1, F.lit(0))),
            ),
        ),
        four=lambda c: F.transform(
            c("three"),
            step(
                start=None, end=None, band=None, k=None, n=None, squares=None, q=lambda z: F.floor(z["k"] / 2) / z["k"],
                ups=lambda z: total(F.transform(z["values"], lambda v: (v > z["k"] / 2).cast("double"))),
                changes=lambda z: total(F.zip_with(F.slice(z["values"], F.lit(1), F.size(z["fronts"])), F.slice(z["values"], F.lit(2), F.size(z["fronts"])), lambda a, b: ((a > z["k"] / 2) != (b > z["k"] / 2)).cast("double"))),
                products=lambda z: total(F.zip_with(F.slice(z["values"], F.lit(1), F.size(z["fronts"])), F.slice(z["values"], F.lit(2), F.size(z["fronts"])), lambda a, b: (a - (z["k"] + 1) / 2) * (b - (z["k"] + 1) / 2))),
            ),
        ),
        # about the alphabet's middle each of the n - 1 steps changes sides with probability 2 q (1 - q)
        five=lambda c: F.transform(
            c("four"),
            step(
                start=None, end=None, band=None,
                chi=lambda z: F.ln(F.greatest(_upper((z["squares"] * z["k"] / z["n"] - z["n"] - (z["k"] - 1)) / F.sqrt(2 * (z["k"] - 1) * (z["n"] - 1) / z["n"])), F.lit(1e-300))),
                runs=lambda z: two((z["changes"] - (z["n"] - 1) * 2 * z["q"] * (1 - z["q"])) / F.sqrt((z["n"] - 1) * 2 * z["q"] * (1 - z["q"]) * (1 - 2 * z["q"] * (1 - z["q"])))),
                balance=lambda z: two((z["ups"] - z["n"] * (1 - z["q"])) / F.sqrt(z["n"] * z["q"] * (1 - z["q"]))),
                serial=lambda z: two(z["products"] / ((z["k"] * z["k"] - 1) / 12) / F.sqrt(z["n"] - 1)),
            ),
        ),
        # Fisher: survival of a chi-squared variable with 8 degrees of freedom, two for each of the four values
        six=lambda c: F.transform(c("five"), step(start=None, end=None, band=None, h=lambda z: -(z["chi"] + z["runs"] + z["balance"] + z["serial"]))),
        rated=lambda c: F.transform(c("six"), step(start=None, end=None, band=None, p=lambda z: F.exp(-z["h"]) * (1 + z["h"] + z["h"] * z["h"] / 2 + z["h"] * z["h"] * z["h"] / 6))),
    )


def _band(token: Column) -> Column:
    size = F.char_length(token)
    band = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        band = F.when(size <= BANDS[i], i).otherwise(band)
    return band + (len(BANDS) + 1) * F.when(~token.rlike("[A-Za-z]"), 1).when(~token.rlike("[0-9]"), 2).otherwise(0)


def _at_most(k: int, n: int, share: float) -> float:
    """P(X <= k) for a binomial X; by the normal approximation for large n."""
    if n > 2000:
        return 0.5 * math.erfc((n * share - k - 0.5) / math.sqrt(2 * n * share * (1 - share)))
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)
    return sum(math.exp(log(i)) for i in range(k + 1))


def least_accepted(counts: list[int], fdr: float) -> float:
    """The cut of a band from its counts by bin.

    Random tokens spread evenly above a cut.  With a share of at most ``fdr`` of ordinary ones, wherever those lie, the
    upper half of the accepted range and each of its tenths hold (1 - fdr) times their even share or more, but for
    chance; the first cut that the counts do not contradict stands.  Where they contradict all of them, none is accepted.
    """
    for b in range(1, int(LAMBDA * BINS) + 1):
        n, size = sum(counts[b:]), BINS - b
        edges = [b + size * i // 10 for i in range(11)]
        parts = [((b + BINS) // 2, BINS), *zip(edges, edges[1:], strict=False)]
        if all(_at_most(sum(counts[lo:hi]), n, (1 - fdr) * (hi - lo) / size) >= SURE / len(parts) for lo, hi in parts):
            return b / BINS
    return NONE


def least_shown(counts: list[int], fdr: float) -> float:
    """The cut of a band whose tokens are taken for ordinary ones until they show otherwise: that of ``least_accepted``
    if the accepted range then holds significantly more than all of the band's tokens below would spill into it, had
    they the geometric tail of ordinary ones."""
    cut = least_accepted(counts, fdr)
    if cut == NONE:
        return cut
    b = round(cut * BINS)
    above, below = sum(counts[b:]), sum(counts[:b])
    # evenly spread tokens put as many into each bin: ten of them at least, and the lowest bins no fuller than chance
    return cut if above >= 10 and below * (BINS - b) <= above * b * (1 + fdr) + 3 * math.sqrt(above * b) else NONE


def _cuts(rated: DataFrame, fdr: float) -> list[float]:
    cells = rated.select(F.explode("_token_rated").alias("x"))
    cells = cells.select("x.band", F.least(F.floor(F.col("x.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("band", "bin").count()
    counts = [[0] * BINS for _ in range(ALL_BANDS)]
    for r in cells.collect():
        counts[r["band"]][max(0, r["bin"])] += r["count"]
    return [(least_accepted(c, fdr) if sum(c) else LAMBDA) if i <= len(BANDS) else least_shown(c, fdr) for i, c in enumerate(counts)]


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = 0.05) -> list[float]:
    """For each band the least combined p-value that is accepted as random, from all tokens of the corpus.

    A band of mixed tokens that is empty keeps LAMBDA; one of digits or letters alone accepts none (NONE) unless its
    tokens are spread as random ones are.  Only ALL_BANDS times BINS counts reach the driver.
    """
    return _cuts(_battery(docs.select(text_of(text_col).alias("_text"))).select("_token_rated"), fdr)


def find_secrets(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, cuts: list[float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or those to ``carry``) and one more, ``secret_spans``: array<struct<start,rank,kind,end>>
    in order of start.

    Base spans are always there; a random token is added unless it meets a base span.  Null and empty texts have none.
    Repeated rows are scanned each.  A column named ``secret_spans`` is replaced.  Without ``cuts`` the rated tokens are
    written once, and thresholds and spans both come from there.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c != "secret_spans"]
    # a name of ours may be taken: the row travels as one column
    df = _battery(with_base_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), text_of(text_col).alias("_text"))))
    tag = lambda kind, spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    long_enough = lambda kind: F.filter(F.col(f"_{kind}_spans"), lambda x: x["size"] >= LEAST[kind])
    df = df.select("_row", "_token_rated", F.concat(*[tag(k, long_enough(k)) for k in KINDS[:3]]).alias("_base"))
    if cuts is None:
        df = stage_table(df, "rated-tokens")
        cuts = _cuts(df, fdr)
    accepted = F.array(*[F.lit(float(x)) for x in cuts])
    df = _let(
        df,
        "all",
        free=lambda c: F.filter("_token_rated", lambda x: (x["p"] >= F.element_at(accepted, x["band"] + 1)) & ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))),
        spans=lambda c: F.array_sort(F.concat("_base", tag("random", c("free")))),
    )
    return df.select("_row.*", F.col("_all_spans").alias("secret_spans"))


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every stretch that secret spans cover by ``mark``; spans that meet give one mark each, cut where the one
    before ends.  A text without spans (or null) stays as it is.  ``secret_spans`` goes."""
    spans, text = F.col("secret_spans"), F.col(text_col)
    at = lambda i: F.element_at(spans, i)
    done = lambda i: F.when(i > 1, F.aggregate(F.slice(spans, F.lit(1), i - 1), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["end"]))).otherwise(F.lit(0).cast("long"))
    keep = lambda i: F.concat(F.substring(text, (done(i) + 1).cast("int"), F.greatest(at(i)["start"] - done(i), F.lit(0)).cast("int")), F.when(at(i)["end"] > done(i), F.lit(mark)).otherwise(F.lit("")))
    last = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["end"]))
    cleaned = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.size(spans)), keep), ""), F.substring(text, (last + 1).cast("int"), F.char_length(text)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop("secret_spans")


def digest_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), carry=["doc_id"])
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest_spans(spans, KINDS[:3]).cast("binary"), 256).alias("base_sha256"), digest_spans(spans, KINDS).alias("spans"))
