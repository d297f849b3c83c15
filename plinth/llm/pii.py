"""Personal data by weak supervision: labellers vote on candidate spans, expectation-maximisation weighs the votes, and
a classifier trained on the outcome decides about spans that the base patterns leave open.

Candidates are the matches of the base patterns and of looser ones (telephone numbers without a plus sign, numbers in
the form of social security numbers, obfuscated e-mail addresses, capitalised words with a given name of the gazetteer,
house numbers beside a word for a street).  Every pattern takes time in proportion to the text, however long its runs.  A format labeller, a gazetteer labeller and a
context labeller vote on each.  Counts of the vote patterns by kind, over the whole corpus, are all that training needs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, text_of

# The base patterns and their order.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "ssn", "hidden_email", "name", "address")

# The same matches in time that grows with the text alone: a match of IP can only start where a run of digits does.
IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
BEFORE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

LOCAL = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
AT = re.compile(r" ?[\[(]at[\])] ?", re.IGNORECASE)
REST = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++", re.IGNORECASE)
#: Two or three capitalised words, and a house number with a capitalised word or two before or after it.
NAME = re.compile(r"(?<![^\W_])[^\W\d_a-z][^\W\d_]{1,15}(?: [^\W\d_a-z][^\W\d_]{1,15}){1,2}(?![^\W_])")
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen maria anna peter paul "
    "hans klaus jürgen wolfgang ursula monika petra sabine andreas stefan jean pierre michel françois marie nathalie isabelle catherine philippe nicolas "
    "josé juan antonio francisco manuel carmen ana isabel pilar dolores carlos luis javier miguel laura".split()
)
STREETS = frozenset("street st road rd avenue ave lane ln drive dr boulevard blvd court ct way place square".split())
STREET_ENDS = ("straße", "strasse", "weg", "platz", "allee", "gasse")
STREET = re.compile(
    rf"(?<![^\W_])[0-9]{{1,5}},? (?:[^\W\d_a-z][^\W\d_]{{1,15}} ){{1,2}}(?i:{'|'.join(sorted(STREETS))})(?![^\W_])"
    r"|(?<![^\W_])[0-9]{1,5},? rue (?:de |du |des )?[^\W\d_a-z][^\W\d_]{1,15}"
    rf"|(?<![^\W_])[^\W\d_a-z][^\W\d_]{{1,20}}(?:{'|'.join(STREET_ENDS)}) [0-9]{{1,4}}(?![0-9])"
)
WORDS = {
    "email": "email e-mail mail contact write courriel correo kontakt".split(),
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono".split(),
    "ip": "ip address host server login from addr".split(),
    "card": "card visa credit payment account carte tarjeta karte".split(),
    "ssn": "ssn social security".split(),
    "name": "mr mrs ms dr herr frau monsieur madame señor señora name named signed regards contact from author".split(),
    "address": "address lives live located visit office at in wohnt adresse dirección adresse habite".split(),
}
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk eu us ch at it nl".split())
AROUND = 32
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, int]]:
    """The matches of EMAIL, from each "@" outward: what stands before it up to the last match, or to a character that
    cannot, and the longest domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # no start lies before an earlier "@", so no stretch is looked at twice
        start = done + len(text[done:at].rstrip(BEFORE))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def hidden(text: str) -> list[tuple[int, int, int]]:
    """E-mail addresses with "[at]" and "[dot]", found from the former outward."""
    out, done = [], 0
    for m in AT.finditer(text):
        if m.start() < done:
            continue
        start = done + len(text[done : m.start()].rstrip(BEFORE))
        rest = REST.match(text, m.end()) if start < m.start() else None
        if rest:
            out.append((start, 6, rest.end()))
        done = rest.end() if rest else m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base spans, sorted.  A pattern runs only where a text has a character that
    each of its matches needs."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP_ONCE.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which meets a base span or one before it."""
    found = []
    if DIGIT.search(text):
        found += [(m.start(), 4, m.end()) for m in LOCAL.finditer(text)]
        if "-" in text:
            found += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += hidden(text)
    found += [(m.start(), 7, m.end()) for m in NAME.finditer(text) if any(w in GIVEN for w in m[0].lower().split()[:2])]
    if DIGIT.search(text):
        found += [(m.start(), 8, m.end()) for m in STREET.finditer(text)]
    if not found:
        return found
    starts, ends = [t[0] for t in taken], list(accumulate((t[2] for t in taken), max))

    def meets(s) -> bool:
        """Whether a base span that starts before the end of ``s`` reaches beyond its start."""
        k = bisect_left(starts, s[2])
        return k > 0 and ends[k - 1] > s[0]

    out, end = [], 0
    for s in sorted(found):
        if s[0] >= end and not meets(s):
            out.append(s)
            end = s[2]
    return out


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, int, int]:
    """Format, gazetteer and context, each 1 (personal), 0 (nothing) or -1 (not)."""
    start, kind, end = span
    name, body = KINDS[kind], text[start:end]
    topic = {"hidden_email": "email", "local_phone": "phone"}.get(name, name)
    digits = re.sub("[^0-9]", "", body)
    if name in BASE:
        form = 1
    elif name == "local_phone":
        form = -1 if digits[0] in "01" or digits[3] in "01" else 1
    elif name == "ssn":
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    else:
        form = 0 if name in ("name", "address") else 1
    if name in ("name", "address"):
        gazetteer = 1
    elif topic == "email":
        gazetteer = 1 if re.split("[^a-z]+", body.lower())[-1] in ENDINGS else 0
    elif topic == "ip":
        gazetteer = -1 if body.split(".")[0] in ("0", "127", "255") else 0
    elif topic == "card":
        gazetteer = 1 if digits[0] in "3456" else 0
    else:
        gazetteer = -1 if len(set(digits)) <= 2 else 0
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - AROUND) : start].lower())
    context = 1 if any(w in WORDS[topic] for w in before) else 0
    return form, gazetteer, context


def estimate(counts: dict[tuple[int, int, int, int], int], rounds: int = 100) -> dict[tuple[int, int, int, int], float]:
    """EM over (kind, votes): the chance of "personal" for each pattern.

    Labellers have chances of their three votes in each class, shared by the kinds, each kind its own share; strong
    pseudo-counts say that a vote is right more often than wrong."""
    if not counts:
        return {}
    keys = sorted(counts)
    kind = np.array([k[0] for k in keys])
    v = np.array([k[1:] for k in keys]) + 1
    n = np.array([counts[k] for k in keys], float)
    start = np.array([[0.6, 0.35, 0.05], [0.05, 0.35, 0.6]])
    weight = 0.2 * n.sum() + 10
    chance = np.repeat(start[:, None, :], 3, axis=1)
    share = np.array([0.95 if k < len(BASE) else 0.5 for k in range(len(KINDS))])
    post = share[kind]
    for _ in range(rounds):
        logs = np.log(chance)
        gap = np.log(share[kind] / (1 - share[kind])) + (logs[1][np.arange(3), v] - logs[0][np.arange(3), v]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(3):
                got = np.array([(w * (v[:, j] == s)).sum() for s in range(3)]) + weight * start[c]
                chance[c, j] = got / got.sum()
        for k in range(len(KINDS)):
            at = kind == k
            share[k] = ((n * post)[at].sum() + 5 * (0.95 if k < len(BASE) else 0.5)) / (n[at].sum() + 5)
        if moved < 1e-9:
            break
    return dict(zip(keys, post.tolist(), strict=True))


def _design(kind: int, v: tuple[int, int, int]) -> list[float]:
    return [*(float(kind == k) for k in range(len(KINDS))), *(float(x == s) for x in v for s in (-1, 1)), float(v[0] == 1 and v[2] == 1)]


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of the span classifier, from the vote patterns of all candidates of the corpus."""
    small_batches(docs.sparkSession)

    def run(batches):
        seen: dict = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                base = base_spans(t)
                for s in (*base, *loose_spans(t, base)):
                    key = (s[1], *votes(t, s))
                    seen[key] = seen.get(key, 0) + 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(4)), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "a", "b", "c", "n"])

    rows = docs.select(text_of(text_col).alias("t")).mapInArrow(run, "kind int, a int, b int, c int, n long").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()  # 27 a kind
    counts = {(r["kind"], r["a"], r["b"], r["c"]): r["n"] for r in rows}
    post = estimate(counts)
    size = len(_design(0, (0, 0, 0)))
    w = np.zeros(size)
    if not post:
        return w
    keys = sorted(post)
    x = np.array([_design(k[0], k[1:]) for k in keys])
    y, n = np.array([post[k] for k in keys]), np.array([counts[k] for k in keys], float)
    n = n / n.sum() * 1000
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(size), x.T @ (n * (p - y)) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def find_spans(text: str, weights: np.ndarray, least: float = 0.8) -> tuple[list, list]:
    """(base spans, all spans): the loose candidates that the classifier takes join the base ones, which always stay."""
    base = base_spans(text)
    more = [s for s in loose_spans(text, base) if 1 / (1 + np.exp(-float(np.dot(_design(s[1], votes(text, s)), weights)))) >= least]
    return base, sorted(base + more)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans.  Repeated rows are searched each, whole texts always; other columns are
    ignored; an empty table gives an empty one."""
    weights = fit(docs, text_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            found = [find_spans(t, weights) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_join(a) for _, a in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
