"""Byte-level BPE in DuckDB, inside each partition: words as rows that join the table of merges.

Words are what the splitting pattern finds.  A recursive query contracts, in every word at once, the leftmost pair of
least rank until no pair merges; a word is one row, with its tokens and the ranks of their pairs, so that a round looks
up the two pairs beside the new token only.  A word over LONG bytes is contracted in overlapping parts of that size.  Two parts are
joined at a border that both have and that stands when the two tokens beside it are contracted as one word: tokens whose
neighbours all stand so are those of the whole word, as a merge over a border would happen in the pair of tokens too.
Parts without such a border become one part, for which a query contracts all pairs of the least rank up to the first one
that makes a pair of lower rank; so work grows with the length of a word.  Ordered aggregations give the ids of a word
and, from the ids, its decoded bytes; the parts of a document follow one another in its own order, joined by column.
Only words that the worker has not seen lately reach DuckDB, whose scratch files (within one query) lie in the worker's temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerations, read, small_batches, text_of

RANKS = "byte_bpe_50k.tiktoken"
LONG, STEP = 48, 24
CACHED = 700_000
#: Texts are handled in groups of about so many characters, and words of so many bytes at once in DuckDB.
GROUP, AT_ONCE = 6_000_000, 700_000

#: White characters, as the pattern's \\s knows them; texts where a part is more than one of them and what follows.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = rf"{_WHITE}{{3}}|{_WHITE}{{2}}\z"

_SHIFT = 36
_P = 1 << _SHIFT  # positions of a word
_POS, _W = f"& {_P - 1}", f">> {_SHIFT}"

#: The rank of a pair that does not merge.
_NONE = 1 << 20

_SHORT = f"""
WITH RECURSIVE s(w, toks, ranks, r) AS (
  SELECT w, toks, ranks, list_min(ranks) FROM seed
  UNION ALL
  SELECT w, toks, ranks, list_min(ranks) FROM (
    SELECT w, list_concat(list_concat(toks[1:k - 1], [r]), toks[k + 2:]) AS toks,
           list_concat(list_concat(ranks[1:k - 2], [CAST(coalesce(ml.rank, {_NONE}) AS INTEGER), CAST(coalesce(mr.rank, {_NONE}) AS INTEGER)]), ranks[k + 2:]) AS ranks
    FROM (SELECT *, list_position(ranks, r) AS k FROM s WHERE r < {_NONE})
    LEFT JOIN merges ml ON ml.pair = CAST(toks[k - 1] AS BIGINT) * 65536 + r
    LEFT JOIN merges mr ON mr.pair = CAST(r AS BIGINT) * 65536 + toks[k + 2])
), done AS MATERIALIZED (SELECT w, toks[2:] AS toks FROM s WHERE r = {_NONE})
SELECT len(toks), array_to_string(toks, ' '), hex
FROM done JOIN (
  SELECT w, string_agg(v.hex, '' ORDER BY pos) AS hex
  FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM done) JOIN vocabulary v ON v.id = tok GROUP BY w
) USING (w) ORDER BY w"""

_RUNS = f"""
WITH RECURSIVE s(it, wp, tok) AS (
  SELECT 0, w * {_P} + pos, tok FROM seed
  UNION ALL
  SELECT it + 1, wp - gone, CASE WHEN chosen THEN r ELSE tok END
  FROM (
    SELECT *, count(*) FILTER (WHERE chosen) OVER (PARTITION BY w ORDER BY wp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone,
           lag(chosen, 1, false) OVER (PARTITION BY w ORDER BY wp) AS eaten
    FROM (
      SELECT *, odd AND wp <= coalesce(min(CASE WHEN unsafe THEN wp END) OVER (PARTITION BY w), wp) AS chosen
      FROM (
        SELECT o.*, odd AND (coalesce(ml.rank < r, false) OR coalesce(mr.rank < r, false)) AS unsafe
        FROM (
          SELECT *, CASE WHEN lag(odd, 2, false) OVER (PARTITION BY w ORDER BY wp) THEN r ELSE lag(tok) OVER (PARTITION BY w ORDER BY wp) END AS before,
                 lead(tok, 2) OVER (PARTITION BY w ORDER BY wp) AS after
          FROM (
            SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, island ORDER BY wp) % 2 = 1 AS odd
            FROM (
              SELECT *, coalesce(rank = r, false) AS hit, wp - row_number() OVER (PARTITION BY w, coalesce(rank = r, false) ORDER BY wp) AS island
              FROM (
                SELECT *, min(rank) OVER (PARTITION BY w) AS r
                FROM (SELECT l.it, l.wp // {_P} AS w, l.wp, l.tok, m.rank FROM s l LEFT JOIN s n ON n.wp = l.wp + 1 LEFT JOIN merges m ON m.pair = l.tok * 65536 + n.tok)
              ) WHERE r IS NOT NULL
            )
          )
        ) o LEFT JOIN merges ml ON ml.pair = o.before * 65536 + o.r LEFT JOIN merges mr ON mr.pair = o.r * 65536 + o.after
      )
    )
  ) WHERE NOT eaten
), ends AS (SELECT wp {_W} AS w, max(it) AS last FROM s GROUP BY 1)
SELECT count(*), string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY wp), string_agg(v.hex, '' ORDER BY wp)
FROM s JOIN ends e ON (s.wp {_W}) = e.w AND s.it = e.last JOIN vocabulary v ON v.id = s.tok
GROUP BY e.w ORDER BY e.w"""

_DECODE = """
SELECT string_agg(v.hex, '' ORDER BY pos) FROM ids JOIN vocabulary v ON v.id = ids.tok GROUP BY w ORDER BY w"""


class Encoder:
    """Encodes texts to (number of ids, ids as decimal text, decoded bytes)."""

    def __init__(self, path: str, pattern: str, cap: int = CACHED):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], "i8")
        pairs = {ranks[t[:i]] * 65536 + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.sizes = dict(zip(ranks.values(), map(len, ranks), strict=True))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": f"{tempfile.gettempdir()}/plinth-bpe-{os.getpid()}"})
        self.first = np.array([[pairs.get(a * 65536 + b, _NONE) for b in self.byte.tolist()] for a in self.byte.tolist()], "i4")
        merges = pa.table({"pair": pa.array(list(pairs), pa.int64()), "rank": pa.array(list(pairs.values()), pa.int64())})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "hex": [t.hex() for t in ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.pattern = regex.compile(pattern)
        # the pattern never matches over the border of these parts: white space ends every other alternative
        self.part = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.cache = TwoGenerations(cap)

    def _contract(self, words: list[bytes], sql: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids, decoded bytes) of each word (none is empty), a bounded number of bytes at once."""
        out, at = [], 0
        while at < len(words):
            end, n = at, 0
            while end < len(words) and (n == 0 or n + len(words[end]) <= AT_ONCE):
                n += len(words[end])
                end += 1
            size = np.array([len(w) for w in words[at:end]], "i8")
            spelt = np.frombuffer(b"".join(words[at:end]), "u1")
            self.con.register("seed", self._lists(size, spelt) if sql is _SHORT else self._rows(size, spelt))
            out += [(n, ids, bytes.fromhex(raw)) for n, ids, raw in self.con.execute(sql).fetchall()]
            self.con.unregister("seed")
            at = end
        return out

    def _rows(self, size: np.ndarray, spelt: np.ndarray) -> pa.Table:
        owner = np.repeat(np.arange(len(size)), size)
        return pa.table({"w": owner, "pos": np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size), "tok": self.byte[spelt]})

    def _lists(self, size: np.ndarray, spelt: np.ndarray) -> pa.Table:
        """A row for each word: its tokens after a -1, and the ranks of the pairs that begin with them."""
        cut = np.concatenate(([0], np.cumsum(size + 1)))
        at = np.arange(len(spelt)) + np.repeat(np.arange(1, len(size) + 1), size)
        toks, ranks = np.full(cut[-1], -1, "i4"), np.full(cut[-1], _NONE, "i4")
        toks[at], ranks[at[:-1]] = self.byte[spelt], self.first[spelt[:-1], spelt[1:]]
        ranks[cut[1:] - 1] = _NONE
        lists = (pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values)) for values in (toks, ranks))
        return pa.table([pa.array(np.arange(len(size))), *lists], names=["w", "toks", "ranks"])

    def _ids(self, words: list[bytes], sql: str) -> list[list[int]]:
        return [[int(x) for x in ids.split()] for _, ids, _ in self._contract(words, sql)]

    def _borders(self, start: int, ids: list[int]) -> dict[int, tuple[int, int]]:
        """Each border inside a part, with the tokens before and after it."""
        out, at = {}, start
        for a, b in zip(ids, ids[1:], strict=False):
            at += self.sizes[a]
            out[at] = (a, b)
        return out

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words over LONG bytes, by parts."""
        if not words:
            return []
        parts = [[(s, min(s + LONG, len(w))) for s in range(0, max(1, len(w) - LONG + STEP), STEP)] for w in words]
        ids: list[dict] = [{} for _ in words]
        stands: dict[tuple[int, int], bool] = {}
        spell = {r: t for t, r in self.ranks.items()}
        while True:
            todo = [(k, p) for k, ps in enumerate(parts) for p in ps if p not in ids[k]]
            raw = [words[k][s:e] for k, (s, e) in todo]
            distinct = sorted(set(raw), key=lambda x: (len(x), x))
            short = [x for x in distinct if len(x) <= LONG]
            found = dict(zip(distinct, self._ids(short, _SHORT) + self._ids(distinct[len(short) :], _RUNS), strict=True))
            for (k, p), x in zip(todo, raw, strict=True):
                ids[k][p] = found[x]
            # borders that two neighbouring parts share, and whether the tokens beside them stay apart
            shared, pairs = [], set()
            for k, ps in enumerate(parts):
                borders = [self._borders(s, ids[k][s, e]) for s, e in ps]
                shared.append([])
                for (a, b), (x, y), (s, e) in zip(zip(borders, borders[1:], strict=False), zip(ps, ps[1:], strict=False), ps[1:], strict=False):
                    both = sorted((q for q in b if q in a), key=lambda q: abs(2 * q - x[1] - s))[:4]
                    shared[-1].append([(q, (a[q][0], b[q][1])) for q in both])
                    pairs.update(p for _, p in shared[-1][-1])
            new = sorted(pairs - stands.keys())
            for p, got in zip(new, self._ids([spell[a] + spell[b] for a, b in new], _SHORT), strict=True):
                stands[p] = tuple(got) == p
            done = True
            for k, ps in enumerate(parts):
                seams = [next((q for q, p in options if stands[p]), None) for options in shared[k]]
                if any(q is None for q in seams):
                    done, merged = False, [ps[0]]
                    for p, q in zip(ps[1:], seams, strict=True):
                        if q is None:
                            merged[-1] = (merged[-1][0], p[1])
                        else:
                            merged.append(p)
                    parts[k] = merged
                shared[k] = seams
            if done:
                break
        out = []
        for k, ps in enumerate(parts):
            whole: list[int] = []
            for (s, e), lo, hi in zip(ps, [0, *shared[k]], [*shared[k], len(words[k])], strict=True):
                at = s
                for x in ids[k][s, e]:
                    if lo <= at < hi:
                        whole.append(x)
                    at += self.sizes[x]
            out.append(whole)
        return out

    def words(self, words: list[bytes]) -> dict[bytes, tuple[int, str, bytes]]:
        """(number of ids, ids as decimal text, decoded bytes) of each distinct word."""
        known = {w: [self.ranks[w]] for w in words if w in self.ranks}  # a token as it stands needs no merge
        short = [w for w in words if w not in known and len(w) <= LONG]
        long = [w for w in words if w not in known and len(w) > LONG]
        known.update(zip(long, self._long(long), strict=True))
        out = dict(zip(short, self._contract(short, _SHORT), strict=True))
        order, at = list(known), 0
        while at < len(order):
            end, n = at, 0
            while end < len(order) and (n == 0 or n + len(known[order[end]]) <= AT_ONCE):
                n += len(known[order[end]])
                end += 1
            size = np.array([len(known[w]) for w in order[at:end]], "i8")
            tok = np.concatenate([np.array(known[w], "i8") for w in order[at:end]])
            self.con.register("ids", pa.table({"w": np.repeat(np.arange(len(size)), size), "pos": np.arange(len(tok)), "tok": tok}))
            for w, (raw,) in zip(order[at:end], self.con.execute(_DECODE).fetchall(), strict=True):
                out[w] = (len(known[w]), " ".join(map(str, known[w])), bytes.fromhex(raw))
            self.con.unregister("ids")
            at = end
        return out

    def _parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct parts of some texts, the parts of all texts by number, and where each text's parts begin and end.

        A single blank or line feed begins a part wherever it stands.  Only the last of several white characters before
        another one is a match of its own, so texts with three of them, or two at their end, are cut by ``part``.
        """
        mark = next(c for c in map(chr, range(1, 0x110000)) if c not in " \n" and not any(c in t for t in texts))
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, _UNEVEN).to_numpy(zero_copy_only=False)
        cut = [mark.join(self.part.findall(t)) if odd else t.replace(" ", mark + " ").replace("\n", f"{mark}\n{mark}") for t, odd in zip(texts, uneven.tolist(), strict=True)]
        split = pc.split_pattern(pa.array(cut, pa.large_string()), mark)
        flat = split.flatten().dictionary_encode()
        return flat.dictionary, flat.indices.to_numpy(), split.offsets.to_numpy()

    def _lookup(self, parts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids as decimal text, decoded bytes) of each of some distinct parts."""
        known, missing = self.cache.take(parts)
        if missing:
            split = [self.pattern.findall(p) for p in missing]
            words, unknown = self.cache.take(set().union(*split))
            raw = [w.encode() for w in unknown]
            found = self.words(raw)
            new = {w: found[r] for w, r in zip(unknown, raw, strict=True)}
            words.update(new)
            for p, ws in zip(missing, split, strict=True):
                if len(ws) != 1:
                    new[p] = (sum(words[w][0] for w in ws), " ".join([words[w][1] for w in ws if words[w][0]]), b"".join([words[w][2] for w in ws]))
                else:
                    new[p] = words[ws[0]]
            known.update(new)
            self.cache.put({k: v for k, v in new.items() if len(k) <= 64})
        return [known[p] for p in parts]

    def columns(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For some texts, by column: numbers of ids, ids as decimal text, decoded bytes."""
        if not texts:
            return np.zeros(0, "i8"), pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        distinct, at, cut = self._parts(texts)
        found = self._lookup(distinct.to_pylist())
        n, ids, raw = np.array([x[0] for x in found], "i8"), [x[1] for x in found], [x[2] for x in found]
        if not n.all():  # empty parts
            some = n[at] > 0
            at, cut = at[some], np.concatenate(([0], np.cumsum(some)))[cut]
        total = np.concatenate(([0], np.cumsum(n[at])))[cut]
        at, cut = pa.array(at), pa.array(cut, pa.int64())
        joined = [pc.binary_join(pa.LargeListArray.from_arrays(cut, pa.array(values, kind).take(at)), pa.scalar(between, kind)) for values, kind, between in ((ids, pa.large_string(), " "), (raw, pa.large_binary(), b""))]
        return np.diff(total), *joined

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        n, ids, raw = self.columns(texts)
        return list(zip(n.tolist(), ids.to_pylist(), raw.to_pylist(), strict=True))


def _digests(column: pa.Array) -> pa.Array:
    """SHA-256 of each value, in lowercase hex, read where it stands."""
    _, cut, data = column.buffers()
    cut = np.frombuffer(cut, "i8")[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(data or b"")
    return pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(cut, cut[1:], strict=False)], pa.string())


def _groups(batches):
    """Ids and texts of as many rows as GROUP allows, whatever the batches."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and n + len(text) > GROUP:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(ident)
            texts.append(text)
            n += len(text)
    if texts:
        yield ids, texts


_encoders: dict = {}


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids (decimal, blank between) and decoded bytes.

    Null and empty texts have no ids.  Repeated rows are encoded each, a null id stays null, other columns are ignored.
    Texts and words of any length are encoded whole; characters the pattern does not match (none with the public one) are lost.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def run(batches):
        key = (path, pattern)
        if key not in _encoders:
            _encoders[key] = Encoder(path, pattern)
        encoder = _encoders[key]
        for ids, texts in _groups(batches):
            sizes, found, decoded = encoder.columns(texts)
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _digests(found), _digests(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [found.cast(pa.string()), decoded.cast(pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), with_ids=False)
