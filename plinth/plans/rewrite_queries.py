"""Edit plans over documents, their diffs and replay, and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.tables import read
from plinth.operators import diffs as D
from plinth.plans.registration import query
from plinth.sources import logs, plans

# three edits where a document has room for them: a blanked start, one replaced piece around position 20 and one that the piece contains
_E = """x AS (SELECT doc_id AS file, text FROM documents WHERE length(text) >= 40),
  ed AS (SELECT file, i, file * 4 + i AS edit_id, s, s + n AS e, substring(text, s + 1, n) AS original, CASE i WHEN 0 THEN '' WHEN 1 THEN '<' || file % 7 || '>' ELSE 'inner' END AS replacement
    FROM x, (VALUES (0, 2, 3), (1, 20, 9), (2, 22, 4)) t(i, s, n)),
  ef AS (SELECT * FROM ed WHERE i < 2)"""


def _sources(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")


def _edits(spark, d):
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).cast("long").alias("s"), F.lit(n).alias("n")) for i, s, n in ((0, 2, 3), (1, 20, 9), (2, 22, 4))])
    x = _sources(spark, d).filter(F.char_length("text") >= 40).select("file", "text", F.explode(spans).alias("t")).select("file", "text", "t.*")
    new = F.when(F.col("i") == 0, "").when(F.col("i") == 1, F.concat(F.lit("<"), (F.col("file") % 7).cast("string"), F.lit(">"))).otherwise("inner")
    return x.select("file", (F.col("file") * 4 + F.col("i")).alias("edit_id"), "s", (F.col("s") + F.col("n")).alias("e"), F.substring(F.col("text"), (F.col("s") + 1).cast("int"), F.col("n")).alias("original"), new.alias("replacement"))


@query(f"WITH {_E} SELECT edit_id, file, s, e, original, replacement FROM ef")
def effective_plan(spark, d):
    return D.effective(_edits(spark, d))


@query(f"WITH {_E} SELECT file, 'edits overlap' AS problem FROM x")
def plan_problems(spark, d):
    return D.problems(_edits(spark, d), _sources(spark, d))


@query(f"WITH {_E} SELECT file, text, substring(text, 1, 2) || substring(text, 6, 15) || '<' || file % 7 || '>' || substring(text, 30) AS rewritten FROM x")
def plan_replay(spark, d):
    return D.replay(D.effective(_edits(spark, d)), _sources(spark, d))


_DIFF = "q AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s, e) AS k FROM ef)"


@query(f"WITH {_E}, {_DIFF} SELECT file, string_agg('--- original #' || k || ' ' || file || ':' || s || '..' || e || chr(10) || original || chr(10) || '+++ rewritten #' || k || chr(10) || CASE WHEN replacement = '' THEN '<deleted>' ELSE replacement END || chr(10), chr(10) ORDER BY k) AS diff FROM q GROUP BY file")
def diff_render_plain(spark, d):
    return D.render(D.sections(D.effective(_edits(spark, d))))


@query(f"WITH {_E}, {_DIFF} SELECT file, '=== file ' || file || chr(10) || string_agg('edit #' || k || ' kind=' || CASE WHEN original = '' THEN 'Insert' WHEN replacement = '' THEN 'Delete' ELSE 'Replace' END || ' span=' || s || '..' || e || chr(10) || '--- before' || chr(10) || CASE WHEN original = '' THEN '<empty>' ELSE original END || chr(10) || '+++ after' || chr(10) || CASE WHEN replacement = '' THEN '<deleted>' ELSE replacement END || chr(10), chr(10) ORDER BY k) AS diff FROM q GROUP BY file")
def diff_render_readable(spark, d):
    return D.render(D.sections(D.effective(_edits(spark, d))), readable=True)


@query(f"WITH {_E} SELECT x.file AS \"relativePath\", upper(sha256(any_value(x.text))) AS \"sourceSha256\", count(*) AS n_edits, sum(e - s)::BIGINT AS n_taken FROM ef JOIN x USING (file) GROUP BY 1")
def plan_records(spark, d):
    taken = F.aggregate("edits", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return plans.plans(D.effective(_edits(spark, d)), _sources(spark, d)).select("relativePath", "sourceSha256", F.size("edits").cast("long").alias("n_edits"), taken.alias("n_taken"))


@query("""SELECT event_id, 'ts=' || event_id || ' lvl=' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' cat=run evt=' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END
  || ' msg="' || event_type || ' \\"' || user_id || '\\""' || ' run=r' || user_id % 3 || CASE WHEN event_id % 2 = 0 THEN ' phase=p' || event_id % 5 ELSE '' END
  || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' files=' || event_id % 4 END || ' status="a=b"' AS line FROM events WHERE event_type IN ('error', 'view')""")
def log_lines(spark, d):
    i, bad = F.col("event_id"), F.col("event_type") == "error"
    ev = read(spark, d, "events").select(
        i, i.cast("string").alias("ts"), F.when(bad, "Error").when(F.col("event_type") == "view", "Info").otherwise("Debug").alias("level"), F.lit("Run").alias("category"), F.when(bad, "Failed").otherwise("Completed").alias("event"),
        F.concat("event_type", F.lit(' "'), F.col("user_id").cast("string"), F.lit('"')).alias("message"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run"),
        *[F.lit(None).cast("string").alias(n) for n in logs.OPTIONAL if n != "phase"], F.when(i % 2 == 0, F.concat(F.lit("p"), (i % 5).cast("string"))).alias("phase"),
        F.create_map(F.lit("status"), F.lit("a=b"), F.lit("files"), F.when(i % 4 == 0, " ").otherwise((i % 4).cast("string")), F.lit("nodes"), F.lit("7")).alias("fields"),
    )
    kept = logs.Filter.of("minimal")
    return ev.filter(kept.keeps()).select("event_id", logs.line(kept.view).alias("line"))
