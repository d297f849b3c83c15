"""Event logs as rows: which events a profile keeps, how a line reads, and writing them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels from severe to chatty, and what the views show.
LEVELS = ("error", "warn", "info", "debug", "trace")
_OUTCOMES = ("started", "completed", "failed", "summary", "warning", "error")
PROFILES = {
    "minimal": ("info", "compact", ("run", "diag"), _OUTCOMES),
    "normal": ("info", "normal", ("run", "file", "diag", "cpg", "mark"), _OUTCOMES),
    "diagnostic": ("debug", "diagnostic", None, None),
    "benchmark": ("debug", "benchmark", ("run", "file", "diag", "phase", "memory", "cpg", "mark", "io", "diff"), ("started", "sampled", "completed", "failed", "summary", "snapshot", "pending")),
}
RUN_FIELDS = ("files", "elapsedMs", "edits", "diags", "status")
DIAG_FIELDS = ("diags", "warnings", "errors")
NORMAL_FIELDS = (
    "op", "inputKind", "file", "phase", "dop", "nodes", "edges", "rules", "slowestRule", "slowestMs", "cacheHits", "cacheMisses", "heapBytes", "privateBytes", "committedBytes",
    "fragmentedBytes", "allocBytes", "tpThreads", "tpPending", "tpCompleted", "availableWorkers", "maxWorkers", "syntaxMs", "dataFlowMs", "freezeMs",
)
OPTIONAL = ("op", "inputKind", "inputPath", "src", "file", "phase", "dop")


@dataclass(frozen=True)
class Filter:
    """Categories or events of None mean all of them."""

    level: str = "info"
    view: str = "normal"
    categories: tuple[str, ...] | None = ("file", "phase", "memory", "io")
    events: tuple[str, ...] | None = None

    @classmethod
    def of(cls, profile: str | None = None, **options) -> Filter:
        """Options that are given win over the profile, the profile over the defaults."""
        named = dict(zip(("level", "view", "categories", "events"), PROFILES[profile.strip().lower()])) if profile else {}
        return cls(**{**named, **{k: v for k, v in options.items() if v is not None}})

    def keeps(self) -> Column:
        """Over columns level, category and event."""
        test = F.lower("level").isin(*LEVELS[: LEVELS.index(self.level) + 1])
        for column, allowed in (("category", self.categories), ("event", self.events)):
            if allowed is not None:
                test = test & F.lower(column).isin(*allowed)
        return test


def _value(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.when(c.rlike(r'[\s"\\=]'), quoted).otherwise(c)


def line(view: str = "normal") -> Column:
    """A line over columns ts (string), level, category, event, message, run, the optional ones and fields (map of
    strings); blank values are left out, fields in the order of their names."""
    parts = [F.concat(F.lit(f"{n}="), _value(F.coalesce(c, F.lit("")))) for n, c in (("ts", F.col("ts")), ("lvl", F.upper("level")), ("cat", F.lower("category")), ("evt", F.lower("event")), ("msg", F.col("message")), ("run", F.col("run")))]
    parts += [F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n}="), _value(F.col(n).cast("string")))) for n in OPTIONAL]

    def shown(k: Column) -> Column:
        compact = ((F.lower("category") == "run") & k.isin(*RUN_FIELDS)) | ((F.lower("category") == "diag") & k.isin(*DIAG_FIELDS))
        return {"compact": compact, "normal": compact | k.isin(*NORMAL_FIELDS)}.get(view, F.lit(True))

    pairs = F.filter(F.array_sort(F.map_entries("fields")), lambda x: shown(x["key"]) & (F.trim(x["value"]) != ""))
    fields = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), _value(x["value"]))), " ")
    return F.concat_ws(" ", *parts, F.when(fields != "", fields))


def write(events: DataFrame, kept: Filter, path: str) -> None:
    """Lines of the kept events, in time order over the files."""
    chosen = events.filter(kept.keeps()).select("ts", line(kept.view).alias("value"))
    chosen.repartitionByRange("ts").sortWithinPartitions("ts", "value").select("value").write.mode("errorifexists").text(path)
