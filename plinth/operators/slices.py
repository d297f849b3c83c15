"""Backward slices under exact budgets: one ordered search for each sink."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.tables import workers_import

INTERPROCEDURAL = "InterproceduralDataFlow"


@dataclass(frozen=True)
class Budget:
    hops: int = 8
    paths: int = 64
    definitions: int = 64
    call_depth: int = 4
    visited_nodes: int = 4096
    visited_edges: int = 16384
    caller_fanout: int = 64

    def __post_init__(self):
        if self.hops < 0 or self.call_depth < 0 or min(self.paths, self.definitions, self.visited_nodes, self.visited_edges, self.caller_fanout) <= 0:
            raise ValueError("a budget is out of range")


def search(edges: list[tuple[int, int, str, str | None]], sink: int, budget: Budget) -> tuple[list[list[int]], str | None, int, int]:
    """(paths with the source first, first reason for a cut, visited nodes, visited edges) of one sink.

    Edges are (src, dst, kind, call frame).  States leave a queue in the order they came; an edge is looked at in the
    order of (src, kind).  Of states alike in node, hops, depth and call stack the first one stands.
    """
    into: dict[int, list] = {}
    for src, dst, kind, frame in edges:
        into.setdefault(dst, []).append((src, kind, frame if frame is not None else f"edge:{src}>{dst}"))
    for known in into.values():
        known.sort()
    paths, reason, visited, looked, halt = [], None, {sink}, 0, False
    queue = deque([((sink,), budget.hops, budget.call_depth, ())])
    met = {(sink, budget.hops, budget.call_depth, ())}

    def cut_by(why: str) -> None:
        nonlocal reason
        reason = reason or why

    while queue and not halt:
        path, hops, depth, stack = queue.popleft()
        sources = into.get(path[0], [])
        if len({f for _, kind, f in sources if kind == INTERPROCEDURAL}) > budget.caller_fanout:
            cut_by("maxCallerFanout")
            break
        for src, kind, frame in sources:
            if looked >= budget.visited_edges:
                cut_by("maxVisitedEdges")
                halt = True
                break
            looked += 1
            if hops == 0:
                continue
            if len(paths) >= budget.paths:
                cut_by("maxPaths")
                halt = True
                break
            if src in path:
                continue
            deeper, frames = depth, stack
            if kind == INTERPROCEDURAL:
                if depth == 0:
                    cut_by("maxCallDepth")
                    continue
                if frame in stack:
                    cut_by("callStackCycle")
                    continue
                deeper, frames = depth - 1, (*stack, frame)
            state = (src, hops - 1, deeper, frames)
            if state in met:
                continue
            met.add(state)
            if len(visited) >= budget.visited_nodes:
                cut_by("maxVisitedNodes")
                halt = True
                break
            visited.add(src)
            queue.append(((src, *path), hops - 1, deeper, frames))
        if halt:
            break
        if not sources or hops == 0:
            if len(paths) >= budget.paths:
                cut_by("maxPaths")
                break
            paths.append(list(path))
            if sources:
                cut_by("maxHops")
            elif len(paths) >= budget.definitions:
                cut_by("maxDefinitions")
                break
    unique = sorted({tuple(p) for p in paths}, key=lambda p: (p[0], p[-1], "\u001f".join(map(str, p))))
    return [list(p) for p in unique], reason, len(visited), looked


def backward_budgeted(edges: DataFrame, budget: Budget) -> DataFrame:
    """One row for each sink: paths, reason, visited nodes and edges.

    ``edges`` has (sink, src, dst, kind, frame): the part of the graph that a sink may see, as one group.  A group is
    bounded by the edges within the hops of its sink; sinks are searched in parallel.
    """

    workers_import(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(s), int(d), k, f if isinstance(f, str) else None) for s, d, k, f in zip(pdf.src, pdf.dst, pdf.kind, pdf.frame, strict=True)]
        paths, reason, nodes, looked = search(rows, int(pdf.sink.iloc[0]), budget)
        return pd.DataFrame({"sink": [int(pdf.sink.iloc[0])], "paths": [paths], "reason": [reason], "visited_nodes": [nodes], "visited_edges": [looked]})

    return edges.select("sink", "src", "dst", "kind", F.col("frame").cast("string").alias("frame")).groupBy("sink").applyInPandas(run, "sink long, paths array<array<long>>, reason string, visited_nodes long, visited_edges long")
