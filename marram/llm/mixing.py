"""Mixing sources to target weights: each source gives the words its share of the budget asks for.

1. Targets: sources share the budget by weight, each up to a multiple of its size; what is beyond is shared again.
   In the order of size over weight the sources at their limit come first, so running totals find the level.
2. Counts: documents are counted by exact size in each source. A source's target is a number of whole passes and a
   rest; of the rest, every size first gives its proportional part.
3. What then is left of the budget, a small part, is fitted as a bounded subset sum over the documents not yet taken:
   the largest that fit while it is beyond the table, then dynamic programming over all sums, with counts split
   in powers of two. Sums are the bits of one integer, and each sum keeps the part that reached it first.
4. Of each size the documents with the smallest seeded hashes are taken. Their order is found in bins of a bounded
   number of documents (a size has the square root of its documents in bins), so one size, or one id, may hold any part of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.operators.order import before
from marram.sources.shared import materialise, pick

#: Weights of the sources in the order of their names, repeating; the budget in percent of all sizes; the most passes over a source.
WEIGHTS, BUDGET, PASSES = (3, 1, 2), 150, 2
#: Bits of the table of sums, and rows made at once of one that is repeated.
SUMS, ROWS = 1 << 18, 1 << 16


def size_of(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: int = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) of (source, source_size): weights go round in the order of the names, null last.

    min(passes * size, level * weight), at the level where the targets use up the budget; that is what sharing the excess again and again comes to.
    A budget beyond all limits gives each source its limit.
    """
    ordered = before(sizes, [F.col("source").asc_nulls_last()], "place")
    of = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = ordered.select("source", "source_size", of.cast("long").alias("weight"))
    # At its limit as long as the budget, less the limits before it, is more than all weights from here on take at this source's own level.
    by_level = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    rows = before(rows, by_level, "full", F.col("source_size") * passes)
    rows = before(rows, by_level, "used", F.col("weight"))
    total = rows.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    left, share = F.col("all_sizes") * budget / 100 - F.col("full"), F.col("all_weights") - F.col("used")
    limited = F.col("source_size").cast("double") * passes * share <= left * F.col("weight")
    rows = rows.withColumn("limited", limited).withColumn("left", left).withColumn("share", share)
    level = rows.where(~F.col("limited")).agg(F.max(F.struct(F.col("share"), (F.col("left") / F.col("share")).alias("level"))).alias("first"))
    rows = rows.crossJoin(F.broadcast(level))  # one row
    target = F.when(F.col("limited"), (F.col("source_size") * passes).cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come as near to the budget as they can; the smaller sum if two are as near.

    Lengths are distinct and positive. Budgets beyond the table of sums are first filled with the longest documents that fit.
    """
    taken = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for k in order.tolist():
        if budget <= SUMS // 2:
            break
        taken[k] = min(int(counts[k]), (budget - SUMS // 2) // int(lengths[k]) + 1, budget // int(lengths[k]))
        budget -= int(taken[k]) * int(lengths[k])
    free = counts - taken
    most = min(2 * budget, SUMS)
    usable = [k for k in order.tolist() if free[k] and lengths[k] <= most]
    if budget <= 0:
        return taken
    full, reached, parts = (1 << (most + 1)) - 1, 1, []
    by = np.full(most + 1, -1, np.int64)  # the part that reached a sum first
    for k in usable:
        length, n, copies = int(lengths[k]), int(min(free[k], most // lengths[k])), 1
        while n and not reached >> budget & 1:
            copies = min(copies, n)
            if copies * length <= most:
                fresh = (reached << copies * length) & full & ~reached
                if fresh:
                    bits = np.unpackbits(np.frombuffer(fresh.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                    by[np.flatnonzero(bits)] = len(parts)
                    reached |= fresh
                    parts.append((k, copies, length))
            n, copies = n - copies, copies * 2
        if reached >> budget & 1:
            break
    sums = np.concatenate([[0], np.flatnonzero(by >= 0)])
    at = int(sums[np.argmin(np.abs(sums - budget))])
    longer = [k for k in order.tolist() if free[k] and lengths[k] > most and abs(int(lengths[k]) - budget) < abs(at - budget)]
    if longer:  # one document beyond the table comes nearest
        taken[longer[-1]] += 1
        return taken
    while at:
        k, copies, length = parts[by[at]]
        taken[k] += copies
        at -= copies * length
    return taken


def _choices(counted: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, docs, base, extra): passes over all documents of a size, and how many of them are taken once more."""
    rows = counted.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rest = F.col("goal") - F.col("base") * F.col("source_size")
    rows = rows.where(F.col("size") > 0).select("*", rest.alias("rest"))
    # The proportional part of each size, rounded down, in whole numbers, as products pass 2^53.
    part = F.expr("cast(docs as decimal(19,0)) * cast(rest as decimal(19,0)) div cast(source_size as decimal(19,0))").cast("long")
    rows = rows.select("source", "size", "docs", "base", "rest", part.alias("part"))

    def fill(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("size")
        left = int(some["rest"].iloc[0]) - sum(a * b for a, b in zip(some["size"].tolist(), some["part"].tolist(), strict=True))
        more = fit(some["size"].to_numpy(), (some["docs"] - some["part"]).to_numpy(), left)
        return pd.DataFrame({"source": some["source"], "size": some["size"], "docs": some["docs"], "base": some["base"], "extra": some["part"] + more})

    # A group is a source's distinct sizes: fewer than the square root of twice its words.
    return rows.groupBy("source").applyInPandas(fill, "source string, size long, docs long, base long, extra long")


def plan(
    docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, budget: int = BUDGET, passes: int = PASSES, seed: int = 42
) -> DataFrame:
    """(doc_id, source, print, size, rows, source_size, target, base, extra): documents that are equal in all of it, how many there are, and how often each is taken.

    Each of the rows is taken `base` times and `extra` of them once more; `print` is a hash of the text. Words taken come to within half the
    smallest document of the target where sizes allow it. A null or empty text has size 0 and is never taken; a null source is one
    source, the last; null doc_ids and repeated rows count like any other; very long texts count whole; a source without words has target 0; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = pick(docs, doc_id="long", text="string", source="string").select("doc_id", "source", F.xxhash64("text").alias("print"), size_of("text").alias("size"))
    rows = materialise(rows.groupBy("doc_id", "source", "print", "size").agg(F.count("*").alias("rows")), "sizes")
    counted = materialise(rows.groupBy("source", "size").agg(F.sum("rows").alias("docs")), "counted")
    per_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = materialise(targets(per_source, weights, budget, passes), "targets")
    whole = F.round("target").cast("long")
    base = F.least(F.lit(passes), F.floor(whole / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    goal = goals.select(F.col("source").alias("of"), "source_size", whole.alias("goal"), base.alias("base"))
    choices = materialise(_choices(counted, goal), "choices")
    return _selected(rows, choices, goals, seed)


def _selected(rows: DataFrame, choices: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """The documents of smallest hash of each size, by bins of hashes: bins before the cut are taken whole, those after it not at all, and the bin at the cut is ordered."""
    u = choices.select(F.col("source").alias("u_source"), F.col("size").alias("u_size"), "docs", "base", "extra")
    joined = rows.join(u, F.col("source").eqNullSafe(F.col("u_source")) & (F.col("size") == F.col("u_size")), "left").drop("u_source", "u_size")
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "print")
    bins = F.ceil(F.sqrt("docs"))
    joined = joined.select("*", h.alias("h")).withColumn("bin", F.pmod(F.shiftrightunsigned("h", 20), bins))
    joined = materialise(joined, "binned")
    key = ["source", "size", "bin"]
    held = joined.where("extra > 0").groupBy(*key).agg(F.sum("rows").alias("held"), F.first("extra").alias("wanted"))
    # A window has the bins of one size, and a bin as many documents, about: the square root of those of the size.
    order = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("earlier", F.coalesce(F.sum("held").over(order), F.lit(0)))
    quota = held.select(*[F.col(k).alias(f"b_{k}") for k in key], F.greatest(F.least(F.col("wanted") - F.col("earlier"), F.col("held")), F.lit(0)).alias("quota"), "held")
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bin") == F.col("b_bin"))
    met = joined.join(quota, same, "left").drop("b_source", "b_size", "b_bin")
    whole = met.where("quota IS NULL OR quota = 0 OR quota = held").select("*", F.when(F.col("quota") > 0, F.col("rows")).otherwise(F.lit(0)).cast("long").alias("more"))
    inside = Window.partitionBy(*key).orderBy("h", F.col("doc_id").asc_nulls_last(), "print").rowsBetween(Window.unboundedPreceding, -1)
    cut = met.where("quota > 0 AND quota < held").withColumn("ahead", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    cut = cut.select(*met.columns, F.greatest(F.least(F.col("quota") - F.col("ahead"), F.col("rows")), F.lit(0)).cast("long").alias("more"))
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    out = whole.union(cut).join(g, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("doc_id", "source", "print", "size", "rows", "source_size", "target", F.coalesce("base", F.lit(0)).cast("long").alias("base"), F.col("more").alias("extra"))


def _repeated(rows: DataFrame, times: str, name: str) -> DataFrame:
    """Each row so many times, numbered from 1, without a list of all numbers."""
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / ROWS))).alias("__block"))
    first = F.col("__block") * ROWS
    return blocks.select("*", F.explode(F.sequence(first + 1, F.least(first + ROWS, F.col(times)))).alias(name)).drop("__block")


def per_row(planned: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every row; of equal rows the first `extra` have one more copy."""
    row = _repeated(planned, "rows", "k")
    copies = F.col("base") + (F.col("k") <= F.col("extra")).cast("long")
    return row.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))


def mix(docs: DataFrame, carry: dict[str, str] | None = None, **settings) -> DataFrame:
    """The mixed documents (doc_id, text, source and the columns to carry), each as often as the plan takes it. Equal rows are kept once until they are repeated."""
    planned = plan(docs, **settings).select("doc_id", "source", "print", (F.col("base") * F.col("rows") + F.col("extra")).alias("copies")).where("copies > 0")
    names = ["doc_id", "source", *(c for c in carry or {} if c not in ("doc_id", "source", "text"))]
    kept = pick(docs, **({"doc_id": "long", "text": "string", "source": "string"} | (carry or {}))).withColumn("print", F.xxhash64("text"))
    kept = kept.groupBy("doc_id", "source", "print").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in names[2:]])
    named = planned.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("print").alias("p_print"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("print") == F.col("p_print"))
    return _repeated(kept.join(named, same), "copies", "copy").select("doc_id", "text", *names[1:])
