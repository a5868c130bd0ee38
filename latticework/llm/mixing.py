"""Mixing sources to target weights by balanced (cube-method) sampling."""

from __future__ import annotations

import bisect
import math
import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, ranked, release

#: Units that one flight handles at most, about; larger strata are cut into chunks by a hash.
CHUNK = 4096
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000


def flight(size: list[float], p: list[float], rng: random.Random) -> list[float]:
    """Flight phase: move p through the null-space of (count, size) until two units at most stay fractional.

    Each step takes three fractional units, a direction that changes neither sum(p) nor sum(size * p), and
    goes to one of its two ends, each as likely as keeps every expected p as it was.
    """
    p, open_, eps = list(p), [], 1e-9
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = 0.0 if p[i] <= eps else 1.0
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            top = max(map(abs, u))
            u = tuple(x / top for x in u) if top else (1.0, -1.0, 0.0)
            up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(open_, u, strict=True) if abs(x) > 1e-12)
            down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(open_, u, strict=True) if abs(x) > 1e-12)
            step = up if rng.random() * (up + down) < down else -down
            left = []
            for i, x in zip(open_, u, strict=True):
                p[i] += step * x
                if p[i] <= eps or p[i] >= 1 - eps:
                    p[i] = 0.0 if p[i] <= eps else 1.0
                else:
                    left.append(i)
            if len(left) == 3:  # rounding: the unit nearest to an end goes there
                near = min(left, key=lambda i: min(p[i], 1 - p[i]))
                p[near] = float(p[near] >= 0.5)
                left.remove(near)
            open_ = left
    return p


def landing(size: list[float], p: list[float]) -> list[float]:
    """Decide the few fractional units left: the subset whose tokens, then documents, come nearest to expected.

    What tokens are then still missing or over, one exchange of a taken for an untaken unit takes up as far as
    it can; the number of documents stays.
    """
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    want, docs = sum(size[i] * p[i] for i in open_), sum(p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(want - sum(size[i] for j, i in enumerate(open_) if m >> j & 1)), abs(docs - bin(m).count("1")), m))
    out = list(p)
    for j, i in enumerate(open_):
        out[i] = float(best >> j & 1)
    over = sum(s * x for s, x in zip(size, out, strict=True)) - sum(s * x for s, x in zip(size, p, strict=True))
    taken = sorted((size[i], i) for i, x in enumerate(out) if x == 1)
    free = sorted((size[i], i) for i, x in enumerate(out) if x == 0)
    gain, swap = abs(over), None
    for s, i in taken if free else []:
        at = bisect.bisect_left(free, (s - over, -1))
        for f, j in free[max(0, at - 1) : at + 1]:
            if abs(over - s + f) < gain - 1e-9:
                gain, swap = abs(over - s + f), (i, j)
    if swap:
        out[swap[0]], out[swap[1]] = 0.0, 1.0
    return out


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "order", "id"], ascending=[False, True, True], kind="stable", na_position="last", ignore_index=True)
        size = pdf["weight"].astype(float).tolist()
        seed = zlib.crc32(np.array([len(size), int(sum(size)) & 0xFFFFFFFF, int(pdf["order"].iloc[0]) & 0xFFFFFFFF], np.uint64).tobytes())
        p = flight(size, pdf["p"].tolist(), random.Random(seed))
        return pdf.assign(p=landing(size, p) if last else p)

    return run


def targets(units: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: share * all sizes by repeating weights in order of source (nulls last).

    A target stops at cap * its source's size and the excess goes to the others by weight: the fixed point is
    target = min(cap * size, level * weight). Each round is one aggregate of the source table that brings two
    numbers to the driver.
    """
    by = ranked(units.groupBy("source").agg(F.sum("weight").cast("long").alias("source_size"), F.count("*").alias("n")), "source", "rank")
    by = materialize(by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    full = F.lit(cap) * F.col("source_size")
    while True:
        done = (F.lit(level) * F.col("w") >= full) if level else F.lit(False)
        r = by.agg(F.sum(F.when(done, full)), F.sum(F.when(~done, F.col("w")))).first()
        if not r[1]:
            break
        up = (share * total - (r[0] or 0.0)) / r[1]
        if up <= level * (1 + 1e-12):
            break
        level = up
    return by.select("source", "source_size", "n", F.least(full, F.lit(level) * F.col("w")).cast("double").alias("target"))


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, id, size, rows, source_size, target, copies: how often the mix takes each of the `rows` documents of a unit.

    A unit is a distinct (source, id, size); rows that repeat one share its decision and weigh as many times.
    A source at rate r = target / source_size takes each unit floor(r) times and once more with probability
    r - floor(r), drawn by the cube method: chunks of the source fly first, what stays fractional (two units a
    chunk) flies again in ever fewer chunks, and the last two land. Token and document totals hold up to that
    landing. All random numbers come from the rows, so reruns agree. Sizes count runs of non-white-space;
    null texts have size 0 and are taken 0 words; null sources form a source of their own.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    units = materialize(
        docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), size.alias("size"))
        .groupBy("source", "id", "size").agg(F.count("*").alias("rows")).withColumn("weight", F.col("size") * F.col("rows"))
    )
    by = materialize(targets(units, weights, share, cap))
    few = by.count() <= BROADCAST_SOURCES
    table = by.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (
        units.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rate", F.least(rate, F.lit(cap))).withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        .withColumn("order", F.xxhash64("id", "size"))
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("long"))
        .select("source", "id", "size", "rows", "weight", "source_size", "target", "whole", "p", "order", "chunks")
    )
    open_ = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9) & (F.col("weight") > 0)
    settled = [rated.where(~open_).withColumn("p", F.round("p")).drop("chunks")]
    rest, spent = rated.where(open_), []
    most = int(by.agg(F.max(F.ceil(F.col("n") / CHUNK))).first()[0] or 1)
    schema = rated.schema
    while True:
        last = most <= 1
        flown = materialize(rest.groupBy("source", F.expr("pmod(xxhash64(order), chunks)")).applyInPandas(_fly(last), schema))
        spent.append(flown)
        settled.append((flown if last else flown.where(~open_)).drop("chunks"))
        if last:
            break
        # two units of each chunk stay: so many fewer chunks take them up next
        rest = flown.where(open_).withColumn("chunks", F.ceil(F.col("chunks") * 2 / CHUNK).cast("long"))
        most = math.ceil(most * 2 / CHUNK)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("source", "id", "size", "rows", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with size, source_size, target, copies appended; see mix_decisions.

    Every row stays, repeated ones and those of null ids, texts or sources too; an empty table gives none. Extra columns
    stay, whatever their names, except that those called as a new one are replaced.
    """
    new = ["size", "source_size", "target", "copies"]
    keep = [c for c in docs.columns if c not in new]
    decided = mix_decisions(docs, id_col, text_col, source_col, **how).select(F.struct("source", "id", "size").alias("unit"), "source_size", "target", "copies")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    # the caller's columns travel as one, so that no name of theirs meets a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("s"), F.col(f"`{id_col}`").alias("i"), size.alias("z"))
    on = F.col("i").eqNullSafe(F.col("unit.id")) & F.col("s").eqNullSafe(F.col("unit.source")) & (F.col("z") == F.col("unit.size"))
    return rows.join(decided, on).select(*[F.col("row")[c].alias(c) for c in keep], F.col("z").alias("size"), "source_size", "target", "copies")
