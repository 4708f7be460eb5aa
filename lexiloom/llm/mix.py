"""Mixing sources to target weights along a time-varying curriculum.

Method. Each source has a weight schedule over training time 0..1. Its integral, scaled
to the source's demand of tokens, says how many of its tokens are due by any time;
inverted, it gives each document copy, by the tokens of its source before it, a position
in training. Sorting by position (a range sort) interleaves the sources as scheduled.

The running number of tokens within a source is a two-level prefix sum: documents fall
into hash buckets of bounded size, the buckets' totals are summed first, and only a
bucket is ever ordered in one task, however large its source is.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiloom.llm.tokens import TOKENIZER, TOKENIZER_DIR, token_counts
from lexiloom.session import checkpointed

#: Documents of one bucket of the prefix sum, about; more where a source is so large that
#: its buckets' totals would be more than the rows of a bucket.
BUCKET = 20_000
#: Most rows of the list of targets, which is read to the driver.
MOST_SOURCES = 100_000

Schedule = list[tuple[float, float]]


def default_schedule(share: float) -> Schedule:
    """Large sources fade from 1.25 to 0.75 of their mean weight, small ones rise."""
    return [(0.0, 1.25), (1.0, 0.75)] if share >= 0.1 else [(0.0, 0.75), (1.0, 1.25)]


def integrate(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """The segments ``(t0, t1, w0, w1, done)`` of a piecewise linear schedule.

    ``done`` is the share of the whole integral that lies before ``t0``; the weights are
    scaled so that the integral over 0..1 is 1.
    """
    knots = sorted(schedule)
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs knots from 0 to 1 with weights of 0 or more")
    areas = [(b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    if total <= 0:
        raise ValueError("a schedule must have weight somewhere")
    out, done = [], 0.0
    for ((a, v), (b, w)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        out.append((a, b, v / total, w / total, done))
        done += area / total
    return out


def invert(share: Column, segments: Column) -> Column:
    """The time by which ``share`` of a source's tokens are due."""
    seg = F.element_at(F.filter(segments, lambda s: s["done"] <= share), -1)
    slope = (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
    rest = share - seg["done"]
    # w0 x + slope x^2 / 2 = rest, in the form that is stable for a slope near 0
    x = 2 * rest / (seg["w0"] + F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * slope * rest, F.lit(0.0))))
    return F.when(rest <= 0, seg["t0"]).otherwise(F.least(seg["t0"] + x, seg["t1"]))


def demands(supply: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, float]:
    """Tokens to take of each source.

    ``total`` None: the largest mix in which all sources with documents have exactly
    their share. A larger ``total`` fills sources up to their cap, and gives what they
    lack to the others in proportion to their shares.
    """
    live = {s: (w, supply[s] * max(1, r)) for s, w, r in targets if supply.get(s, 0) > 0 and w > 0}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    if total is None:
        total = min(cap * weight / w for w, cap in live.values())
    out: dict[str, float] = {}
    open_, left = dict(live), min(float(total), float(sum(c for _, c in live.values())))
    while open_:
        unit = left / sum(w for w, _ in open_.values())
        full = {s: c for s, (w, c) in open_.items() if w * unit >= c * (1 - 1e-12)}
        if not full:
            return out | {s: w * unit for s, (w, _) in open_.items()}
        out |= {s: float(c) for s, c in full.items()}
        left -= sum(full.values())
        open_ = {s: v for s, v in open_.items() if s not in full}
    return out


def sized_documents(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every row; only the numbers leave the encoder."""
    return token_counts(documents, ["doc_id", "source"], folder, name)


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """The mix in training order: ``(position, source, doc_id, copy_no, n_tokens, due_tokens)``.

    Whole documents are taken in hash order until a source's demand is met; after all
    are taken the source starts over, at most ``max_repeats`` times. ``position`` is in
    0..1, ``due_tokens`` the source's tokens before the document. Sources without target
    or without tokens, documents without source and those without tokens have no part.
    ``targets`` is a small list (one row per source) and is read to the driver, as are
    its sources' sums; more than ``MOST_SOURCES`` rows are an error. So is a source that
    is named twice.
    """
    rows = [(r["source"], float(r["target_share"] or 0.0), int(r["max_repeats"] or 1)) for r in targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    if len({s for s, _, _ in rows}) < len(rows):
        raise ValueError("a source has two targets")
    names = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s, _, _ in rows], "source string")) if rows else None
    docs = sized.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    if names is not None:
        docs = docs.join(names, "source", "left_semi")
    sums = {r["source"]: (r["t"], r["n"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()} if rows else {}
    take = demands({s: t for s, (t, _) in sums.items()}, rows, total)
    shares = {s: w for s, w, _ in rows}
    plan_rows = [
        (s, float(take[s]), int(sums[s][0]), max(1, -(-int(sums[s][1]) // max(BUCKET, isqrt(int(sums[s][1]))))), [dict(zip(("t0", "t1", "w0", "w1", "done"), g, strict=True)) for g in integrate((schedules or {}).get(s) or default_schedule(shares[s]))])
        for s in take
    ]
    segment = T.StructType([T.StructField(c, T.DoubleType()) for c in ("t0", "t1", "w0", "w1", "done")])
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("demand", T.DoubleType()), T.StructField("supply", T.LongType()), T.StructField("buckets", T.IntegerType()), T.StructField("segments", T.ArrayType(segment))])
    plan = F.broadcast(sized.sparkSession.createDataFrame(plan_rows, kind))

    order = F.xxhash64("doc_id", "source")
    placed = docs.join(plan, "source").withColumn("h", order).withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets")).cast("int"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before_in_bucket", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    totals = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("offset"))
    placed = placed.join(offsets, ["source", "bucket"]).withColumn("before", F.col("offset") + F.col("before_in_bucket"))
    # copy c starts c times the supply later; it is taken if it starts before the demand ends
    copies = F.ceil((F.col("demand") - F.col("before")) / F.col("supply")).cast("int")
    taken = placed.filter(copies > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies - 1)))
    due = F.col("before") + F.col("copy_no") * F.col("supply")
    out = taken.withColumn("due_tokens", due).withColumn("position", invert(F.col("due_tokens") / F.col("demand"), F.col("segments")))
    return out.select("position", "source", "doc_id", "copy_no", "n_tokens", "due_tokens").orderBy("position", "source", "doc_id", "copy_no")


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either side: target and actual share, tokens, documents, most copies."""
    got = checkpointed(mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("copy_no") + 1).alias("most_copies")))
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("documents"))
    whole = got.agg(F.sum("tokens")).first()[0] or 1
    both = targets.select("source", "target_share", "max_repeats").join(supply, "source", "full").join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return both.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("supply", F.lit(0)).alias("supply_tokens"),
        tokens.alias("mixed_tokens"),
        F.coalesce("rows", F.lit(0)).alias("mixed_rows"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(tokens / F.lit(whole), 6).alias("actual_share"),
    )
