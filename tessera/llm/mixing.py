"""Temperature mixing of sources, in DataFrame functions alone.

Weights are token shares to a power: w_i = p_i**a / sum(p**a). The exponent is bisected, inside one
expression over the per-source totals, to the most even mixture that a repetition limit allows, or to a
target entropy. The weights are then realised as passes over each source in a random order, cut where
the source's budget ends and spread evenly over mixing blocks.

Nothing but a row per source is ever gathered: running token sums within a source are made in hash
blocks of about ``ROWS_PER_BLOCK`` rows, whose totals are summed apart, so a source with a third of all
rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, md5_key, only, settle

ROWS_PER_BLOCK = 2048
#: Passes over a source are counted in millionths, so that later sums are whole numbers.
MILLION = 1_000_000


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every whole text (a null text has none)."""
    return only(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")
    )


def _shares(alpha: Column, logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(alpha * x))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _entropy(alpha: Column, logs: Column) -> Column:
    return F.aggregate(_shares(alpha, logs), F.lit(0.0), lambda s, w: s - w * F.ln(w))


def _most_passes(alpha: Column, logs: Column, tokens: Column, budget: int | None) -> Column:
    """Passes over the source that is repeated most."""
    if budget is None:  # the source repeated least is passed over once
        return F.exp((alpha - 1) * (F.array_min(logs) - F.array_max(logs)))
    return F.array_max(F.zip_with(_shares(alpha, logs), tokens, lambda w, t: w * F.lit(float(budget)) / t))


def source_passes(
    counts: DataFrame, max_passes: float = 2.0, entropy: float | None = None, budget: int | None = None, steps: int = 50
) -> DataFrame:
    """A row for each source: source, n_docs, tokens, alpha, weight, passes_ppm, quota (tokens to draw).

    ``budget`` None: as many tokens as pass over every source at least once. With ``entropy`` (nats) the exponent is
    the largest whose mixture has at least that entropy, else the smallest under which no source is passed over more
    than ``max_passes`` times. Both hold to 2**-steps of the exponent. A budget beyond ``max_passes`` of everything is
    cut to that. Sources without a token get weight 0 and one pass. The list of sources must fit a row.
    """
    totals = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    live = F.col("tokens") > 0
    lists = totals.agg(
        F.sort_array(F.collect_list(F.when(live, F.col("tokens").cast("double")))).alias("ts"),
        F.sum(F.col("tokens").cast("double")).alias("total"),
    ).select("ts", "total", F.transform("ts", lambda t: F.ln(t / F.col("total"))).alias("logs"))
    logs, ts = F.col("logs"), F.col("ts")

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = _entropy(mid, logs) >= F.lit(float(entropy)) if entropy is not None else _most_passes(mid, logs, ts, budget) > F.lit(float(max_passes))
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)
    if entropy is not None:
        alpha = F.when(_entropy(F.lit(1.0), logs) >= F.lit(float(entropy)), F.lit(1.0)).otherwise(found["lo"])
    else:
        alpha = F.when(_most_passes(F.lit(0.0), logs, ts, budget) <= F.lit(float(max_passes)), F.lit(0.0)).otherwise(found["hi"])
    solved = lists.select("total", "logs", alpha.alias("alpha"), F.aggregate(F.transform("logs", lambda x: F.exp(alpha * x)), F.lit(0.0), lambda s, x: s + x).alias("z"))
    log = F.ln(F.col("tokens").cast("double") / F.col("total"))
    weight = F.when(live, F.exp(F.col("alpha") * log) / F.col("z")).otherwise(F.lit(0.0))
    passes = F.exp((F.col("alpha") - 1) * (log - F.array_max("logs"))) if budget is None else F.lit(float(budget)) * weight / F.col("tokens").cast("double")
    if entropy is None:
        passes = F.least(passes, F.lit(float(max_passes)))
    ppm = F.when(live, F.floor(passes * MILLION + 0.5)).otherwise(F.lit(MILLION)).cast("long")
    t = F.col("tokens")
    quota = F.expr(f"(tokens div {MILLION}) * passes_ppm + ((tokens % {MILLION}) * passes_ppm) div {MILLION}")
    one = solved.select(F.struct("total", "logs", "alpha", "z").alias("one")).scalar()
    return (
        totals.withColumn("one", one)
        .select("source", "n_docs", "tokens", "one.*")
        .withColumn("weight", weight)
        .withColumn("passes_ppm", ppm)
        .select("source", "n_docs", t, "alpha", "weight", "passes_ppm", quota.alias("quota"))
    )


def plan_mix(counts: DataFrame, passes: DataFrame, seed: int = 0, block_tokens: int = 1_000_000) -> DataFrame:
    """A row for each time a document is drawn: doc_id, source, n_tokens, epoch, start, mix_block, order_key.

    Pass e over a source takes its documents by md5(seed:e:doc_id); ``start`` is the running token sum over all its
    passes. The last, partial pass takes the documents that end within the quota. Mixing block b holds, of every
    source, the draws whose start lies in the b-th equal part of its quota; in a block, order_key gives the order.
    """
    blocks = passes.agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / F.lit(float(block_tokens)))).cast("long").alias("m")).scalar()
    per = passes.select(
        F.col("source").alias("s"), F.col("tokens").alias("t"), "quota", blocks.alias("m"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_BLOCK)).cast("long").alias("n_blocks"),
    )
    # whole passes, then the part of one; a source without tokens is passed over once
    last = F.when(F.col("t") > 0, F.expr("quota div t") - F.when(F.expr("quota % t") == 0, 1).otherwise(0)).otherwise(F.lit(0))
    drawn = (
        counts.join(per, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("quota") > 0) | (F.col("t") == 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("order_key", md5_key(F.lit(seed), F.col("epoch"), F.col("doc_id")))
        .withColumn("part", F.expr("shiftright(cast(conv(substr(order_key, 1, 8), 16, 10) as bigint) * n_blocks, 32)"))
    )
    group = ["s", "epoch", "part"]
    sums = drawn.groupBy(*group).agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.partitionBy("s", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("s").alias("s2"), F.col("epoch").alias("epoch2"), F.col("part").alias("part2"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy(*group).orderBy("order_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        drawn.withColumn("upto", F.sum("n_tokens").over(within))
        .join(offsets, F.col("s").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("epoch2")) & (F.col("part") == F.col("part2")))
        .withColumn("end", F.col("epoch") * F.col("t") + F.col("offset") + F.col("upto"))
        .filter(F.col("end") <= F.col("quota"))
        .withColumn("start", F.col("end") - F.col("n_tokens"))
    )
    place = F.expr("case when quota = 0 then 0 else least(m - 1, cast(start as decimal(20,0)) * m div quota) end").cast("long")
    return placed.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int"), "start", place.alias("mix_block"), "order_key")


def mix_sources(
    docs: DataFrame, max_passes: float = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 0, block_tokens: int = 1_000_000
) -> DataFrame:
    """Draw ``docs`` (doc_id, source, text) to tempered weights; see source_passes and plan_mix for the result.

    Null sources form a source; null and empty texts have no tokens and are drawn where they fall in the order.
    Repeated rows are drawn each by itself. An empty table gives an empty result. Other columns are not read.
    """
    counts = settle(token_counts(docs), "tokens")
    passes = settle(source_passes(counts, max_passes, entropy, budget).coalesce(1), "passes")
    return plan_mix(counts, passes, seed, block_tokens)


def draw_documents(docs: DataFrame, max_passes: float = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as mix_sources draws it; texts are not shuffled.

    Each pass is a prefix of the source's order, so its last key per source and pass, and how many rows with that key are
    drawn, tell which rows are: equal rows at the cut are numbered by their place in the table and cut by number. Nulls
    and empty tables are as in mix_sources; columns of any name are kept.
    """
    counts = settle(token_counts(docs), "tokens")
    passes = settle(source_passes(counts, max_passes, entropy, budget).coalesce(1), "passes")
    own = "_" * (1 + max(map(len, docs.columns)))  # begins no column of docs
    s, epoch, end, drawn, place = (f"{own}{x}" for x in ("s", "epoch", "end", "drawn", "place"))
    d = lambda c: F.coalesce(c, F.lit(-(2**63)))
    ends = (
        plan_mix(counts, passes, seed)
        .groupBy(F.col("source").alias(s), F.col("epoch").alias(epoch), "order_key", d("doc_id").alias("d"), "n_tokens").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(s, epoch).agg(F.max(F.struct("order_key", "d", "n_tokens", "n")).alias("last"))
        .select(s, epoch, F.struct("last.order_key", "last.d", "last.n_tokens").alias(end), F.col("last.n").alias(drawn))
    )
    ends = settle(ends.coalesce(1), "pass_ends")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.struct(md5_key(F.lit(seed), F.col(epoch), F.col("doc_id")).alias("order_key"), d(F.col("doc_id")).alias("d"), n.alias("n_tokens"))
    passed = docs.join(ends, F.col("source").eqNullSafe(F.col(s)))
    before = passed.filter(key < F.col(end))
    last = settle(passed.filter(key == F.col(end)).withColumn(place, F.monotonically_increasing_id()), "cut_rows")
    part = F.shiftright(place, 33)  # the partition that read the row
    sums = last.groupBy(s, epoch, part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(s, epoch).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(s).alias(f"{own}s2"), F.col(epoch).alias(f"{own}epoch2"), F.col("part").alias(f"{own}part2"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(f"{own}ahead"))
    number = F.row_number().over(Window.partitionBy(s, epoch, part).orderBy(place))
    numbered = last.withColumn(f"{own}n", number).withColumn(f"{own}part", part)
    numbered = numbered.join(sums, F.col(s).eqNullSafe(F.col(f"{own}s2")) & (F.col(epoch) == F.col(f"{own}epoch2")) & (F.col(f"{own}part") == F.col(f"{own}part2")))
    cut = numbered.filter(F.col(f"{own}n") + F.col(f"{own}ahead") <= F.col(drawn)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return before.select(*[docs[f"`{c}`"] for c in docs.columns]).unionAll(cut)


ORACLE = rf"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents
), s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS t FROM c GROUP BY source),
tot AS (SELECT sum(t)::DOUBLE AS total FROM s),
p AS (SELECT source, t, ln(t::DOUBLE / total) AS lg FROM s, tot WHERE t > 0),
lim AS (SELECT min(lg) AS lo_l, max(lg) AS hi_l FROM p),
b AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN exp(((lo + hi) / 2 - 1) * (lo_l - hi_l)) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN exp(((lo + hi) / 2 - 1) * (lo_l - hi_l)) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM b, lim WHERE k < 50
), a AS (SELECT CASE WHEN exp(-1 * (lo_l - hi_l)) <= 2.0 THEN 0.0 ELSE hi END AS alpha FROM b, lim WHERE k = 50),
q AS (
  SELECT s.source, s.t, CASE WHEN s.t > 0 THEN floor(least(exp((alpha - 1) * (ln(s.t::DOUBLE / total) - hi_l)), 2.0) * 1000000 + 0.5)::BIGINT ELSE 1000000 END AS ppm
  FROM s, tot, a, lim
), z AS (SELECT source, t, (t // 1000000) * ppm + ((t % 1000000) * ppm) // 1000000 AS quota FROM q),
m AS (SELECT greatest(1, ceil(sum(quota)::DOUBLE / 1000000.0))::BIGINT AS m FROM z),
d AS (
  SELECT c.doc_id, c.source, c.n_tokens, e.epoch, z.t, z.quota, m.m, md5('0:' || e.epoch || ':' || coalesce(c.doc_id::VARCHAR, 'null')) AS order_key
  FROM c JOIN z ON c.source IS NOT DISTINCT FROM z.source, m, (SELECT unnest(range(0, 3)) AS epoch) e
  WHERE CASE WHEN z.t > 0 THEN e.epoch * z.t < z.quota ELSE e.epoch = 0 END
), w AS (
  SELECT *, epoch * t + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY order_key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM d
)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, (upto - n_tokens)::BIGINT AS start,
       CASE WHEN quota = 0 THEN 0 ELSE least(m - 1, ((upto - n_tokens)::HUGEINT * m) // quota) END::BIGINT AS mix_block, order_key
FROM w WHERE upto <= quota
"""
