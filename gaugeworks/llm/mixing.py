"""Mixing sources to target weights: a tempered exponent, realised by block permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import table, word_count
from gaugeworks.operators.joins import sized_join
from gaugeworks.session import settle

STEPS = 50
BLOCK_DOCS = 1024
#: Production settings: nats of entropy as a share of the largest possible, and repetitions.
ENTROPY_SHARE = 0.95
MAX_REPEAT = 2.0


def tempered(shares: Sequence[float], exponent: float) -> list[float]:
    """Normalised weights share**exponent; a share of zero keeps weight zero."""
    raised = [share**exponent if share > 0 else 0.0 for share in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: Sequence[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(flat_enough) -> float:
    """Largest exponent in [0, 1] known to be flat enough, after STEPS halvings; at least 0."""
    if flat_enough(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        if flat_enough(middle):
            low = middle
        else:
            high = middle
    return low


def solve_exponent(
    tokens: Sequence[int], budget: int | None, target_entropy: float | None, max_repeat: float | None
) -> float:
    """Exponent of the token shares: as close to 1 as the target entropy allows, but so
    large that no source is repeated more than `max_repeat` times, which has precedence.

    Entropy falls as the exponent grows, and so does the repetition of the smallest source.
    Without a budget, repetition is counted at the one that just uses every source in full.
    """
    total = sum(tokens)
    shares = [n / total for n in tokens if n > 0] if total else []
    if not shares:
        return 1.0
    exponent = 1.0 if target_entropy is not None else 0.0
    if target_entropy is not None:
        exponent = bisect_exponent(lambda a: entropy(tempered(shares, a)) >= target_entropy)
    if max_repeat is not None:

        def repeats_too_often(a: float) -> bool:
            rates = [w / share for w, share in zip(tempered(shares, a), shares, strict=True)]
            scale = budget / total if budget is not None else 1 / min(rates)
            return max(rates) * scale > max_repeat

        exponent = max(exponent, bisect_exponent(repeats_too_often))
        if exponent < 1.0 and repeats_too_often(exponent):
            exponent += 2.0**-STEPS  # the bisected end just inside the limit
    return exponent


def quotas(
    tokens: Sequence[int], budget: int | None, target_entropy: float | None, max_repeat: float | None
) -> list[int]:
    """Tokens each source is to give. Without a budget every source gives all it has at least."""
    total = sum(tokens)
    if not total:
        return [0] * len(tokens)
    exponent = solve_exponent(tokens, budget, target_entropy, max_repeat)
    weights = tempered([n / total for n in tokens], exponent)
    if budget is None:
        scale = max(n / w for n, w in zip(tokens, weights, strict=True) if n)
        return [max(n, math.floor(w * scale)) for n, w in zip(tokens, weights, strict=True)]
    given = [math.floor(w * budget) for w in weights]
    if max_repeat is None:
        return given
    return [min(g, math.floor(n * max_repeat)) for g, n in zip(given, tokens, strict=True)]


def mix_sources(
    docs: DataFrame, *, budget: int | None = None, target_entropy: float | None = None,
    entropy_share: float | None = None, max_repeat: float | None = None,
    tokens: Column | None = None, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Copies of the documents that make up the mixture, with mix_source, mix_epoch,
    mix_tokens, mix_start and mix_quota beside their own columns.

    Shares of the sources' tokens are raised to a bisected exponent (see `solve_exponent`;
    `entropy_share` states the target as a part of the largest entropy) and normalised;
    times the budget they are quotas. Without a budget, the quotas are the smallest that use
    every document. A source's documents are dealt by hash into blocks of about
    `block_docs`; each epoch runs through all blocks in an order of its own, and a copy is
    used if it ends within the quota, mix_start being the tokens before it. Sorted by
    mix_start / mix_quota, the copies interleave at the target weights all along.

    Only the totals per source reach the driver. Windows run within one block, or over one
    source's blocks, never over a source's documents. A null source is a source of its own.
    Null and empty texts have no tokens and ride along with their block; a source without
    any token has weight zero, and its documents are used once if there is no budget, else
    not. Rows that repeat others in id and text are told apart by their place in the table,
    so that they spread over the blocks. An empty table gives an empty one. The documents'
    own columns, whatever their names, come along untouched, but for those named as one of
    the five.
    """
    mixed = _mixed(docs, budget, target_entropy, entropy_share, max_repeat, tokens, block_docs)
    own = [F.col(f"row.`{name}`") for name in docs.columns if name not in _ADDED]
    return mixed.select(*own, *_ADDED)


_ADDED = ["mix_source", "mix_epoch", "mix_tokens", "mix_start", "mix_quota"]


def _mixed(
    docs: DataFrame, budget: int | None, target_entropy: float | None, entropy_share: float | None,
    max_repeat: float | None, tokens: Column | None, block_docs: int,
) -> DataFrame:
    """The mixture with the documents' own columns as one struct, `row`."""
    draw = F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))
    ))
    counted = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("mix_source"),
        (word_count(F.col("text")) if tokens is None else tokens).cast("long").alias("mix_tokens"),
        draw.alias("mix_draw"), F.monotonically_increasing_id().alias("mix_place"),
    )
    totals = counted.groupBy("mix_source").agg(
        F.sum("mix_tokens").alias("total"), F.count(F.lit(1)).alias("n")
    ).orderBy("mix_source").collect()
    spark = docs.sparkSession
    amounts = [row["total"] for row in totals]
    if entropy_share is not None:
        target_entropy = entropy_share * math.log(max(1, sum(n > 0 for n in amounts)))
    given = quotas(amounts, budget, target_entropy, max_repeat)
    plan = [
        (row["mix_source"], row["total"], -(-row["n"] // block_docs), quota,
         1 if not row["total"] else -(-quota // row["total"]))
        for row, quota in zip(totals, given, strict=True)
        if quota > 0 or budget is None
    ]
    plan_table = spark.createDataFrame(
        plan, "mix_source string, total long, mix_blocks long, mix_quota long, epochs long"
    )
    repeated = counted.groupBy("mix_draw").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = settle(repeated.select("mix_draw", F.lit(True).alias("mix_repeated")))
    counted = sized_join(counted, repeated, ["mix_draw"], "left")
    apart = F.md5(F.concat_ws("|", "mix_draw", "mix_place"))
    counted = counted.withColumn("mix_draw", F.when(F.col("mix_repeated"), apart).otherwise(F.col("mix_draw")))
    placed = sized_join(counted, plan_table.select("mix_source", "mix_blocks"), ["mix_source"])
    placed = placed.withColumn(
        "mix_block", F.conv(F.substring("mix_draw", 1, 7), 16, 10).cast("long") % F.col("mix_blocks")
    )
    within = Window.partitionBy("mix_source", "mix_block").orderBy("mix_draw").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = settle(placed.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")))
    placed = placed.withColumn("mix_before", F.coalesce(F.sum("mix_tokens").over(within), F.lit(0)))
    epochs = sized_join(sizes, plan_table, ["mix_source"]).withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))
    )
    order = F.md5(F.concat_ws("|", "mix_source", "mix_epoch", "mix_block"))
    earlier = Window.partitionBy("mix_source", "mix_epoch").orderBy("mix_order").rowsBetween(
        Window.unboundedPreceding, -1
    )
    epochs = epochs.withColumn("mix_order", order).select(
        "mix_source", "mix_block", "mix_epoch", "mix_quota",
        (F.col("mix_epoch") * F.col("total") + F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0))).alias("offset"),
    )
    copies = sized_join(placed, settle(epochs), ["mix_source", "mix_block"])
    copies = copies.withColumn("mix_start", F.col("offset") + F.col("mix_before"))
    return copies.where(F.col("mix_start") + F.col("mix_tokens") <= F.col("mix_quota")).select("row", *_ADDED)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of the mixture at a budget of one pass over all tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    budget = docs.agg(F.sum(word_count(F.col("text"))).alias("n")).first()["n"] or 0
    mixed = mix_sources(docs, budget=budget, entropy_share=ENTROPY_SHARE, max_repeat=MAX_REPEAT)
    return mixed.select(
        "doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_start").alias("start"), F.col("mix_quota").alias("quota"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production settings without a budget: every document at least once, smaller sources
    up to MAX_REPEAT times. All columns stay as they are."""
    return _mixed(docs, None, None, ENTROPY_SHARE, MAX_REPEAT, None, BLOCK_DOCS).select("row.*")


QUERIES = {"op10_source_mixing": op10_source_mixing}
ORACLE = {
    "op10_source_mixing": f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS draw
  FROM documents
), sources AS (
  SELECT src, sum(n_tokens)::BIGINT AS total, ceil(count(*) / {BLOCK_DOCS})::BIGINT AS blocks
  FROM counted GROUP BY src
), shares AS (
  SELECT list(total / all_tokens ORDER BY src) FILTER (total > 0) AS p,
         {ENTROPY_SHARE} * ln(count(*) FILTER (total > 0)) AS wanted, sum(total) AS budget
  FROM sources, (SELECT sum(total) AS all_tokens FROM sources)
), flat(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
  FROM (
    SELECT i, low, high, -list_sum(list_transform(w, lambda x: x * ln(x))) >= wanted AS ok
    FROM (
      SELECT i, low, high, wanted,
             list_transform(p, lambda x: x ** ((low + high) / 2) / list_sum(list_transform(p, lambda y: y ** ((low + high) / 2)))) AS w
      FROM flat, shares WHERE i < {STEPS}
    )
  )
), rare(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
  FROM (
    SELECT i, low, high,
           list_max(list_transform(p, lambda x: x ** ((low + high) / 2) / z / x)) > {MAX_REPEAT} AS ok
    FROM (
      SELECT i, low, high, p, list_sum(list_transform(p, lambda y: y ** ((low + high) / 2))) AS z
      FROM rare, shares WHERE i < {STEPS}
    )
  )
), exponent AS (
  SELECT greatest(
    CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= wanted THEN 1.0 ELSE (SELECT low FROM flat WHERE i = {STEPS}) END,
    CASE WHEN (SELECT low FROM rare WHERE i = {STEPS}) = 0 THEN 0.0 ELSE (SELECT high FROM rare WHERE i = {STEPS}) END
  ) AS a, p, budget FROM shares
), quotas AS (
  SELECT src, total, blocks, least(
    floor((total / budget) ** a / list_sum(list_transform(p, lambda x: x ** a)) * budget),
    floor(total * {MAX_REPEAT})
  )::BIGINT AS quota
  FROM sources, exponent WHERE total > 0
), placed AS (
  SELECT c.*, ('0x' || substr(draw, 1, 7))::BIGINT % blocks AS block
  FROM counted c JOIN quotas USING (src) WHERE quota > 0
), walked AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY src, block ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed
), sizes AS (
  SELECT src, block, sum(n_tokens) AS block_tokens FROM placed GROUP BY src, block
), epochs AS (
  SELECT src, block, block_tokens, quota, total, unnest(range(0, ceil(quota / total)::BIGINT)) AS epoch
  FROM sizes JOIN quotas USING (src)
), offsets AS (
  SELECT src, block, epoch, quota, epoch * total + coalesce(sum(block_tokens) OVER (
    PARTITION BY src, epoch ORDER BY md5(src || '|' || epoch || '|' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0) AS first_token
  FROM epochs
)
SELECT doc_id, source, epoch, n_tokens::BIGINT AS n_tokens, (first_token + before)::BIGINT AS "start", quota
FROM walked JOIN offsets USING (src, block)
WHERE first_token + before + n_tokens <= quota""",
}
