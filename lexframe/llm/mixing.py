"""Mixing sources to target weights by temperature.

Source i holds a share p_i of the tokens. Its weight is p_i**a / sum(p**a) with an exponent a from 0 (uniform) to 1
(as they are). Entropy falls and repetition of small sources shrinks as ``a`` grows, so bisection finds the exponent that
meets a target entropy, a repetition limit, or both; each job evaluates the midpoints of six bisection levels with
aggregates alone, so the table of sources is never collected.

A source's budget is its weight times the token budget. The budget is realised on a permutation of blocks: documents
are dealt into blocks by a hash of id and tokens, whole passes over the source are taken first, then blocks in permuted order as far as
the budget goes, and of the one block in which it ends the documents in permuted order. Only sums of blocks are
ordered within a source; rows of a source, however hot, are spread over its blocks. Only DataFrame expressions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS = 6
STEPS = 5
BLOCK_ROWS = 4096


def count_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum p**a, sum p**a ln p**a) for each exponent, in one job whose code does not depend on their values."""
    spread = sources.select("share", F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a"))
    power = F.pow(F.col("share"), F.col("a"))
    rows = spread.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("a")).alias("h")).collect()  # a row an exponent
    return [(r["z"], r["h"]) for r in sorted(rows, key=lambda r: r["k"])]


def _bisect(sources: DataFrame, met: Callable[[float, float, float], bool]) -> float:
    """The least exponent in [0, 1] for which ``met`` holds of it and its sums (met at 1, monotone)."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        good = [met(a, z, h) for a, (z, h) in zip(grid, _sums(sources, grid), strict=True)]
        first = next((k for k, ok in enumerate(good) if ok), len(grid))
        low, high = [low, *grid][first], [*grid, high][first]
    return high


def temperature(sources: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget_tokens: float | None = None) -> tuple[float, float]:
    """(exponent, budget) for ``sources`` (share double, tokens long).

    ``target_entropy`` is a share of the greatest possible entropy: the exponent is the largest that still reaches it.
    ``max_repetition`` bounds how often the smallest source is repeated; where both are asked for the bound prevails.
    Without ``budget_tokens`` the budget is the least that uses every document at least once.
    """
    row = sources.agg(F.count("*"), F.sum("tokens"), F.max("share"), F.min("share")).first()
    n, total, largest, smallest = row[0], float(row[1] or 0), row[2], row[3]
    if not n or not total:
        return 1.0, 0.0

    def within(a: float, z: float, _: float) -> bool:
        most = smallest ** (a - 1) / z * (budget_tokens / total) if budget_tokens is not None else (largest / smallest) ** (1 - a)
        return most <= max_repetition

    exponent = 1.0
    if target_entropy is not None and n > 1:
        exponent = _bisect(sources, lambda _, z, h: math.log(z) - h / z <= target_entropy * math.log(n))
    elif max_repetition is not None:
        exponent = 0.0
    if max_repetition is not None and not within(exponent, *_sums(sources, [exponent])[0]):
        exponent = max(exponent, _bisect(sources, within))
    if budget_tokens is not None:
        return exponent, float(budget_tokens)
    return exponent, total * _sums(sources, [exponent])[0][0] * largest ** (1 - exponent)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repetition: float | None = None, budget_tokens: float | str | None = None, seed: int = 17, block_rows: int = BLOCK_ROWS, tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``n_tokens, share, weight, repetition, block, copies`` (columns of these names are replaced).

    ``copies`` is how often the document is used: every whole pass over its source, and one more if it lies within the
    budget left for the last, partial pass. ``tokens`` gives a document's tokens, by default its words; they are needed three
    times, so a caller without need of the texts counts once and passes the column; long texts are read whole. ``budget_tokens`` may be "corpus" (as many
    tokens as there are). A null source is a source of its own. Documents without tokens cost nothing and are used once with every pass begun.
    Rows that repeat an id are dealt each for itself; an empty table gives an empty one; other columns may have any names.
    """
    made = ["n_tokens", "share", "weight", "repetition", "block", "copies"]
    docs = docs.drop(*[c for c in made if c in docs.columns])
    # A text that is never null stands for the source, so that one shuffle by it and the block serves join and window.
    source = F.col(source_col).cast("string")
    key = F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))
    row = F.struct(*[F.col(c) for c in docs.columns])  # packed, so that no column meets one of the names below
    counted = docs.select(row.alias("row"), F.col(id_col).alias("id"), (count_words(F.col(text_col)) if tokens is None else tokens).alias("n_tokens"), key.alias("source"))
    stats = cut(counted.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")), "sources")
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    shares = stats.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    exponent, budget = temperature(shares, target_entropy, max_repetition, float(total) if budget_tokens == "corpus" else budget_tokens)
    z = (shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0) if total else 1.0

    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(total or 1))).otherwise(F.lit(0.0))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("share"), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = stats.withColumn("share", share).withColumn("weight", weight)
    plan = plan.withColumn("repetition", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(budget) / F.col("tokens")).otherwise(F.lit(1.0)))
    plan = plan.withColumn("passes", F.floor(F.col("repetition") + F.lit(1e-9)).cast("long"))
    plan = plan.withColumn("left", F.greatest(F.lit(0.0), (F.col("repetition") - F.col("passes")) * F.col("tokens")))
    plan = plan.withColumn("blocks", F.ceil(F.col("rows") / F.lit(block_rows)).cast("long"))
    plan = cut(plan.select("source", "share", "weight", "repetition", "passes", "left", "blocks"), "mix-plan")

    # The plan has a row for each source: Spark broadcasts it if it is small and otherwise splits the skewed join.
    dealt = counted.join(plan, "source").withColumn("block", F.pmod(F.xxhash64("id", "n_tokens", F.lit(seed)), F.col("blocks")))
    sums = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("room"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    before = F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "block", (F.col("room") - before).alias("room"))
    joined = dealt.join(sums, ["source", "block"])
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64("id", F.lit(seed + 2)), "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.when(F.sum("n_tokens").over(within) <= F.col("room") + F.lit(1e-6), 1).otherwise(0)
    extra = F.when(F.col("left") > F.lit(0.5), taken).otherwise(0)
    found = joined.select("row", "n_tokens", "share", "weight", "repetition", F.col("block").cast("long").alias("block"), (F.col("passes") + extra).cast("long").alias("copies"))
    return found.select("row.*", *made)


def schedule(mixed: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """A row for each use of a document: its pass ``epoch`` and the key ``order_key`` that permutes each pass anew."""
    used = mixed.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return used.withColumn("order_key", F.xxhash64(F.col(id_col), F.col("epoch"), F.lit(seed)))


def realise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mixture uses them, columns unchanged: a document comes up as often as it is used.

    A null source is a source of its own; a null text has no tokens and is used with every pass begun; rows that repeat an id
    are used each for itself; an empty table gives an empty one.
    """
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), F.col(id_col).alias("key"), F.col(source_col).alias("from"), count_words(F.col(text_col)).alias("n"))
    return schedule(mix(packed, "key", source_col="from", tokens=F.col("n"), **options), "key").select("whole.*")
