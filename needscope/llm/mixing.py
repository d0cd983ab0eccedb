"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame operations only. Words are dealt out in equal blocks: first to
sources, then to the shards of each source, each time to the highest quotient
``vote / (2 * seats + 1)``. The number of a source's shards follows from its
own rows and words alone. Inside a shard, documents stand in seeded order on
one axis of words; the shard's quota is a number of whole passes plus a run of
words from a seeded block on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needscope.sources.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = 2_000  # documents of a shard, about, while its source has fewer than MOST_SHARDS
SHARD_BLOCKS = 256  # and at least so many blocks, about, so that rounding to blocks is small
MOST_SHARDS = 4_096  # hash shards of a source


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    block_words: int = 16,
    seed: int = 17,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the columns of ``carry``, a row per document.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all words. A target stops at ``repeats`` times its source;
    the excess goes to the others by weight. ``taken`` counts words with
    repeats, at most ``repeats`` times the size. Null or empty text has size
    0 and takes nothing. Repeated rows are documents of their own; a null id
    is an id like any other. Equal input gives equal output in any row order.
    Extra columns are ignored unless carried. An empty table gives no rows.
    """
    sized = docs.select(
        F.col(id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("")).alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("__tie"),
        *[F.col(name).alias(f"__carry_{i}") for i, name in enumerate(carry)],
    )
    narrow = settle(sized.select("doc_id", "__source", "size", "__tie"), "sizes")
    some, empty = F.count_if(F.col("size") > 0), F.count_if(F.col("size") == 0)
    full = F.floor(F.sum("size") / (SHARD_BLOCKS * block_words))
    shards = settle(
        narrow.groupBy("__source").agg(
            _shards(F.least(F.ceil(some / SHARD_ROWS), full)).alias("__shards"),
            _shards(F.ceil(empty / SHARD_ROWS)).alias("__empty"),
        ),
        "source-shards",
    )
    # documents without words take nothing; they get shards of their own, below 0
    hashed = F.xxhash64("doc_id", "__tie")
    shard = F.when(F.col("size") > 0, F.pmod(hashed, "__shards")).otherwise(-1 - F.pmod(hashed, "__empty"))
    in_shards = lambda rows: rows.join(shards, "__source").withColumn("__shard", shard).drop("__shards", "__empty")
    parts = settle(in_shards(narrow).groupBy("__source", "__shard").agg(F.sum("size").alias("words")), "shard-words")

    targets = settle(_targets(parts, weights, share, repeats), "targets")
    total = float(targets.agg(F.sum(F.col("target").cast("decimal(38,6)"))).first()[0] or 0)  # the same in any order
    seats = F.lit(int(total / block_words + 0.5))
    dealt = apportion(targets.withColumn("vote", F.col("target")).withColumn("seats", seats), [], ["__source"])
    voting = parts.join(settle(dealt, "source-blocks"), "__source").withColumn("vote", F.col("words").cast("double"))
    quotas = settle(apportion(voting, ["__source"], ["__shard"]), "shard-blocks")

    blocks = F.ceil(F.col("words") / block_words)
    start = F.pmod(F.xxhash64("__source", "__shard", F.lit(seed)), blocks) * block_words
    plan = (
        # in words, so that the empty end of a last block is not dealt
        quotas.withColumn("__quota", F.least(F.col("won") * block_words, F.col("words") * repeats))
        .where("words > 0")
        .select(
            "__source", "__shard", "words",
            F.expr("__quota div words").alias("__passes"),
            start.alias("__from"),
            (start + F.col("__quota") % F.col("words")).alias("__to"),
            F.col("words").alias("__turn"),
        )
    )
    rows = in_shards(sized if carry else narrow)
    order = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", "__tie")
    low = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("__low", low).join(settle(plan, "mix-plan"), ["__source", "__shard"], "left")
    placed = placed.join(targets.select("__source", "source_size", "target"), "__source", "left")
    once = _overlap(F.col("__from"), F.col("__to")) + _overlap(F.lit(0), F.col("__to") - F.col("__turn"))
    taken = F.col("__passes") * F.col("size") + once
    return placed.select(
        *[F.col(f"__carry_{i}").alias(name) for i, name in enumerate(carry) if name != "doc_id"],
        "doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
    )


def _shards(wanted: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), wanted)).cast("long")


def _overlap(start: Column, end: Column) -> Column:
    """Words of the document between two places of its shard."""
    return F.greatest(F.lit(0), F.least(end, F.col("__low") + F.col("size")) - F.greatest(start, F.col("__low")))


def _targets(parts: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """(__source, source_size, target). One row per source; figures alone come to the driver."""
    # "" stands for null and goes last; the other keys begin with the same sign
    place = F.row_number().over(Window.orderBy(F.col("__source") == "", "__source")) - 1
    sources = settle(
        parts.groupBy("__source")
        .agg(F.sum("words").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(repeats)),
        "sources",
    )
    total, weight = sources.agg(F.sum("source_size") * float(share), F.sum("weight")).first()
    level, full = (total or 0.0) / (weight or 1.0), -1
    while True:
        stops = F.col("cap") <= F.col("weight") * level
        stopped, held, rest = sources.agg(
            F.count(F.when(stops, 1)), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))
        ).first()
        if stopped == full or not rest:
            break
        full, level = stopped, (total - (held or 0.0)) / rest
    return sources.select("__source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def apportion(table: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Add ``won``: the group's ``seats`` dealt by ``vote`` to the highest quotients, ties by key.

    Rounding to the group's divisor is within a few seats of the answer, so
    only the quotients of those last seats are ranked. If any key takes all
    or none of its open seats, the span is doubled.
    """
    group, span = Window.partitionBy(*by), 2
    divisor = F.sum("vote").over(group) / F.nullif(F.col("seats").cast("double"), F.lit(0.0))
    near = F.coalesce(F.floor(F.col("vote") / F.nullif(divisor, F.lit(0.0)) + 0.5), F.lit(0))
    while True:
        base = table.withColumn("__base", F.greatest(F.lit(0), near - span))
        open_seats = F.explode(F.sequence(F.lit(0), F.lit(2 * span)))
        quotient = F.col("vote") / (2 * (F.col("__base") + F.col("__more")) + 1)
        ranked = (
            base.withColumn("__left", F.col("seats") - F.sum("__base").over(group))
            .withColumn("__more", open_seats)
            .withColumn("__rank", F.row_number().over(group.orderBy(F.desc(quotient), *key, "__more")))
            .withColumn("__wins", (F.col("__rank") <= F.col("__left")).cast("long"))
        )
        names = [name for name in table.columns if name not in (*by, *key, "seats", "vote")]
        found = settle(
            ranked.groupBy(*by, *key).agg(
                *[F.first(name).alias(name) for name in names], F.first("__base").alias("__base"), F.sum("__wins").alias("__won")
            ),
            "seats",
        )
        short = (F.col("__won") == 2 * span + 1) | ((F.col("__won") == 0) & (F.col("__base") > 0))
        if found.where(short).isEmpty():
            return found.withColumn("seats", F.col("__base") + F.col("__won")).withColumn("won", F.col("seats")).drop("__base", "__won")
        span *= 2
