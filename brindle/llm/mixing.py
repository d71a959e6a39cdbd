"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Inclusion is unequal: in a source with target T a document of size s is expected ``e`` times,
where e = min(CAP, level * bits(s)), so that longer documents are likelier, and the level makes
the expected words T.  It gets floor(e) certain whole copies; the rest p = e - floor(e) is its
inclusion probability in an order sample: with a uniform number u from a digest of the row,
documents rank by the odds of u divided by the odds of p, and the first ones that fill what the
certain copies left of the target are taken.  Sizes are words, so the sample's fixed size is a
number of words: the cut is placed before or after the document that crosses it, whichever is
nearer.  The cut is found without sorting a source: sums over 4096 bins of the rank, then over
4096 bins inside the bin of the cut, and only what is left inside that is ordered.

Defined results: a null text has size 0 and is taken as often as its source allows for free
(its certain copies, plus one if it ranks before the cut); a null source is a source of its
own and comes last; u differs for rows of one id, or of none, unless their texts are equal too;
rows that are equal in all of this are taken together; sources without words have target 0; an
empty table gives an empty table; other columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, drop, fresh, sized_words

#: Weights of the sources in their order, repeating; the share of all words to take; the cap.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BINS = 4096
#: A source is dealt out over so many keys wherever documents meet their source's row.
SALTS = 64
SEED = "pareto-1"


def sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): one row for each source.

    With targets min(cap * size, level * weight), the level solves sum(targets) = share * sum
    (sizes).  Sources are passed in the order in which they reach their cap.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = by.withColumn("weight", F.element_at(kinds, (place % len(weights) + 1).cast("int")).cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    spread = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("open"))
        # The first source that stays under its cap at the level it would get; after it all do.
        .withColumn("under", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    )
    final = F.min(F.when(F.col("under"), F.struct(F.col("source_size") / F.col("weight"), F.col("capped"), F.col("level")))).over(everything)["level"]
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return spread.select("source", "source_size", target.alias("target"))


def odds(p: Column) -> Column:
    return p / (1 - p)


def bits(size: Column) -> Column:
    """What a document's expected copies are in proportion to: the binary digits of its size."""
    return F.length(F.bin(size))


def expected(sized: DataFrame, shares: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, bits, source_size, target, whole, p, rest): one row for each size class of a source.

    With e = min(cap, level * bits) the level solves sum(e * words) = target.  Classes are passed
    from the largest down, in the order in which they reach their cap; a source has some forty
    at most.
    """
    by = sized.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    by = by.join(shares.withColumnRenamed("source", "s_source"), on_source("s_")).drop("s_source")
    own = W.partitionBy("source")
    before = own.orderBy(F.col("bits").desc()).rowsBetween(W.unboundedPreceding, -1)
    weighted = F.col("bits").cast("long") * F.col("words")
    spread = (
        by.withColumn("capped", F.coalesce(F.sum("words").over(before), F.lit(0)) * cap)
        .withColumn("open", F.sum(weighted).over(own) - F.coalesce(F.sum(weighted).over(before), F.lit(0)))
        .withColumn("level", F.when(F.col("open") > 0, (F.col("target") - F.col("capped")) / F.col("open")))
        .withColumn("under", F.col("level") * F.col("bits") <= cap)
    )
    level = F.max(F.when(F.col("under"), F.struct("bits", "level"))).over(own)["level"]
    e = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.coalesce(level, F.lit(float("inf"))) * F.col("bits"))).otherwise(0.0)
    out = spread.withColumn("e", e).withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole"))
    out = out.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own))
    return out.select("source", "bits", "source_size", "target", "whole", "p", "rest")


def uniform(id_: Column, text: Column, seed: str) -> Column:
    """52 bits of a digest of seed, id and text, the same on every run and machine; never 0 or 1."""
    inner = F.md5(F.coalesce(text.cast("string"), F.lit("")))
    whole = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), inner))
    return (F.conv(F.substring(whole, 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, copies, source, u): how often the mix takes each document."""
    src = docs.select(F.col(id_col).alias("id"), sized_words(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"))
    sized = cut(src.withColumn("bits", bits(F.col("size"))), "sizes")
    shares = cut(sources(sized, weights, share, cap), "shares")
    classes = cut(expected(sized, shares, cap), "classes")
    both = with_source(sized, classes, on=("bits",))
    # Ranks run from 0 to infinity; q / (1 + q) keeps their order within 0 and 1.
    q = F.when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p")))
    both = both.withColumn("rank", q / (1 + q))
    both = both.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    both = both.withColumn("fine", F.least(F.floor((F.col("rank") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)).cast("int"))
    ranked = cut(both, "ranked")
    drop(sized, shares, classes)
    # What fills the rest: first whole bins, then whole fine bins of the next one, then documents.
    coarse = crossing(ranked.where("p > 0"), [], "bin")
    coarse = cut(coarse.select("source", F.col("bin").alias("c_bin"), F.col("before").alias("start")), "coarse")
    inside = with_source(ranked.where("p > 0"), coarse).where("bin = c_bin")
    fine = crossing(inside, ["start"], "fine").withColumnRenamed("source", "f_source")
    # One row for each source on both sides.
    fine = cut(fine.join(coarse, on_source("f_")).select("source", F.col("c_bin").alias("f_bin"), F.col("fine").alias("f_fine"), F.col("before").alias("f_before")), "cuts")
    edge = with_source(ranked.where("p > 0"), fine).where("bin = f_bin AND fine = f_fine")
    order = W.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "u")
    run = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("f_before")
    edge = edge.withColumn("run", run)
    # A document is in if the words with it are nearer to the rest than those without it.
    last = edge.where(F.col("run") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("rank", "id")).alias("last"))
    # Few rows: one for each source.
    ends = cut(fine.join(last.withColumnRenamed("source", "l_source"), on_source("l_"), "left").select("source", "f_bin", "f_fine", "last"), "ends")
    drop(coarse, fine)
    placed = with_source(ranked, ends, "left")
    at = F.struct("bin", "fine")
    edge_at = F.struct(F.col("f_bin"), F.col("f_fine"))
    tie = (F.col("rank") < F.col("last.rank")) | ((F.col("rank") == F.col("last.rank")) & (F.coalesce(F.col("id") <= F.col("last.id"), F.lit(False)) | F.col("last.id").isNull()))
    inside = (F.col("p") > 0) & (F.col("f_bin").isNull() | (at < edge_at) | ((at == edge_at) & F.coalesce(tie, F.lit(False))))
    copies = F.col("whole") + inside.cast("long")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("source").alias(source_col), "u")


def on_source(prefix: str) -> Column:
    return F.col("source").eqNullSafe(F.col(f"{prefix}source"))


def with_source(rows: DataFrame, by: DataFrame, how: str = "inner", on: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of their source's row (and class's, by ``on``); a source's rows are dealt out by u."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = by.withColumnsRenamed({c: f"_{c}" for c in ("source", *on)}).withColumn("_salt", salts)
    salted = rows.withColumn("_own", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    match = (F.col("_own") == F.col("_salt")) & F.col("source").eqNullSafe(F.col("_source"))
    for c in on:
        match &= F.col(c) == F.col(f"_{c}")
    return salted.join(spread, match, how).drop("_own", "_salt", "_source", *(f"_{c}" for c in on))


def crossing(rows: DataFrame, extra: list[str], name: str) -> DataFrame:
    """(source, bin, before): for each source the bin in which the running words pass the rest.

    Sums are made before the shuffle; a source has at most BINS rows in the window.
    """
    start = F.col("start") if extra else F.lit(0)
    by = rows.groupBy("source", name, "rest", *extra).agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy(name)
    run = F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) + start
    return by.withColumn("run", run).withColumn("before", F.col("run") - F.col("words")).where("run >= rest").groupBy("source").agg(F.min_by(name, name).alias(name), F.min("before").alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The documents that the mix takes, with all their columns; repeats as repeated rows."""
    own, n, key, u, source, copies = fresh(docs, "_own", "_n", "_id", "_u", "_source", "_copies")
    chosen = plan(docs, id_col, text_col, source_col, seed=seed, **how).where("copies > 0")
    # Rows that repeat have equal copies, so one of each id, text (by u) and source is enough.
    keys = chosen.groupBy(F.col(id_col).alias(key), F.col("u").alias(u), F.col(source_col).alias(source)).agg(F.max("copies").alias(copies))
    dealt = docs.withColumn(own, uniform(F.col(id_col), F.col(text_col), seed))
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(u)) & F.col(source_col).cast("string").eqNullSafe(F.col(source))
    # Row by row, so that no list of copies is longer than the cap.
    return dealt.join(keys, on).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, source FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source
), o AS (
    SELECT *, sum(source_size) OVER () AS total,
           2 * coalesce(sum(source_size) OVER b, 0) AS capped,
           sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
    FROM s WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT *, (1.5::DOUBLE * total::DOUBLE - capped::DOUBLE) / open::DOUBLE AS level FROM o
), t AS (
    SELECT source, source_size, least(2 * source_size::DOUBLE,
           (SELECT arg_min(level, source_size::DOUBLE / weight) FROM l WHERE level * weight <= 2 * source_size) * weight) AS target
    FROM l
), k AS (
    SELECT d.source, len(bin(size)) AS bits, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), w AS (
    SELECT *, (target - 2 * coalesce(sum(words) OVER b, 0)::DOUBLE)
              / nullif(sum(bits * words) OVER (PARTITION BY source) - coalesce(sum(bits * words) OVER b, 0), 0)::DOUBLE AS level
    FROM k WINDOW b AS (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
    SELECT source, bits, words, source_size, target,
           CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, coalesce(arg_max(level, bits) FILTER (level * bits <= 2) OVER (PARTITION BY source), 'inf'::DOUBLE) * bits) ELSE 0 END AS e
    FROM w
), j AS (
    SELECT doc_id, size, d.source, source_size, target, c.whole, c.p, c.rest,
           (('0x' || substr(md5('pareto-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM d JOIN (
        SELECT source, bits, source_size, target, floor(e)::BIGINT AS whole, e - floor(e) AS p,
               target - sum(floor(e)::BIGINT * words) OVER (PARTITION BY source)::DOUBLE AS rest
        FROM e
    ) c ON d.source IS NOT DISTINCT FROM c.source AND len(bin(size)) = c.bits
), r AS (
    SELECT *, q / (1 + q) AS rank
    FROM (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM j)
), c AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM r
)
SELECT doc_id, size, source_size, target,
       (size * (whole + (p > 0 AND run - size / 2 <= rest)::BIGINT))::BIGINT AS taken
FROM c
"""
