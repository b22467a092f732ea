"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code point order, NULL last, get the weights in turn.  Their targets share ``share`` times all tokens by
weight; no target exceeds ``most`` times its source's tokens, the excess goes to the others by weight.  The targets
are apportioned in blocks of ``block`` tokens by highest quotients, a source's blocks to its shards in the same way.
In a shard the documents lie one behind the other in seeded order; the shard's quota is a number of whole
repeats of its token line, and a run of blocks from a seeded start around the line.  So nearly all
documents are taken whole, and what a document gives is plain arithmetic on its position.

Only DataFrame operations are used.  The rows meet in shards of about ``shard_rows`` documents, so a hot source is
spread; the table of sources and the table of shards are written to the shared folder and broadcast only if
Spark's threshold allows.  The order of sources needs one sorted pass over the table of sources, which has a row for
each source of the mix.

Edge cases: a NULL or empty text has size 0 and gives 0; NULL sources are one source, the last; rows
that repeat share the identity of their key and are taken in turn; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabloom.llm.common import WORD, table, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 16
    shard_rows: int = 2048
    seed: int = 17


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _number(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def apportion(parts: DataFrame, group: list[str], key: str, weight: str, seats: str, most: str) -> DataFrame:
    """Sainte-Lague: adds ``quota``.  In each group the ``seats`` go to the highest quotients weight / (2k + 1),
    ties to the smaller key, at most ``most`` to one part.

    With q the exact share and n parts, floor(x q + 1/2) summed over the parts is at most the seats for
    x = 1 - n / 2 seats, at least the seats for x = 1 + n / 2 seats.  So the last seat lies between, and only the
    quotients between, about 2 n in all, are ranked.
    """
    g = W.partitionBy(*[F.col(c) for c in group]) if group else W.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(g), F.sum(F.col(weight).cast("double")).over(g)
    parts = (parts.withColumn("_n", n).withColumn("_q", F.when(total > 0, F.col(seats) * F.col(weight) / total)
                                                   .otherwise(F.lit(0.0))))
    x = F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0))
    at = lambda f: F.least(F.floor(f * F.col("_q") + 0.5).cast("long"), F.col(most))
    parts = parts.withColumn("_low", at(F.greatest(F.lit(0.0), 1 - x - 1e-9))).withColumn("_high", at(1 + x + 1e-9))
    parts = parts.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    ranked = (parts.filter(F.col("_high") > F.col("_low"))
              .select(*group, key, "_q", "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
              .withColumn("_rank", F.row_number().over(g.orderBy((F.col("_q") / (2 * F.col("_k") + 1)).desc(), key, "_k")))
              .filter(F.col("_rank") <= F.col("_left")))
    more = ranked.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_more"))
    return (parts.join(more, [*group, key], "left")
            .withColumn("quota", F.col("_low") + F.coalesce(F.col("_more"), F.lit(0)))
            .drop("_n", "_q", "_low", "_high", "_left", "_more"))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: source, source_no, rows, source_size, target, blocks (its seats), shards."""
    all_ = W.partitionBy(F.lit(0))
    sources = (sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
               .withColumn("source_no", F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last()))))
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]),
                          ((F.col("source_no") - 1) % len(mix.weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", mix.most * F.col("source_size"))
    # Water level: in order of cap / weight, the first so many sources stop at their cap.
    by = all_.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = ((F.sum("source_size").over(all_) * F.lit(mix.share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    sources = sources.withColumn("level", level)
    open_ = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(all_)
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_ * F.col("weight"), F.col("cap").cast("double")))
    return (sources.withColumn("target", target)
            .withColumn("seats", F.round(F.sum("target").over(all_) / mix.block).cast("long"))
            .withColumn("most", F.ceil(F.col("cap") / mix.block).cast("long"))
            .withColumn("shards", F.ceil(F.col("rows") / mix.shard_rows).cast("long"))
            .drop("weight", "cap", "level"))


def shard_quotas(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row for each shard: source, source_no, source_size, target, shards, shard, size, blocks, quota, start.
    ``sizes`` has source, size and order_key."""
    name = "mix-sources"
    targets = source_targets(sizes, mix)
    sources = written(apportion(targets, [], "source_no", "target", "seats", "most")
                      .drop("seats", "most").withColumnRenamed("quota", "seats"), name)
    shards = (_with_shard(sizes, sources)
              .groupBy("source", "source_no", "source_size", "target", "seats", "shards", "shard")
              .agg(F.sum("size").alias("shard_size"))
              .withColumn("blocks", F.ceil(F.col("shard_size") / mix.block).cast("long"))
              .withColumn("most", mix.most * F.col("blocks")))
    shards = apportion(shards, ["source_no"], "shard", "shard_size", "seats", "most")
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), "source_no", "shard").cast("binary"))
    return written(shards.drop("most", "seats").withColumn("start", _number(digest, 1) % F.greatest("blocks", F.lit(1))),
                   "mix-shards")


def _with_shard(df: DataFrame, sources: DataFrame) -> DataFrame:
    keyed = sources.select(F.col("source").alias("_s"), *[c for c in sources.columns if c not in ("source", "rows")])
    joined = df.join(keyed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("shard", _number(F.col("order_key"), 1) % F.col("shards"))


def mixed(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source",
          sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with size, source_size, target, repeats (whole repeats taken), ``run_from`` and ``run_words`` (the
    words that the run takes, counted from run_from around the document's end), and taken = repeats * size + run_words.

    Without ``sizes`` (source, size, order_key), the sizes are counted from ``text``; give the column ``size``
    in ``df`` to count only once.  Columns of these names in ``df`` are replaced.
    """
    own = [c for c in df.columns if c not in ("order_key", "shard", "source_size", "target", "repeats", "run_from",
                                              "run_words", "taken")]
    if "size" not in df.columns or sizes is None:
        df = df.withColumn("size", token_count(text))
    df = df.select(*[c for c in own if c != "size"], "size").withColumn("order_key", _order_key(key, mix.seed))
    if source != "source":
        df = df.withColumn("source", F.col(source))
    if sizes is None:
        sizes = df.select("source", "size", "order_key")
    quotas = shard_quotas(sizes, mix)
    # The shard's number needs the number of shards of its source: a table with a row for each source.
    sources = quotas.groupBy("source").agg(F.first("source_no").alias("source_no"), F.first("shards").alias("shards"))
    placed = _with_shard(df, sources)
    ties = [F.col(key), F.col("size")] + ([F.xxhash64(F.col(text))] if text in df.columns else [])
    line = W.partitionBy("source_no", "shard").orderBy("order_key", *ties)
    placed = placed.withColumn("_end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    quotas = quotas.drop("source", "shards")
    out = placed.join(quotas, ["source_no", "shard"])
    b, blocks, size = F.lit(mix.block), F.greatest("blocks", F.lit(1)), F.col("shard_size")
    run = F.col("quota") % blocks
    begin, first = F.col("_end") - F.col("size"), F.least(F.col("start") * b, size)
    to = F.least((F.col("start") + run) * b, size)
    wrap = F.least(F.greatest(F.lit(0), F.col("start") + run - blocks) * b, size)
    cut = lambda low, high: F.greatest(F.lit(0), F.least(F.col("_end"), high) - F.greatest(begin, low))
    late, early = cut(first, to), cut(F.lit(0).cast("long"), wrap)
    return (out.withColumn("repeats", F.floor(F.col("quota") / blocks).cast("long"))
            .withColumn("run_words", (late + early).cast("long"))
            .withColumn("run_from", F.when(late > 0, F.greatest(F.lit(0), first - begin)).otherwise(0).cast("long"))
            .withColumn("taken", F.col("repeats") * F.col("size") + F.col("run_words"))
            .select(*[c for c in own if c != "size"], "size", "source_size", "target", "repeats", "run_from", "run_words",
                    "taken"))


def copies(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``mixed``: each row as often as it is taken whole, and once more cut to its run where the
    run takes part of it.  The run's words keep the white space before them; a run around the end of a
    document keeps its two pieces in order of the text."""
    whole = F.col("run_words") >= F.col("size")
    times = F.col("repeats") + F.when(F.col("run_words") > 0, 1).otherwise(0)
    df = df.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    to = F.col("run_from") + F.col("run_words")
    tail = F.array_join(F.slice(parts, (F.col("run_from") + 1).cast("int"), F.col("run_words").cast("int")), "")
    around = F.concat(F.array_join(F.slice(parts, F.lit(1), (to - F.col("size")).cast("int")), ""),
                      F.array_join(F.slice(parts, (F.col("run_from") + 1).cast("int"),
                                           (F.col("size") - F.col("run_from")).cast("int")), ""))
    part = F.when(to > F.col("size"), around).otherwise(tail)
    return df.withColumn(text, F.when((F.col("_copy") <= F.col("repeats")) | whole, F.col(text)).otherwise(part)).drop("_copy")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("size"))
    slim = written(docs, "mix-sizes")
    sizes = slim.withColumn("order_key", _order_key("doc_id", Mix.seed)).drop("doc_id")
    return mixed(slim, sizes=sizes).select("doc_id", "size", "source_size", "target", "taken")
