"""Mixing sources to target weights.

The words of a source are packed, document after document, into blocks of fixed length. The output is a row of slots,
cut into shards. Each shard draws how many of its slots a source gets (a multinomial draw by hashes of the slot numbers);
the few draws beyond a source's quota of blocks are handed to sources that were drawn too seldom. A source's n-th slot
takes the block that the source's pseudorandom index permutation gives for n, one round of the permutation after the
other, so no block is taken more often than there are rounds. Slots and blocks are joined by source and block index.

All is column expressions, so a rerun gives the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions.text import evaluate_once
from gazette.llm.common import n_words, stored

#: Weights of the sources in code point order, repeating; share of all words that the mix has; most uses of a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
WALKS, ROUNDS = 24, 4


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, sid, source_size, target) from rows (source, source_size): one small row per source.

    Each target is its source's weight times one common level, but at most ``most`` times its size; the level is such
    that all targets add up to ``share`` of all sizes. That is where resharing the excess by weight ends: with sources in
    the order of the level that fills them, those are full whose own level is below what is left for them and the rest.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    full = ranked.withColumns({"weight": weight, "most": F.col("source_size") * most}).withColumn("fills", F.col("most") / F.col("weight"))
    before = Window.orderBy("fills", "sid").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fills", "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = full.withColumn("level", left / F.sum("weight").over(onward))
    common = F.min_by(F.when(F.col("level") < F.col("fills"), F.col("level")), F.when(F.col("level") < F.col("fills"), F.struct("fills", "sid"))).over(everything)
    return level.withColumn("common", common).select("source", "sid", "source_size", F.coalesce(F.least(F.col("most"), F.col("common") * F.col("weight")), F.col("most")).alias("target"))


def permuted(place: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 to size - 1, chosen by ``key``: Feistel rounds over pairs of digits to the base
    ceil(sqrt(size)), repeated on results that are not below ``size``. Exact for sizes up to 100 within ``WALKS`` repeats;
    beyond, a place that would need more has a chance under 1e-16 and then has no block."""
    radix = F.ceil(F.sqrt(size)).cast("long")

    def rounds(x: Column) -> Column:
        left, right = (x / radix).cast("long"), x % radix
        for i in range(ROUNDS):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(i)), radix), radix)
        return left * radix + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), rounds(place), lambda acc, _: F.when(acc < size, acc).otherwise(rounds(acc)))


def laid_out(documents: DataFrame, uid: str | None = None, per_task: int = 10_000) -> DataFrame:
    """Per document: uid, doc_id, sid, size, its place ``start`` among the words of its source, source_size, target.

    Places are running sums over buckets of a source, so a source of any size is summed by many tasks. ``uid`` names a
    column that numbers the rows, if they have one.
    """
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    narrow = stored(documents.select(number.alias("uid"), "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    total = narrow.count()
    sources = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    buckets = max(1, math.ceil(total / per_task))
    rows = narrow.join(sources, narrow["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = sums.select("sid", "bucket", (F.sum("bucket_size").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("bucket_size")).alias("bucket_start"))
    within = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("uid")) - F.col("size")
    return rows.withColumn("within", within).join(starts, ["sid", "bucket"]).select("uid", "doc_id", "source", "sid", "size", "source_size", "target", (F.col("bucket_start") + F.col("within")).alias("start"))


def slots(sources: DataFrame, block: int, shard: int | None = None, seed: int = 11) -> DataFrame:
    """(shard, slot, sid, round, block): the block that each slot of the output takes.

    ``sources`` has sid, source_size and target. A source's quota is its target in blocks, at most its blocks times the
    rounds a document may be used. A shard has ``shard`` slots (default 4096, more for outputs beyond 40 million slots).
    """
    spark = sources.sparkSession
    n = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.least(n * int(MOST), F.greatest(F.lit(1), F.round(F.col("target") * n / F.col("source_size"))).cast("long"))
    held = sources.where("source_size > 0").select("sid", n.alias("n"), quota.alias("quota"))
    held = stored(held.withColumn("quota_start", F.sum("quota").over(Window.orderBy("sid")) - F.col("quota")), "quotas")
    total = held.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shard = shard or max(4096, math.ceil(total / 10_000))
    cell = max(1, math.ceil(total / 1024))
    cells = held.withColumn("cell", F.explode(F.sequence((F.col("quota_start") / cell).cast("long"), ((F.col("quota_start") + F.col("quota") - 1) / cell).cast("long"))))

    draw = F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(max(1, total)))
    drawn = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") / shard).cast("long").alias("shard")).withColumn("draw", draw)
    drawn = drawn.withColumn("cell", (F.col("draw") / cell).cast("long")).join(cells, "cell")
    drawn = drawn.where((F.col("draw") >= F.col("quota_start")) & (F.col("draw") < F.col("quota_start") + F.col("quota"))).select("shard", "slot", "sid", "n", "quota")
    drawn = stored(drawn, "drawn")
    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("drawn"))
    offsets = counts.select("sid", "shard", (F.sum("drawn").over(Window.partitionBy("sid").orderBy("shard")) - F.col("drawn")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1 + F.col("offset")
    numbered = drawn.join(offsets, ["sid", "shard"]).withColumn("nth", nth)

    balance = held.join(counts.groupBy("sid").agg(F.sum("drawn").alias("drawn")), "sid", "left").fillna(0, ["drawn"])
    balance = balance.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))})
    in_order = Window.orderBy("sid")
    balance = balance.withColumns({"over_start": F.sum("over").over(in_order) - F.col("over"), "under_start": F.sum("under").over(in_order) - F.col("under")})
    spare = numbered.where("nth >= quota").join(balance.select("sid", "over_start"), "sid").select("shard", "slot", (F.col("nth") - F.col("quota") + F.col("over_start")).alias("index"))
    wanted = balance.where("under > 0").select("sid", "n", "drawn", "under_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"))
    wanted = wanted.select("sid", "n", (F.col("drawn") + F.col("i")).alias("nth"), (F.col("under_start") + F.col("i")).alias("index"))
    handed = spare.join(wanted, "index").select("shard", "slot", "sid", "n", "nth")
    taken = numbered.where("nth < quota").select("shard", "slot", "sid", "n", "nth").unionByName(handed)
    turn = (F.col("nth") / F.col("n")).cast("long")
    return taken.select("shard", "slot", "sid", turn.alias("round"), permuted(F.col("nth") % F.col("n"), F.col("n"), F.xxhash64("sid", turn, F.lit(seed))).alias("block"))


def pieces(laid: DataFrame, block: int = 64, seed: int = 11) -> DataFrame:
    """The mix: (shard, slot, round, uid, doc_id, first, words), the runs of words of documents that each slot holds.

    ``laid`` is what :func:`laid_out` returns. ``first`` counts a document's words from 0.
    """
    sources = laid.select("sid", "source_size", "target").distinct()
    spans = laid.where("size > 0").withColumn("block", F.explode(F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    spans = spans.select("sid", "block", "uid", "doc_id", first.alias("first"), (end - first).alias("words"))
    return slots(sources, block, seed=seed).join(spans, ["sid", "block"]).select("shard", "slot", "round", "uid", "doc_id", "first", "words")


def taken(documents: DataFrame, block: int = 64, seed: int = 11) -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target and the words the mix takes, repeats counted.

    Null texts and texts without words have size 0 and nothing taken; a null source is a source of its own, last in
    order; repeated rows and ids count each by itself; an empty table gives no rows. Other columns aren't read.
    """
    laid = stored(laid_out(documents), "laid-out")
    got = pieces(laid, block, seed).groupBy("uid").agg(F.sum("words").alias("taken"))
    return laid.join(got, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(documents: DataFrame, block: int = 64, seed: int = 11) -> DataFrame:
    """The documents as the mix has them, with the columns of the input.

    A document's text is what the mix takes of it: its taken words in order, with the white space that follows each, once
    for each round, rounds apart by a line feed. Documents of which nothing is taken go. ``n_chars`` follows, if there.
    """
    whole = stored(documents.withColumn("__uid", F.monotonically_increasing_id()), "documents")
    laid = stored(laid_out(whole, "__uid"), "laid-out")
    parts = pieces(laid, block, seed).groupBy("uid").agg(F.collect_list(F.struct("round", "first", "words")).alias("__parts"))
    rows = whole.join(parts.withColumnRenamed("uid", "__uid"), "__uid")
    rows = evaluate_once(rows, {"__words": F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), "__parts": F.array_sort("__parts")})

    def of_round(number: int) -> Column:
        own = F.filter("__parts", lambda p: p["round"] == number)
        text = F.array_join(F.flatten(F.transform(own, lambda p: F.slice(F.col("__words"), (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
        return F.nullif(text, F.lit(""))

    made = {"text": F.concat_ws("\n", *map(of_round, range(int(MOST))))}
    mix = evaluate_once(rows, made)
    if "n_chars" in documents.columns:
        mix = mix.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return mix.select(documents.columns)
