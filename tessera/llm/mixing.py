"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes are counted in one scan and written as a narrow table; the texts are not read again.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; together they take ``share`` of all
   words. A target stops at ``most`` times its source's size, and the excess is shared again by weight. As a closed
   form over the sources sorted by the ratio of limit and weight, with running sums.
3. Apportionment: the total is cut into blocks of equal token numbers, given to sources by the highest quotients
   target / (2 k + 1). A source of under ``fine`` blocks has blocks of its own size instead, ``fine`` of them or one a word, and
   as many as come nearest to its target, so that it changes nothing for the others. Each source is cut into shards by
   a seeded hash, as many as its size asks for, and its blocks are given to shards by quotients again: an integer quota
   for each shard, none of which grows with the corpus.
4. Selection: in a shard, documents stand in seeded order end to end and are cut into blocks. A quota takes all blocks
   as often as it covers them all, then a run of blocks from a seeded place on for the rest. So at most two documents of a
   shard are cut, each to one piece.

A source may hold any part of the rows: it is spread over its shards, and sizes are summed before a shuffle. The only
unpartitioned windows are over the sources, one row for each.

Cases: a null text has size 0 and takes 0 words. Null is a source of its own. A null ``doc_id`` is a key like any
other. Repeated rows are separate documents. An empty table gives an empty result; sources of size 0 have target 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, small, table, words, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    #: Words in a block, and blocks of the smallest source that is apportioned with the others.
    block_words: int = 256
    fine: int = 256
    shard_words: int = 1_000_000
    most_shards: int = 65_536
    seed: str = "mix"


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` (source, source_size) with weight and target."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(x) for x in mix.weights)), (nth % len(mix.weights) + 1).cast("int"))
    out = sources.withColumns({"nth": nth, "weight": weight.cast("long"), "limit": F.col("source_size") * mix.most})
    full_first = every.orderBy((F.col("limit") / F.col("weight")), "nth")
    before = F.coalesce(F.sum("limit").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(mix.share)
    out = out.withColumns({"level": (total - before) / rest})
    # the first source that its share does not fill up sets the level of all after it
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    out = out.withColumn("level", F.first(fits, ignorenulls=True).over(full_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))


def sainte_lague(parties: DataFrame, by: list[str], votes: str, seats: str, order: list[str], name: str) -> DataFrame:
    """``parties`` with a column ``name``: the seats of each one by the highest quotients votes / (2 k + 1).

    ``seats`` is the number for each group of ``by``. A party's seats differ from its rounded share by at most
    n * share / 2 + 1, n being the number of parties, so that only quotients in that range are ranked: about three
    for each party.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.coalesce(F.col(votes) / F.nullif(F.sum(votes).over(group), F.lit(0)), F.lit(0.0))
    out = parties.withColumns({"_share": share, "_n": F.count("*").over(group)})
    near = F.floor(F.col(seats) * F.col("_share") + 0.5)
    width = F.ceil(F.col("_n") * F.col("_share") / 2) + 1
    out = out.withColumns({"_base": F.greatest(near - width, F.lit(0)), "_to": near + width})
    out = out.withColumn("_left", F.col(seats) - F.sum("_base").over(group))
    ranked = out.withColumn("_k", F.explode(F.sequence("_base", "_to")))
    rank = F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order))
    won = F.count(F.when((F.col("_rank") <= F.col("_left")) & (F.col(votes) > 0), 1))
    keep = parties.columns
    return ranked.withColumn("_rank", rank).groupBy(*keep, "_base").agg(won.alias("_won")).select(*keep, (F.col("_base") + F.col("_won")).alias(name))


def plan(sized: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Sources and cells (source, shard) with their quotas, both written tables; ``sized``: source, size, order_key."""
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix))
    every = Window.partitionBy(F.lit(0))
    joint = F.col("source_size") >= mix.fine * mix.block_words
    block = F.when(joint, F.lit(mix.block_words)).otherwise(F.greatest(F.lit(1), F.floor(F.col("source_size") / mix.fine))).cast("long")
    shards = F.greatest(F.lit(1), F.least(F.lit(mix.most_shards), F.ceil(F.col("source_size") / mix.shard_words))).cast("long")
    seats = F.coalesce(F.floor(F.sum(F.when(F.col("joint"), F.col("target"))).over(every) / mix.block_words + 0.5), F.lit(0))
    sources = sources.withColumns({"joint": joint, "block": block, "n_shards": shards})
    sources = sources.withColumn("_seats", F.when(F.col("joint"), seats).otherwise(F.lit(0)).cast("long"))
    sources = sainte_lague(sources, ["joint"], "target", "_seats", ["nth"], "blocks").drop("_seats")
    own = F.floor(F.col("target") / F.col("block") + 0.5)
    sources = written(sources.withColumn("blocks", F.when(F.col("joint"), F.col("blocks")).otherwise(own).cast("long")))
    cells = in_shards(sized, sources).groupBy("source", "shard", "block", "blocks").agg(F.sum("size").alias("cell_size"))
    cells = sainte_lague(cells, ["source"], "cell_size", "blocks", ["shard"], "quota")
    n = F.ceil(F.col("cell_size") / F.col("block")).cast("long")
    cells = cells.withColumn("n_blocks", n).withColumn("quota", F.least("quota", F.col("n_blocks") * mix.most))
    whole = F.greatest("n_blocks", F.lit(1))
    cells = cells.withColumns({"passes": F.floor(F.col("quota") / whole), "rest": F.col("quota") % whole})
    place = F.md5(F.concat_ws(":", F.lit(mix.seed), "source", F.col("shard").cast("string")).cast("binary"))
    first = F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % (F.col("n_blocks") - F.col("rest") + 1)
    cells = cells.withColumns({"run_from": first * F.col("block"), "run_to": (first + F.col("rest")) * F.col("block")})
    return sources, written(cells.select("source", "shard", "passes", "run_from", "run_to"))


def in_shards(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with what ``sources`` says of its source, and a shard from the seeded order key."""
    said = small(sources.select(F.col("source").alias("_source"), "source_size", "target", "block", "blocks", "n_shards"))
    out = sized.join(said, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    first = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    return out.withColumn("shard", first % F.col("n_shards"))


def order_key(mix: Mix) -> Column:
    """The seeded order: by id and text, so that rows of one id (null, say) are spread over the shards, too."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))


def mixed(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``sized`` (a written table: doc_id, source, size, order_key, ...) with its source's size and target, and what the mix takes.

    ``passes``: times that the whole document is taken; ``start`` and ``end``: its words in its shard; ``run_from``,
    ``run_to``: the words of the shard that are taken once more. ``taken``: words in all.
    """
    sources, cells = plan(sized, mix)
    placed = in_shards(sized, sources)
    cell = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size")
    end = F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    said = small(cells.withColumnsRenamed({"source": "_source", "shard": "_shard"}))
    out = placed.join(said, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    part = F.greatest(F.lit(0), F.least("end", "run_to") - F.greatest("start", "run_from"))
    return out.withColumn("taken", F.col("passes") * F.col("size") + part)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), order_key(mix).alias("order_key")))
    return mixed(sized, mix).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document stands as often as it is taken whole, and once with the words of the picked blocks.

    A run of blocks cuts documents at words; a cut text is one piece, with the white space between its words.
    """
    mix = Mix()
    key = F.xxhash64("doc_id", "text", "source")
    slim = docs.select("doc_id", "source", key.alias("row_key"), F.size(words(F.col("text"))).cast("long").alias("size"), order_key(mix).alias("order_key"))
    chosen = mixed(written(slim), mix).where("taken > 0").select("row_key", "start", "run_from", "passes", F.col("size").alias("_size"), (F.col("taken") - F.col("passes") * F.col("size")).alias("part"))
    # rows of one id, text and source stand for one another: each meets the selections of its like by number
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_row")))
    left = docs.select(packed(docs).alias("_row"), key.alias("_key")).withColumn("_nth", nth)
    chosen = chosen.withColumn("_which", F.row_number().over(Window.partitionBy("row_key").orderBy("start")))
    both = left.join(chosen, (F.col("_key") == F.col("row_key")) & (F.col("_nth") == F.col("_which")))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit("[^ \\t-\\r]+[ \\t-\\r]*"), F.lit(0))
    first = F.greatest(F.lit(0), F.col("run_from") - F.col("start")) + 1
    cut = F.array_join(F.slice(pieces, first.cast("int"), F.col("part").cast("int")), "")
    texts = F.array_compact(
        F.concat(
            F.array_repeat(F.col("_row.text"), F.col("passes").cast("int")),
            F.array(F.when(F.col("part") == F.col("_size"), F.col("_row.text")).when(F.col("part") > 0, F.regexp_replace(cut, "[ \\t-\\r]+$", ""))),
        )
    )
    out = both.withColumn("_text", F.explode(texts))
    return out.select(*(F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
