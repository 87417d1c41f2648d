"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import put
from marketloom.operators.prefix import number_rows, running_total

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last; a mix of ``share`` of all words takes at most ``repeats`` times a
    source. Words are dealt in blocks of ``block`` words to ``shards`` shards."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    repeats: int = 3
    block: int = 16
    shards: int = 8
    seed: int = 5


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, group and size of every row; the group sorts as the source does, with null last, and is never null."""
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("group"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(narrow: DataFrame, mix: Mix) -> DataFrame:
    """group, source_size, target of every source.

    Targets share the total by weight. In ascending order of what a source can give for its weight, sources whose fair part of the rest is
    more than ``repeats`` times their size stop there; the first that can give its part sets the level of all that follow.
    """
    sizes, _ = put(narrow.groupBy("group").agg(F.sum("size").alias("source_size")), "mix-sources")
    numbered = number_rows(sizes, [F.col("group")], "n")
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), ((F.col("n") - 1) % len(mix.weights) + 1).cast("int"))
    ready = numbered.select("group", "source_size", "n", weight.cast("long").alias("weight"), (F.col("source_size") * mix.repeats).alias("most"))
    ready = ready.withColumn("ratio", F.col("most") / F.col("weight"))
    ran = running_total(ready, [], [F.col("ratio"), F.col("n")], {"most_to": "most", "weight_to": "weight"}, few_groups=False)
    whole = ready.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    # One row of totals; the hint is safe.
    ran = ran.join(F.broadcast(whole))
    words = F.col("all_words") * F.lit(mix.share)
    level = (words - (F.col("most_to") - F.col("most"))) / (F.col("all_weight") - F.col("weight_to") + F.col("weight"))
    ran, _ = put(ran.select("group", "source_size", "n", "weight", "most", "ratio", level.alias("level")), "mix-levels")
    first = ran.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "n")).alias("set_level"))
    return ran.join(F.broadcast(first)).select(
        "group", "source_size", "n", F.when(F.col("set_level").isNull(), F.col("most").cast("double"))
        .otherwise(F.least(F.col("most").cast("double"), F.col("set_level") * F.col("weight"))).alias("target"))


def shard_quotas(targets: DataFrame, mix: Mix) -> DataFrame:
    """group, source_size, target, blocks, shard, quota, seats: blocks of each source in each shard, and in the shards up to it.

    The seats up to a shard are the highest quotients target / (2k + 1) of all sources, ties in source order. Rather than listing all
    quotients, every source first gets those above a bound that surely gives out no seat too many; those between it and a second bound
    that surely gives out enough, about two for each source, are ranked.
    """
    whole = targets.agg(F.sum("target").alias("all_words"), F.count("*").alias("sources"))
    shards = F.explode(F.sequence(F.lit(1), F.lit(mix.shards)))
    t = targets.join(F.broadcast(whole)).withColumn("blocks", F.ceil(F.col("source_size") / mix.block)).withColumn("shard", shards)
    t = t.withColumn("house", F.round(F.col("all_words") / mix.block * F.col("shard") / mix.shards).cast("long"))

    def above(house: Column) -> Column:
        bound = F.col("all_words") / (2 * house)
        count = F.floor(F.col("target") / (2 * bound) + 0.5)
        return F.when((house > 0) & (F.col("target") > 0), F.least(count, F.col("blocks") * mix.repeats)).otherwise(0)

    half = F.col("sources") / 2
    t, _ = put(t.withColumn("sure", above(F.col("house") - half)).withColumn("maybe", F.when(F.col("house") > 0, above(F.col("house") + half)).otherwise(0)), "mix-seats")
    left = t.groupBy("shard").agg((F.max("house") - F.sum("sure")).alias("left"))
    extra = t.where("maybe > sure").select("group", "n", "shard", "target", F.explode(F.sequence("sure", F.col("maybe") - 1)).alias("k"))
    order = Window.partitionBy("shard").orderBy(F.desc("quotient"), "n", "k")
    ranked = extra.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1)).withColumn("place", F.row_number().over(order))
    won = ranked.join(left, "shard").where("place <= left").groupBy("group", "shard").agg(F.count("*").alias("won"))
    up_to = t.join(won, ["group", "shard"], "left").select("group", "source_size", "target", "blocks", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("group").orderBy("shard"))
    return up_to.withColumn("quota", F.col("seats") - before)


def block_picks(quotas: DataFrame, mix: Mix) -> DataFrame:
    """group, shard, blocks_lo, blocks_hi: the blocks of its source's seeded stream that each shard takes, ``quota`` of them in every shard.

    Blocks that every pass takes are dealt to the shards seat by seat. The last pass takes some blocks only: there each shard owns a
    stretch of blocks in proportion to the quota it has still to fill, and takes that many from a seeded block of the stretch on.
    """
    seats = F.max("seats").over(Window.partitionBy("group"))
    t = quotas.where("blocks > 0").withColumn("passes", F.floor(seats / F.col("blocks"))).withColumn("rest", seats - F.col("passes") * F.col("blocks"))
    whole = F.col("passes") * F.col("blocks")
    t = t.withColumns({"from_seat": F.col("seats") - F.col("quota"), "rest_from": F.greatest(F.col("seats") - F.col("quota") - whole, F.lit(0)),
                       "rest_to": F.greatest(F.col("seats") - whole, F.lit(0))})

    def in_pass(number: int) -> Column:
        before = F.lit(number) * F.col("blocks")
        return F.struct(F.greatest(F.col("from_seat") - before, F.lit(0)).cast("long").alias("blocks_lo"),
                        F.when(before < whole, F.least(F.col("seats") - before, F.col("blocks"))).otherwise(0).cast("long").alias("blocks_hi"))

    def edge(seat: Column) -> Column:
        return F.when(F.col("rest") > 0, seat + F.floor((F.col("blocks") - F.col("rest")) * (seat / F.col("rest")))).otherwise(0)

    need = F.col("rest_to") - F.col("rest_from")
    t = t.withColumns({"stretch_lo": edge(F.col("rest_from")), "stretch_hi": edge(F.col("rest_to"))})
    spare = F.col("stretch_hi") - F.col("stretch_lo") - need
    begin = F.col("stretch_lo") + F.pmod(F.xxhash64("group", "shard", F.lit(mix.seed)), F.greatest(spare + 1, F.lit(1)))
    last = F.struct(begin.cast("long").alias("blocks_lo"), (begin + need).cast("long").alias("blocks_hi"))
    taken = F.explode(F.array(*[in_pass(k) for k in range(mix.repeats)], last)).alias("run")
    return t.select("group", "shard", taken).select("group", "shard", "run.*").where("blocks_lo < blocks_hi")


def _placed(docs: DataFrame, mix: Mix) -> DataFrame:
    """Narrow rows with source_size, target, their words [begin, end) in their source's seeded stream, and ``runs``: the words that shards
    take of that stream, at most repeats + 1 runs for each shard."""
    narrow, _ = put(_narrow(docs), "mix-rows")
    quotas, _ = put(shard_quotas(source_targets(narrow, mix), mix), "mix-quotas")
    run = F.struct("shard", (F.col("blocks_lo") * mix.block).alias("lo"), (F.col("blocks_hi") * mix.block).alias("hi"))
    runs = block_picks(quotas, mix).groupBy("group").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    plan = quotas.where(F.col("shard") == mix.shards).select("group", "source_size", "target").join(runs, "group", "left")
    order = [F.xxhash64("doc_id", F.lit(mix.seed)), F.col("doc_id"), F.col("size")]
    lying = running_total(narrow, ["group"], order, {"end": "size"}, few_groups=False)
    return lying.join(plan, "group").withColumn("begin", F.col("end") - F.col("size"))


def _own_runs() -> Column:
    """The runs that meet a row: shard, and the words [lo, hi) of the row."""
    met = F.filter("runs", lambda r: (r["lo"] < F.col("end")) & (r["hi"] > F.col("begin")) & (F.col("size") > 0))
    return F.transform(F.coalesce(met, F.array()), lambda r: F.struct(
        r["shard"].alias("shard"), (F.greatest(r["lo"], F.col("begin")) - F.col("begin")).alias("lo"), (F.least(r["hi"], F.col("end")) - F.col("begin")).alias("hi")))


def mix_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken and shard_words (words taken by shard) of every row of ``docs``.

    Null texts have size 0; null is a source of its own, after all others. Repeated rows are rows of their own. The result depends on the
    rows and the seed only.
    """
    rows = _placed(docs, mix).withColumn("own", _own_runs())

    def words(runs: Column) -> Column:
        return F.aggregate(runs, F.lit(0).cast("long"), lambda total, r: total + r["hi"] - r["lo"])

    by_shard = F.transform(F.array_distinct("own.shard"), lambda s: F.struct(s.alias("shard"), words(F.filter("own", lambda r: r["shard"] == s)).alias("words")))
    return rows.select("doc_id", "size", "source_size", "target", words(F.col("own")).alias("taken"), F.map_from_entries(by_shard).alias("shard_words"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), shard_name: str | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each run of words of a document that a shard takes.

    Documents that lie inside a run are whole; those that the end of a run cuts appear with the words that are taken; documents of which
    nothing is taken do not appear. With ``shard_name`` the shard (from 1) follows as a column of that name. A null doc_id with equal rows
    is taken as often as those rows. A numeric column n_chars follows the text.
    """
    rows = _placed(docs, mix).withColumn("own", _own_runs())
    # Rows of one number, source and size are told apart by their place; their texts are numbered alike.
    key = ["group", "doc_id", "size"]
    rows = rows.select(*key, "own", F.row_number().over(Window.partitionBy(*key).orderBy("begin")).alias("twin")).where(F.size("own") > 0)
    # The row travels as one column, so its names cannot clash with those made here.
    named = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), *[c.alias(f"row_{a}") for c, a in zip(_keys(docs), key)])
    named = named.withColumn("row_twin", F.row_number().over(Window.partitionBy(*[f"row_{k}" for k in key]).orderBy("text")))
    met = named.join(rows, (F.col("row_group") == F.col("group")) & F.col("row_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_size") == F.col("size"))
                     & (F.col("row_twin") == F.col("twin")))
    runs = met.withColumn("run", F.explode("own"))
    length = F.col("run.hi") - F.col("run.lo")
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    cut = F.array_join(F.slice(pieces, (F.col("run.lo") + 1).cast("int"), length.cast("int")), "")
    out = runs.withColumn("taken_text", F.when(length == F.col("size"), F.col("text")).otherwise(cut))
    replaced = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.char_length("taken_text").cast(docs.schema["n_chars"].dataType)
    shard = [F.col("run.shard").alias(shard_name)] if shard_name else []
    return out.select(*[(replaced[c] if c in replaced else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *shard)


def _keys(docs: DataFrame) -> list[Column]:
    source = F.col("source").cast("string")
    return [F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)), F.col("doc_id").cast("long"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")]
