"""Rows paired one to one by keys that name the same thing, in groups of any size.

Two keys match if the letters and digits of one lie within those of the other and their digits are the same (equal keys
do). So rows with the same letters and digits are alike, and what is joined is distinct keys: the shorter key looks up
its rarest piece of PIECE letters among the pieces of the other side's keys, and what it meets is then compared.

The pairing itself is that of true rows that take, in their order, the first matching found row that is left. It is made
in rounds. True keys that match the same found keys make a team, whose rows have the same choices. All rows of a team that
come before the first row of every rival (a team that shares a found key) are decided at once: the first of them takes the
team's first free choice, the second one the second, and so on. Each round decides at least the first open row of each
group; where teams don't share found keys, which is usual, one round decides all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.matching import key_parts
from gradeline.operators.ordinals import numbered
from gradeline.stages import cut

#: Letters of a piece by which keys are looked up; shorter keys are looked up whole.
PIECE = 3


def _pieces(bare: Column, size: int) -> Column:
    """Distinct pieces of exactly ``size`` letters."""
    last = F.length(bare) - (size - 1)
    cut_out = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(bare, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(cut_out)).otherwise(F.array().cast("array<string>"))


def _within(short: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    """(by, short, long): distinct keys (by, bare, digits) where the one lies within the other and digits are the same."""
    all_pieces = F.concat(F.array(F.lit("")), *[_pieces(F.col("bare"), n) for n in range(1, PIECE + 1)])
    index = long.select(*by, "digits", F.col("bare").alias("long"), F.explode(all_pieces).alias("piece"))
    own = F.when(F.length("bare") >= PIECE, _pieces(F.col("bare"), PIECE)).otherwise(F.array("bare"))
    asked = short.select(*by, "digits", F.col("bare").alias("short"), own.alias("_own")).withColumn("_all", F.size("_own"))
    asked = asked.select(*by, "digits", "short", "_all", F.explode("_own").alias("piece"))
    often = index.groupBy(*by, "digits", "piece").agg(F.count(F.lit(1)).alias("_often"))
    # A key of which one piece is missing lies within no other.
    rarest = asked.join(often, [*by, "digits", "piece"]).groupBy(*by, "digits", "short", "_all").agg(F.min(F.struct("_often", "piece")).alias("_rarest"), F.count(F.lit(1)).alias("_had"))
    rarest = rarest.where(F.col("_had") == F.col("_all")).select(*by, "digits", "short", F.col("_rarest.piece").alias("piece"))
    return rarest.join(index, [*by, "digits", "piece"]).where(F.contains("long", "short")).select(*by, "short", "long")


def linked_keys(truth: DataFrame, found: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """(by, bare, other): the letters and digits of true and found keys that match; ``by`` may be empty."""
    parts = lambda df: df.select(*by, key_parts(F.col(key)).alias("_k")).select(*by, "_k.bare", "_k.digits").where("bare is not null").distinct()
    t, f = parts(truth), parts(found)
    one = _within(t, f, by).select(*by, F.col("short").alias("bare"), F.col("long").alias("other"))
    return one.unionByName(_within(f, t, by).select(*by, F.col("long").alias("bare"), F.col("short").alias("other"))).distinct()


def components(links: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, bare, part) and (by, other, part): true and found keys that are linked, also through others, have the same part.

    Each key takes the smallest label of its neighbours until none changes, one step for each link of the longest chain.
    """
    labels = cut(links.select(*by, "bare").distinct().withColumn("part", F.xxhash64("bare")))
    while True:
        over = links.join(labels, [*by, "bare"]).groupBy(*by, "other").agg(F.min("part").alias("part"))
        new = cut(links.join(over, [*by, "other"]).groupBy(*by, "bare").agg(F.min("part").alias("part")))
        settled = new.join(labels.withColumnRenamed("part", "_old"), [*by, "bare"]).where("part <> _old").isEmpty()
        labels = new
        if settled:
            return labels, cut(links.join(labels, [*by, "bare"]).select(*by, "other", "part").distinct())


def paired(truth: DataFrame, found: DataFrame, by: list[str], key: str = "key", order: str = "ord") -> DataFrame:
    """(by, ord, match) of the true rows that get a found row. Orders are unique within a group; ``by`` has no nulls."""
    # The columns of the group get names that nothing else has.
    named, by = by, [f"_by{i}" for i in range(len(by))]
    plain = lambda df: df.select(*[F.col(c).alias(n) for c, n in zip(named, by, strict=True)], F.col(key).alias("_key"), F.col(order).alias("_order"))
    truth, found, key, order = plain(truth), plain(found), "_key", "_order"
    bare = key_parts(F.col(key))["bare"]
    links = cut(linked_keys(truth, found, by, key))
    rows = cut(truth.select(*by, F.col(order).alias("ord"), bare.alias("bare")))
    choices = numbered(found.select(*by, F.col(order).alias("match"), bare.alias("other")).where("other is not null"), [*by, "other"], "match", "place")
    choices = cut(choices.join(links.select(*by, "other").distinct(), [*by, "other"], "left_semi"))
    # Found rows of one key are taken in their order, so how many are gone says which are left.
    left = choices.groupBy(*by, "other").agg(F.max("place").alias("all")).withColumn("gone", F.lit(0).cast("bigint"))
    done: list[DataFrame] = []
    team = [*by, "team", "twin"]
    while True:
        left = cut(left.where("gone < all"))
        links = cut(links.join(left.select(*by, "other"), [*by, "other"], "left_semi").join(rows.select(*by, "bare").distinct(), [*by, "bare"], "left_semi"))
        rows = cut(rows.join(links.select(*by, "bare").distinct(), [*by, "bare"], "left_semi"))
        if rows.isEmpty():
            break
        # The choices of a key as two sums over hashes: keys with the same ones make a team.
        sign = links.groupBy(*by, "bare").agg(
            F.bit_xor(F.xxhash64("other")).alias("team"), F.bit_xor(F.xxhash64(F.lit(1), "other")).alias("twin")
        )
        teamed = cut(rows.join(sign, [*by, "bare"]))
        edges = links.join(sign, [*by, "bare"]).select(*team, "other").distinct()
        firsts = teamed.groupBy(*team).agg(F.min("ord").alias("first"))
        edges = cut(edges.join(firsts, team))
        lead = edges.groupBy(*by, "other").agg(F.min(F.struct("first", "team", "twin")).alias("lead"))
        led = edges.join(lead, [*by, "other"])
        is_lead = (F.col("lead.team") == F.col("team")) & (F.col("lead.twin") == F.col("twin"))
        second = led.where(~is_lead).groupBy(*by, "other").agg(F.min("first").alias("second"))
        rival = led.join(second, [*by, "other"], "left").withColumn("rival", F.when(is_lead, F.col("second")).otherwise(F.col("lead.first")))
        until = rival.groupBy(*team).agg(F.min("rival").alias("until"))
        free = teamed.join(until, team).where("until is null or ord < until").select(*team, "ord")
        free = cut(numbered(free, team, "ord", "turn"))
        wanted = free.groupBy(*team).agg(F.max("turn").alias("wanted"))
        # The first choices of a team, as many of each found key as it has rows.
        window = edges.join(wanted, team).join(left, [*by, "other"]).select(*team, "other", "gone", (F.col("gone") + F.col("wanted")).alias("_to"))
        offers = choices.join(window, [*by, "other"]).where("place > gone and place <= _to").select(*team, "other", "match")
        offers = numbered(offers, team, "match", "turn")
        taken = cut(free.join(offers, [*team, "turn"]))
        done.append(taken.select(*by, "ord", "match"))
        rows = rows.join(free.select(*by, "ord"), [*by, "ord"], "left_anti")
        more = taken.groupBy(*by, "other").agg(F.count(F.lit(1)).alias("_more"))
        left = left.join(more, [*by, "other"], "left").withColumn("gone", F.col("gone") + F.coalesce("_more", F.lit(0))).drop("_more")
    pairs = reduce(DataFrame.unionByName, done) if done else rows.select(*by, "ord", F.lit(None).cast(dict(found.dtypes)[order]).alias("match"))
    return pairs.select(*[F.col(n).alias(c) for c, n in zip(named, by, strict=True)], "ord", "match")
