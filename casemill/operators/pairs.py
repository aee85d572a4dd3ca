"""Pairs of cases: queries against candidates that share a label, and picks among them.

What is judged by the metadata alone is judged once for each pair of profiles. What needs the
vectors or the keywords of each case has capped candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a pair of cases is judged by.
FIELDS = ["accusation", "articles", "death", "life", "months"]


def side(cases: DataFrame, prefix: str) -> DataFrame:
    return cases.select(F.col("case_id").alias(f"{prefix}_id"), *(F.col(n).alias(f"{prefix}_{n}") for n in FIELDS))


def queries_of(cases: DataFrame) -> DataFrame:
    """The query set of all searches: every case whose id is divisible by 20."""
    return cases.filter(F.col("case_id") % 20 == 0)


def label_pairs(cases: DataFrame, cap: int, asked: DataFrame | None = None) -> DataFrame:
    """(q_*, c_*) for each query (those of `asked`, some of the cases, or the query set) and at most `cap` other cases of each of its labels, in seeded order.
    A label's candidates are cut before the join, so it meets cap + 1 rows of a label, whatever the
    label's size. A pair comes once, at the first of its labels that lets it in."""
    each = cases.select("case_id", F.explode("accusation").alias("label"))
    few = seeded_caps(each, "label", cap + 1, name="place").groupBy("case_id", "label").agg(F.min("place").alias("place"))
    places = few.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "place"))).alias("places"))
    placed = lambda s: places.select(F.col("case_id").alias(f"{s}p_id"), F.col("places").alias(f"{s}_places"))
    c = side(cases, "c").join(placed("c"), F.col("c_id") == F.col("cp_id")).drop("cp_id").withColumn("c_label", F.explode(F.map_keys("c_places")))
    q = side(queries_of(cases) if asked is None else asked, "q").join(placed("q"), F.col("q_id") == F.col("qp_id"), "left").drop("qp_id").withColumn("label", F.explode("q_accusation"))

    def let_in(label: Column) -> Column:
        """A query among its label's first doesn't count against the cap."""
        own, other = F.col("q_places")[label], F.col("c_places")[label]
        return other <= F.lit(cap) + F.coalesce((own < other).cast("int"), F.lit(0))

    shared = F.filter(F.array_intersect("q_accusation", F.map_keys("c_places")), let_in)
    once = F.coalesce(F.col("label") == F.get(shared, F.lit(0)), F.lit(False))
    return q.join(c, (F.col("label") == F.col("c_label")) & (F.col("q_id") != F.col("c_id"))).filter(once).drop("label", "c_label", "q_places", "c_places")


def with_profile(cases: DataFrame) -> DataFrame:
    """profile: a hash of all that a pair is judged by; cases of one profile are judged alike."""
    return cases.withColumn("profile", F.md5(F.to_json(F.struct(*FIELDS))))


def profile_pairs(cases: DataFrame) -> DataFrame:
    """(q_profile, q_*, c_profile, c_*, n) for the profiles of queries and all profiles that share a
    label with them, n being the other side's cases. It grows with the variety of the cases, not
    with their number, so a label of a third of all cases is no hot key."""
    each = with_profile(cases).groupBy("profile", *FIELDS).agg(F.count("*").alias("n"), F.bool_or(F.col("case_id") % 20 == 0).alias("asked"))
    named = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("profile", *FIELDS)]
    q = each.filter("asked").select(*named("q"), F.explode("accusation").alias("label"))
    c = each.select(*named("c"), "n", F.explode("accusation").alias("c_label"))
    once = F.col("label") == F.element_at(F.array_intersect("q_accusation", "c_accusation"), 1)
    return q.join(c, F.col("label") == F.col("c_label")).filter(once).drop("label", "c_label")


#: Buckets of months grow by this factor, so a band of a ratio meets a few of them.
BUCKET = 1.25


def bucket(months: Column) -> Column:
    return F.floor(F.log1p(months.cast("double")) / F.log(F.lit(BUCKET))).cast("int")


def ratio_band(months: Column) -> tuple[Column, Column]:
    """The least and greatest term whose difference is at most three tenths of `months`, or of one month."""
    far = F.greatest(months, F.lit(1)) * F.lit(0.3) + 1e-9
    return F.greatest(F.ceil(months - far), F.lit(0)), F.floor(months + far)


def tolerance_band(months: Column) -> tuple[Column, Column]:
    """The least and greatest term within max(6, a fifth of `months`)."""
    far = F.greatest(F.lit(6.0), months * F.lit(0.2)) + 1e-9
    return F.greatest(F.ceil(months - far), F.lit(0)), F.floor(months + far)


def band_pairs(cases: DataFrame, band: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """profile_pairs whose flags are equal and, if none is set, whose terms are within the query's band. A
    band join: the query's side meets the buckets of months that its band touches, and the join's own
    condition ends at the band, so no pair outside it is made."""
    each = with_profile(cases).groupBy("profile", *FIELDS).agg(F.count("*").alias("n"), F.bool_or(F.col("case_id") % 20 == 0).alias("asked"))
    each = each.withColumn("flags", F.col("death").cast("int") * 2 + F.col("life").cast("int"))
    named = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("profile", *FIELDS)]
    low, high = band(F.col("months"))
    free, none = F.col("flags") == 0, F.lit(-1)
    q = each.filter("asked").select(*named("q"), F.col("flags"), low.alias("low"), high.alias("high"), F.explode("accusation").alias("label"), F.when(free, F.sequence(bucket(low), bucket(high))).otherwise(F.array(none)).alias("buckets"))
    q = q.withColumn("bucket", F.explode("buckets")).drop("buckets")
    c = each.select(*named("c"), "n", F.col("flags").alias("c_flags"), F.explode("accusation").alias("c_label"), F.when(free, bucket(F.col("months"))).otherwise(none).alias("c_bucket"))
    met = (F.col("label") == F.col("c_label")) & (F.col("flags") == F.col("c_flags")) & (F.col("bucket") == F.col("c_bucket"))
    within = (F.col("flags") > 0) | F.col("c_months").between(F.col("low"), F.col("high"))
    once = F.col("label") == F.element_at(F.array_intersect("q_accusation", "c_accusation"), 1)
    return q.join(c, met & within & once).drop("label", "c_label", "flags", "c_flags", "bucket", "c_bucket", "low", "high")


def expand(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """q_id, c_id and the other columns of judged(q_profile, c_profile, ...) for each pair of cases."""
    ids = with_profile(cases).select("case_id", "profile")
    q = queries_of(ids).select(F.col("case_id").alias("q_id"), F.col("profile").alias("q_profile"))
    c = ids.select(F.col("case_id").alias("c_id"), F.col("profile").alias("c_profile"))
    rest = [x for x in judged.columns if x not in ("q_profile", "c_profile")]
    return judged.join(q, "q_profile").join(c, "c_profile").filter("q_id <> c_id").select("q_id", "c_id", *rest)


def level_top(judged: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """q_id, c_id, level, rank: the k closest of judged(q_profile, c_profile, level), in seeded order
    within a level. A profile's first k + 1 members stand for it, since one of them may be the
    query; each query profile is ranked once for all its queries."""
    ids = with_profile(cases).select("case_id", "profile")
    first = seeded_caps(ids, "profile", k + 1).select(F.col("case_id").alias("c_id"), F.col("profile").alias("c_profile"))
    near = top(judged.join(first, "c_profile"), "q_profile", k + 1, F.col("level"), seeded("c_id")).select("q_profile", "c_id", "level")
    q = queries_of(ids).select(F.col("case_id").alias("q_id"), F.col("profile").alias("q_profile"))
    return top(q.join(near, "q_profile").filter("q_id <> c_id"), "q_id", k, F.col("level"), seeded("c_id")).select("q_id", "c_id", "level", "rank")


def ranked(rows: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def top(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return ranked(rows, group, *order).filter(F.col("rank") <= k)


def seeded(column: str | Column, seed: int = 7) -> Column:
    """A reproducible shuffle key that every engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string") if isinstance(column, str) else column))


def full_groups(rows: DataFrame, group: str, least: int) -> DataFrame:
    """The groups with `least` members or more, by an aggregate and a semi-join."""
    big = rows.groupBy(group).count().filter(F.col("count") >= least).select(F.col(group).alias("__g"))
    return rows.join(big, F.col(group) == F.col("__g"), "left_semi")


def first_wins(rows: DataFrame, group: str, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in each group; empty keys are dropped."""
    keyed = rows.withColumn("__key", key).filter("__key <> ''")
    w = Window.partitionBy(group, "__key").orderBy(*order)
    return keyed.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def round_robin(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Takes one of each group in turn, in seeded order, until there are n; no group gives more."""
    turn = seeded_caps(rows, group, n, name="turn")
    return turn.orderBy("turn", seeded(group), group).limit(n)


def seeded_caps(rows: DataFrame, group: str, most: int, parts: int = 16, name: str | None = None) -> DataFrame:
    """At most `most` rows of each group, in seeded order of case_id; name: a column for the place. Each
    part of a group is cut first, so no group meets whole in one task."""
    order = [seeded("case_id"), F.col("case_id")]
    salted = rows.withColumn("__part", F.pmod(F.xxhash64("case_id"), F.lit(parts)))
    few = salted.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))).filter(F.col("__n") <= most).drop("__n", "__part")
    cut = few.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= most)
    return cut.withColumnRenamed("__n", name) if name else cut.drop("__n")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the sink yet."""
    return rows.join(done.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")
