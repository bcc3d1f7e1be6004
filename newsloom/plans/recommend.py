"""Recommendations with a result cache that expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import with_evaluated
from newsloom.functions.payloads import category_key
from newsloom.operators.similarity import RANK_DIGITS, check_requests, normal_requests, pair_scores, top_k, with_source
from newsloom.schemas import ALL_CATEGORIES_KEY, CACHE_TTL_SECONDS, CACHED_LIST, MAX_K, MIN_K
from newsloom.session import shared_dir, stored

KEY = ["news_id", "k", "category_key"]
# The items of a list while it is merged, best first; of an article indexed once more, what is new comes first.
MERGED = "array<struct<order:double,match_id:bigint,held:boolean,shown:double,title:string,category:string>>"


def current_lists(cache: DataFrame, as_of: Column, epochs: DataFrame | None = None) -> DataFrame:
    """Cached lists that may be served: not expired and, with ``epochs``, computed after the last indexing.

    ``epochs`` is (category, indexed_at), see :func:`newsloom.plans.indexing.read_epochs`.
    A list over a category counts as old from that category's last indexing on, a
    list over everything from the last one of all. Categories are few, so Spark
    broadcasts them and the cache is neither shuffled nor rewritten.
    """
    live = cache.where(F.col("expires_at") > as_of)
    if epochs is None:
        return live
    own = epochs.select(F.col("category").alias("category_key"), "indexed_at")
    last = epochs.agg(F.max("indexed_at").alias("indexed_at")).where("indexed_at is not null")
    own = own.where(F.col("category_key") != ALL_CATEGORIES_KEY).unionByName(last.withColumn("category_key", F.lit(ALL_CATEGORIES_KEY)))
    since = own.groupBy("category_key").agg(F.max("indexed_at").alias("indexed_at"))
    dated = live.join(since, "category_key", "left")
    return dated.where(F.col("indexed_at").isNull() | (F.col("computed_at") > F.col("indexed_at"))).select(cache.columns)


def read_cache(requests: DataFrame, cache: DataFrame, as_of: Column, epochs: DataFrame | None = None) -> DataFrame:
    """Requests (news_id, k, category_filter) with ``category_key``, ``hit`` and the cached ``items``.

    A hit needs the same key, ``as_of`` before the expiry and, with ``epochs``, a list
    computed after the last indexing that concerns it. The expiry filter is on the
    cache side of the join, so expired lists are dropped at the scan.
    """
    live = current_lists(cache, as_of, epochs).select(*KEY, "items", F.lit(True).alias("_live"))
    keyed = normal_requests(requests).withColumn("category_key", category_key(F.col("category_filter")))
    return keyed.join(live, KEY, "left").withColumn("hit", F.coalesce("_live", F.lit(False))).drop("_live")


def expiring(lists: DataFrame, as_of: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Stamp computed lists with their validity."""
    ends = as_of + F.make_interval(secs=F.lit(ttl_seconds))
    return lists.withColumn("computed_at", as_of).withColumn("expires_at", ends)


def answerable(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct valid requests whose source is indexed and which have at least one candidate."""
    wanted = requests.select("news_id", "k", "category_filter").distinct()
    sourced = with_source(check_requests(wanted).where("status = 'ok'"), index).where("status = 'ok'")
    own = index.select("news_id", F.col("category").alias("_own"))
    # The rollup's total is the whole index, which is what a null filter searches; rows without a category are no set.
    crowd = (
        index.rollup("category")
        .agg(F.count("*").alias("_members"), F.grouping("category").alias("_total"))
        .where((F.col("_total") == 1) | F.col("category").isNotNull())
        .select(F.col("category").alias("_in"), "_members")
    )
    asked = sourced.drop("embedding").join(own, "news_id")
    sized = asked.join(crowd, F.col("category_filter").eqNullSafe(F.col("_in")), "left")
    is_member = F.col("category_filter").isNull() | (F.col("_own") == F.col("category_filter"))
    others = F.coalesce("_members", F.lit(0)) - is_member.cast("int")
    return sized.where(others > 0).select("news_id", "k", "category_filter")


def missed_lists(misses: DataFrame, index: DataFrame, **search) -> DataFrame:
    """(news_id, k, category_key, items) for each miss that may be cached.

    Candidates that are all below the score floor still give a list, an empty one.
    """
    # Read by several branches of the search and by the final join.
    asked = stored(answerable(misses, index), "asked")
    # The lists of an article over the same candidates begin alike: only the longest is searched, the others are cut from it.
    longest = F.max("k").over(Window.partitionBy("news_id", "category_filter"))
    widest = stored(asked.withColumn("_longest", longest).where("k = _longest").select(asked.columns), "widest")
    matches = stored(top_k(widest, index, **search), "matches")
    # A filter that is null may equal none that is given.
    among = F.concat(F.when(F.col("category_filter").isNull(), "*").otherwise("="), F.coalesce("category_filter", F.lit(""))).alias("_among")
    item = F.struct("rank", F.struct("news_id", "title", "category", "similarity_score").alias("item"))
    lists = (
        matches.select(F.col("source_news_id").alias("_source"), among, item.alias("_item"))
        .groupBy(F.col("_source").alias("news_id"), "_among")
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    )
    keyed = asked.select("news_id", "k", category_key(F.col("category_filter")).alias("category_key"), among)
    cut = F.transform(F.filter("_items", lambda x: x["rank"] <= F.col("k")), lambda x: x["item"])
    empty = F.array().cast(CACHED_LIST["items"].dataType)
    return keyed.join(lists, ["news_id", "_among"], "left").select(*KEY, F.coalesce(cut, empty).alias("items"))


def write_back(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the fresh lists in place of older ones under the same key."""
    kept = cache.join(fresh.select(KEY), KEY, "left_anti")
    return kept.unionByName(fresh.select(cache.columns))


def refreshed_lists(
    cache: DataFrame, indexed: DataFrame, index: DataFrame, as_of: Column, search=top_k, **options
) -> DataFrame:
    """The cache after ``indexed`` articles came into ``index``: the same lists as if all were computed again.

    The sources of the lists in force are searched among the newly indexed articles
    only, and what is found is merged into the lists. Cached scores are rounded, so
    the items of lists that gain something are scored again, a pair of articles once.
    ``search`` is :func:`top_k` or a function with its arguments. Refreshed lists count
    as computed at ``as_of`` and expire when they did; expired ones are left out.

    The lists are sent once for their ids and once for the merge, an article's lists to
    one place, and are merged as they are, without a row per item.
    """
    live = cache.where(F.col("expires_at") > as_of)
    valid = F.col("k").between(MIN_K, MAX_K)
    longest = live.where(valid).groupBy("news_id", "category_key").agg(F.max("k").alias("k"))
    keys = stored(longest.select("news_id", "k", F.nullif("category_key", F.lit(ALL_CATEGORIES_KEY)).alias("category_filter")), "keys")
    found = search(keys, index, among=indexed, details=False, **options)
    details = indexed.select(F.col("news_id").alias("match_id"), "title", "category")
    found = found.select("news_id", category_key(F.col("category_filter")).alias("category_key"), "rank", "match_id", "score")
    gained = stored(found.join(details, "match_id"), "gained")

    ids = live.where(valid).select("news_id", F.col("items.news_id").alias("ids")).groupBy("news_id")
    ids = ids.agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    held = ids.join(gained.select("news_id").distinct(), "news_id", "left_semi")
    pairs = held.select(F.col("news_id").alias("left_id"), F.explode("ids").alias("right_id"))
    scores = stored(pair_scores(pairs, index, many=True), "scores")

    # Rounded once per pair, not once per list.
    order, shown = (-F.rint(F.col("score") * 10.0**RANK_DIGITS)).alias("order"), F.round("score", 4).alias("shown")
    # All by the article, so that nothing is sent again for the groupings and joins below.
    known = scores.where("similarity is not null").repartition("left_id").groupBy("left_id", "right_id").agg(F.max("similarity").alias("score"))
    scored = F.map_from_entries(F.collect_list(F.struct("right_id", F.struct(order, shown))))
    known = known.groupBy(F.col("left_id").alias("news_id")).agg(scored.alias("_scores"))
    item = F.struct(order, "match_id", shown, "title", "category", "rank")
    more = gained.repartition("news_id").groupBy("news_id", "category_key").agg(F.collect_list(item).alias("_more"))
    more = more.groupBy("news_id").agg(F.map_from_entries(F.collect_list(F.struct("category_key", "_more"))).alias("_gained"))
    rows = live.join(more, "news_id", "left").join(known, "news_id", "left")

    def entry(of: Column, match_id: Column, x: Column, held: bool) -> Column:
        parts = [of["order"].alias("order"), match_id.alias("match_id"), F.lit(held).alias("held"), of["shown"].alias("shown")]
        return F.struct(*parts, x["title"].alias("title"), x["category"].alias("category"))

    gains = F.filter(F.col("_gained")[F.col("category_key")], lambda x: x["rank"] <= F.col("k"))
    gains = F.transform(gains, lambda x: entry(x, x["match_id"], x, False))
    # Items that are not in the index any more have no score.
    old = F.transform("items", lambda x: entry(F.col("_scores")[x["news_id"]], x["news_id"], x, True))
    old = F.coalesce(F.filter(old, lambda x: x["order"].isNotNull()), F.array().cast(MERGED))
    both = F.when(valid, F.sort_array(F.concat(old, gains)))
    rows = with_evaluated(rows, "_both", both)
    # An article indexed once more stands in a list once.
    ids = F.transform("_both", lambda x: x["match_id"])
    single = F.when(F.size(F.array_distinct(ids)) == F.size("_both"), F.col("_both")).otherwise(
        F.filter("_both", lambda x, i: F.array_position(ids, x["match_id"]) == i + 1)
    )
    new = F.transform(
        F.slice(single, 1, F.col("k")),
        lambda x: F.struct(x["match_id"].alias("news_id"), x["title"].alias("title"), x["category"].alias("category"), x["shown"].alias("similarity_score")),
    )
    return rows.withColumn("items", F.when(F.size("_both") > 0, new).otherwise(F.col("items"))).withColumn("computed_at", as_of).select(cache.columns)


def invalidate(cache: DataFrame, indexed: DataFrame) -> DataFrame:
    """Drop the lists that newly indexed articles (category) may have changed.

    These are the lists over their categories and over everything. Nothing
    indexed, nothing dropped.
    """
    changed = indexed.select(F.col("category").alias("category_key")).distinct()
    everything = changed.limit(1).select(F.lit(ALL_CATEGORIES_KEY).alias("category_key"))
    return cache.join(changed.unionByName(everything), "category_key", "left_anti").select(cache.columns)


def serve(
    requests: DataFrame, index: DataFrame, cache: DataFrame, as_of: Column, epochs: DataFrame | None = None, **search
) -> tuple[DataFrame, DataFrame]:
    """Answer requests: (news_id, k, category_key, items, cached) and the cache afterwards.

    Requests that cannot be answered get null items. The computed lists feed both
    results, so they are written to the checkpoint folder once.
    """
    shared_dir(requests.sparkSession)
    looked = read_cache(requests, cache, as_of, epochs)
    fresh = stored(expiring(missed_lists(looked.where(~F.col("hit")), index, **search), as_of), "fresh-lists")
    made = fresh.select(*KEY, F.col("items").alias("_made"))
    answers = looked.join(made, KEY, "left").select(
        *KEY, F.coalesce("items", "_made").alias("items"), F.col("hit").alias("cached")
    )
    return answers, write_back(cache, fresh)
