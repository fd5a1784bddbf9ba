"""From queries to candidate URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions.text import is_ascii
from ..functions.url import url_ext, url_host, url_looks_like_thumbnail
from ..runtime import global_rank


def expand_queries(base: DataFrame, variants: tuple[str, ...], filetypes: tuple[str, ...] = (), extras: tuple[str, ...] = ()) -> DataFrame:
    """(query, base_rank, variant) from base (base_rank, query): each query and, if ASCII, one for each suffix.

    Extras follow, with the base rank null. Of equal queries the first stays.
    """
    suffixes = [*variants, *filetypes]
    spelled = F.array(F.col("query"), *[F.concat_ws(" ", F.col("query"), F.lit(s)) for s in suffixes])
    own = F.when(is_ascii(F.col("query")), spelled).otherwise(F.array("query"))
    expanded = base.select("base_rank", F.posexplode(own).alias("variant", "query"))
    if extras:
        expanded = expanded.unionByName(base.sparkSession.createDataFrame([(None, i, q) for i, q in enumerate(extras)], expanded.schema))
    place = F.struct(F.col("base_rank").isNull().alias("late"), "base_rank", "variant")
    return expanded.groupBy("query").agg(F.min(place).alias("p")).select("query", "p.base_rank", "p.variant")


def top_results(hits: DataFrame, n: int, by: str = "query", rank: str = "result_rank") -> DataFrame:
    """The first n hits of each query; Spark trims groups before the shuffle."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(rank))).filter(F.col("_n") <= n).drop("_n")


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For each key the row that comes first; combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(key, "_first.*").select(*df.columns)


def not_recorded(df: DataFrame, ledger: DataFrame, key: str = "url") -> DataFrame:
    return df.join(ledger.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def discover(hits: DataFrame, ledger: DataFrame, config: CurationConfig) -> DataFrame:
    """(url, discovery_rank) of candidates, from hits (query_rank, query, result_rank, url).

    Hits without a URL or with another extension go; of equal URLs the first stays;
    recorded URLs go, and, where the settings ask for it, thumbnails and blocked
    hosts; then the first url_cap remain.
    """
    usable = top_results(hits.filter("url is not null and url <> ''"), config.max_results_per_query)
    usable = usable.filter(url_ext(F.col("url")).isin(*config.extensions)).select("url", "query_rank", "result_rank")
    if config.reject_thumbnails:
        usable = usable.filter(~url_looks_like_thumbnail(F.col("url")))
    if config.blocked_hosts:
        usable = usable.filter(~F.lower(url_host(F.col("url"))).isin(*[h.lower() for h in config.blocked_hosts]))
    fresh = not_recorded(first_of(usable, "url", ["query_rank", "result_rank"]), ledger)
    capped = fresh.orderBy("query_rank", "result_rank", "url").limit(config.url_cap)
    return global_rank(capped, [F.col("query_rank"), F.col("result_rank"), F.col("url")], "discovery_rank").select("url", "discovery_rank")


def discovery_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    return global_rank(df, order, "discovery_rank")
