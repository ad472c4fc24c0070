"""Evidence validation and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweave.functions.text import content_tokens, overlap_share, recency_score, truthy
from eventweave.operators.scoring import settle

# Weights of the ranking score.
QUERY, SOURCE, TITLE, SCORE, RECENCY = 0.35, 0.25, 0.15, 0.15, 0.10


def valid_evidence(items: DataFrame) -> DataFrame:
    """Rows with a title, a snippet, a url and a source type, trimmed; scores within 0 and 1, 0 where there is none. A score that is no number is invalid."""
    clean = items.withColumns({c: truthy(F.col(c)) for c in ("title", "snippet", "url", "source_type")})
    if "published_at" in items.columns:
        clean = clean.withColumn("published_at", F.nullif(truthy(F.col("published_at")), F.lit("")))
    given = F.coalesce(F.col("score").cast("string"), F.lit("0")) if "score" in items.columns else F.lit("0")
    score = given.try_cast("double")
    return clean.withColumn("score", F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))).where("url != '' and title != '' and snippet != '' and source_type != '' and score is not null")


def search_hits(responses: DataFrame, response: str = "response") -> DataFrame:
    """Valid evidence items, one a row with its place ``_pos``, of the JSON answers of a news search; an answer that can't be read gives none.

    The snippet is a result's ``content`` or else its ``snippet``; the date its ``published_date`` or else its ``published_at``."""
    kinds = "results array<struct<title:string,content:string,snippet:string,url:string,published_date:string,published_at:string,score:string>>"
    other = [c for c in responses.columns if c != response]
    rows = responses.select(*other, F.posexplode(F.from_json(response, kinds)["results"]).alias("_pos", "r")).where("r is not null")
    either = lambda a, b: F.coalesce(F.nullif(truthy(F.col(f"r.{a}")), F.lit("")), F.nullif(truthy(F.col(f"r.{b}")), F.lit("")))
    items = rows.select(*other, "_pos", "r.title", either("content", "snippet").alias("snippet"), "r.url", F.lit("search").alias("source_type"), either("published_date", "published_at").alias("published_at"), "r.score")
    return valid_evidence(items)


def rank_score(query: Column, source: Column, title: Column, both: Column, score: Column, recency: Column) -> Column:
    """The weighted sum for tokens of a query, its source, an item's title, and its title and snippet together."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    return QUERY * overlap_share(query, both) + SOURCE * overlap_share(source, both) + TITLE * overlap_share(query, title) + SCORE * clamped + RECENCY * recency


def rerank(items: DataFrame, as_of: Column, min_relevance: float = 0.18, k: int = 2, by: str = "query_id") -> DataFrame:
    """Items (query_id, query, source, title, snippet, score, published_at, _pos) that share a token with the query or source and reach the
    threshold: the k best of each query by rank score, then by score, then by position."""
    q, s, ti, both = (F.col(f"__{c}") for c in ("query", "source", "title", "both"))
    tokens = {f"__{c}": content_tokens(F.col(c)) for c in ("query", "source", "title", "snippet")}
    rows = settle(settle(items, tokens), {"__both": F.array_union("__title", "__snippet")})
    near = F.arrays_overlap(q, both) | F.arrays_overlap(s, both)
    made = F.when(near, rank_score(q, s, ti, both, F.col("score"), recency_score(F.col("published_at"), as_of)))
    scored = settle(rows, {"rank_score": made}).where(F.col("rank_score") >= min_relevance)
    order = Window.partitionBy(by).orderBy(F.desc("rank_score"), F.desc("score"), "_pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop(*tokens, "__both")


def has_external_support(event_surface: Column, evidence: Column) -> Column:
    """Whether any evidence item (title, snippet) shares a token with the event's words."""
    own = content_tokens(event_surface)
    return F.exists(F.coalesce(evidence, F.array().cast("array<struct<title:string,snippet:string>>")), lambda e: F.arrays_overlap(own, F.array_union(content_tokens(e["title"]), content_tokens(e["snippet"]))))


def open_search_only(evidence: Column, run_mode: Column, enabled: Column) -> Column:
    """Evidence only in open-world runs with search on, so that benchmark answers can't leak in."""
    return F.when((run_mode == "open_world") & enabled, evidence)
