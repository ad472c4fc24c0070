"""Texts that contain given phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.text import tokenize
from eventweave.operators.scoring import settle
from eventweave.session import materialize

#: Tokens of a key.
WIDTH = 3


def _keys(tokens: Column, width: int) -> Column:
    """A hash of every ``width`` tokens in a row."""
    places = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.greatest(F.size(tokens) - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(width)]))


def _up_to(keys: Column, width: int, most: int) -> Column:
    return F.transform(F.filter(keys, lambda h: h <= most), lambda h: F.struct(F.lit(width).alias("n"), h.alias("key")))


def containing(docs: DataFrame, phrases: DataFrame, doc_id: str = "doc_id", text: str = "text", phrase_id: str = "item_id", phrase: str = "text") -> DataFrame:
    """(doc_id, phrase_id) of documents that contain a phrase verbatim.

    A phrase's key is the smallest hash of three tokens in a row in it, the first and the last token left out, since a verbatim copy may have joined those to its surroundings.
    Of a document only hashes up to the largest key of any phrase are looked up, and only where one is a key the texts are compared. Shorter phrases use fewer tokens; phrases of
    fewer than three tokens are refused, since they name nothing. Null texts contain nothing and null phrases are in nothing; repeated rows give a pair once."""
    toks = tokenize(F.col("__phrase"))
    named = settle(phrases.where(F.col(phrase).isNotNull()).select(F.col(phrase_id), F.col(phrase).alias("__phrase")), {"inner": F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))})
    width = F.least(F.lit(WIDTH), F.size("inner"))
    least = F.coalesce(*[F.when(width == w, F.array_min(_keys(F.col("inner"), w))) for w in range(1, WIDTH + 1)])
    keyed = materialize(named.select(phrase_id, "__phrase", width.alias("n"), least.alias("key")), "phrases")
    most = {r["n"]: r["m"] for r in keyed.groupBy("n").agg(F.max("key").alias("m")).collect()}  # a row for each width
    if 0 in most:
        raise ValueError("phrases need three tokens or more")
    rows = settle(docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text).alias("__text")), {"t": tokenize(F.col("__text"))})
    found = [_up_to(_keys(F.col("t"), w), w, m) for w, m in sorted(most.items())]
    hits = rows.select(doc_id, F.explode(F.flatten(F.array(*found)) if found else F.array().cast("array<struct<n:int,key:bigint>>")).alias("g")).select(doc_id, "g.n", "g.key")
    # stored, so that the planner knows how few pairs there are and leaves the texts where they are read
    pairs = materialize(hits.join(keyed, ["n", "key"]).select(doc_id, phrase_id, "__phrase").distinct(), "phrase-pairs")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text).alias("__text"))
    return texts.join(pairs, doc_id).where(F.contains("__text", "__phrase")).select(doc_id, phrase_id).distinct()
