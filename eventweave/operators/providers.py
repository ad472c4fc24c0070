"""Models as providers: functions from batches of rows to batches of rows, outside the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from eventweave.functions.text import identity, json_object, truthy
from eventweave.ontology import is_supported
from eventweave.operators import evidence, records, verify
from eventweave.session import materialize

Stage = Callable[[DataFrame], DataFrame]


class Provider(Protocol):
    """A model. ``open`` runs once a task; ``apply`` maps a batch to one with the columns of ``schema``."""

    schema: str

    def open(self) -> None: ...

    def apply(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def run_provider(rows: DataFrame, provider: Provider, batch_rows: int = 8, fallback: Callable[[pd.DataFrame, Exception], pd.DataFrame] | None = None) -> DataFrame:
    """rows through a provider in batches of batch_rows. Filter before, since nothing is pushed through. With ``fallback``, a failed batch becomes its result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for batch in batches:
            for k in range(0, len(batch), batch_rows):
                part = batch.iloc[k : k + batch_rows]
                try:
                    yield provider.apply(part)
                except Exception as error:
                    if fallback is None:
                        raise
                    yield fallback(part, error)

    return rows.mapInPandas(run, provider.schema)


def verify_and_repair(events: DataFrame, verify: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """events through verify (adds ``verified``) and, as long as a row isn't verified, repair, at most ``attempts`` times.

    Every round is stored before the next reads it, so a model sees a row once a round; verified rows aren't touched again."""
    columns = events.columns
    out, open_rows = None, events
    for n in range(attempts + 1):
        checked = materialize(verify(open_rows.select(*columns)).withColumn("repair_attempts", F.lit(n)), f"round-{n}")
        done = checked if n == attempts else checked.where("verified")
        out = done if out is None else out.unionByName(done)
        open_rows = checked.where("not verified")
        if n == attempts or open_rows.isEmpty():
            return out
        open_rows = repair(open_rows)
    return out


def encode(rows: DataFrame, encoder: Callable[[list], np.ndarray], column: str, dims: int | None = None, batch_rows: int = 8) -> DataFrame:
    """rows with ``embedding``, unit vectors of a text column or of image paths by an encoder, batch by batch; ``dims`` cuts them before they are normalised.

    It is an error if an encoder doesn't give a finite matrix with a row for each input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), batch_rows):
                part = batch.iloc[k : k + batch_rows].copy()
                found = np.asarray(encoder(part[column].tolist()), np.float32)
                if found.ndim != 2 or len(found) != len(part) or not np.isfinite(found).all():
                    raise ValueError(f"an encoder gave {found.shape} for {len(part)} rows")
                found = found[:, :dims] if dims else found
                norm = np.linalg.norm(found, axis=1, keepdims=True)
                part["embedding"] = list(found / np.where(norm == 0, 1, norm))
                yield part

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def ask(rows: DataFrame, post: Callable[[dict], str | None] | None, fields: list[str], out: str = "response", tries: int = 1, error: str | None = None) -> DataFrame:
    """rows with a service's answer to their fields as text; null where it fails, gives none, or there is no service.

    A request that fails is sent ``tries`` times; ``error`` names a column for what the last one failed with. Services with a rate, and requests that repeat, are for sources.fetching."""
    if post is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in (out, error) if c})

    def one(values: dict) -> tuple[str | None, str | None]:
        failed = None
        for _ in range(tries):
            try:
                return post(values), None
            except Exception as e:
                failed = f"{type(e).__name__}: {e}"
        return None, failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [one(values) for values in batch[fields].to_dict("records")]
            yield batch.assign(**{c: pd.Series([a[k] for a in answers], batch.index, dtype=object) for k, c in enumerate((out, error)) if c})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *[StructField(c, StringType()) for c in (out, error) if c]]))


def search_evidence(queries: DataFrame, post: Callable[[dict], str | None] | None, query: str = "query") -> DataFrame:
    """Valid evidence items of a news search for each query; empty queries and failed ones have none, nor has any without a service."""
    asked = ask(queries.where(F.trim(F.coalesce(F.col(query), F.lit(""))) != ""), post, [query])
    return evidence.search_hits(asked)


def ground(rows: DataFrame, post: Callable[[dict], str | None] | None, image: str = "raw_image", requests: str = "requests") -> DataFrame:
    """rows with ``grounding_results`` of a detector's service, one for each request; all have failed where the service has."""
    sent = ask(rows.withColumn("__sent", F.to_json(requests)), post, [image, "__sent"], "__response")
    return sent.withColumn("grounding_results", verify.grounding_results(F.col("__response"), F.col(requests))).drop("__sent", "__response")


def perceive(rows: DataFrame, post: Callable[[dict], str | None] | None, known: DataFrame | None = None, image: str = "raw_image", text: str = "text") -> DataFrame:
    """rows with ``perception`` {image_desc, perception_summary} by a vision model. Images and texts in ``known`` (key, answer), what earlier runs were answered, aren't asked again;
    ``key`` and ``answer`` are columns of the result, to be kept for later ones. Without a service descriptions stay as they are."""
    keyed = rows.withColumn("key", identity(F.concat_ws("|", F.col(image).cast("string"), F.col(text))))
    if known is None:
        out = ask(keyed, post, [image, text], "answer")
    else:
        found = keyed.join(known.select("key", F.col("answer")).dropDuplicates(["key"]), "key", "left")
        fresh = ask(found.where("answer is null").drop("answer"), post, [image, text], "answer")
        out = found.where("answer is not null").unionByName(fresh)
    desc = F.col("image_desc") if "image_desc" in rows.columns else F.lit("")
    return out.withColumn("perception", records.perception_record(F.col("answer"), desc, F.col(text)))


_STAGE_B = "trigger struct<text:string,modality:string,span:struct<start:int,end:int>>, text_arguments array<struct<role:string,text:string,span:struct<start:int,end:int>>>"
_STAGE_C = "image_arguments array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>"


def extract(states: DataFrame, select: Stage, read: Stage, look: Stage, mode: str = "closed_set", image_evidence: str | None = None) -> DataFrame:
    """states through three model stages that each add ``answer``, text with a JSON object: an event type; trigger and text arguments; image arguments.

    A type that the ontology lacks is ``Unsupported`` in mode ``transfer`` and an ``error`` otherwise; such rows go no further and have an empty event. Image arguments
    come without boxes, unresolved, weak places of arrests left out, and only where the column ``image_evidence`` is true. Each stage's rows are stored."""
    columns = states.columns
    kind = truthy(F.from_json(json_object(F.col("answer")), "event_type string")["event_type"])
    typed = materialize(select(states).withColumn("__type", kind).drop("answer"), "stage-a")
    known = F.coalesce(is_supported(F.col("__type")), F.lit(False))
    texts = F.from_json(json_object(F.col("answer")), _STAGE_B)
    done = materialize(read(typed.where(known).withColumnRenamed("__type", "event_type")).withColumn("__b", texts).drop("answer"), "stage-b")
    done = done.select(*columns, "event_type", "__b.trigger", F.coalesce("__b.text_arguments", F.array()).alias("text_arguments"))
    seen = F.coalesce(F.col(image_evidence), F.lit(False)) if image_evidence else F.lit(True)
    images = F.coalesce(F.from_json(json_object(F.col("answer")), _STAGE_C)["image_arguments"], F.array())
    open_ = F.transform(images, lambda a: a.withField("bbox", F.lit(None).cast("array<double>")).withField("grounding_status", F.lit("unresolved")))
    looked = materialize(look(done).withColumn("image_arguments", F.when(seen, open_).otherwise(F.slice(open_, 1, 0))).drop("answer"), "stage-c")
    full = verify.drop_weak_places(looked).withColumn("error", F.lit(None).cast("string"))
    rest = typed.where(~known).select(
        *columns, F.lit("Unsupported" if mode == "transfer" else "").alias("event_type"), *[F.lit(None).cast(full.schema[c].dataType).alias(c) for c in ("trigger",)],
        *[F.array().cast(full.schema[c].dataType).alias(c) for c in ("text_arguments", "image_arguments")],
        (F.lit(None).cast("string") if mode == "transfer" else F.concat(F.lit("unsupported event_type: "), F.col("__type"))).alias("error"),
    )
    return full.unionByName(rest)
