"""Readers of JSON corpora, mappings, vectors and images."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventweave.operators.scoring import settle
from eventweave.session import scratch_path
from eventweave.sources import snapshots

Schema = StructType | str
_WRAPPERS = {"samples": ("samples", "data", "items"), "corpus": ("records", "data", "examples")}


def _row_type(schema: Schema) -> str:
    row = (schema if isinstance(schema, str) else schema.simpleString()).strip()
    return row if row.startswith("struct<") else f"struct<{', '.join(row.split(', '))}>"


def _blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The parser stops after a value, so the text is tried in brackets of two kinds: what closes one early breaks the other."""
    whole = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"a":', "}"))]
    return F.coalesce(whole[0] & whole[1], F.lit(False))


def _is_object(text: Column) -> Column:
    """Whether a text is one JSON object."""
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False)) & _is_json(text)


def read_jsonl(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One object a line. Blank lines and lines that hold another JSON value are dropped; a malformed line fails the read."""
    lines = spark.read.text(path).where(~_blank(F.col("value")))
    bad = ~_is_json(F.col("value"))
    sound = lines.where(F.when(bad, F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(_is_object(F.col("value"))))
    return sound.select(F.from_json("value", _row_type(schema)).alias("r")).select("r.*")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: Schema, limit: int | None = None) -> DataFrame:
    """Lines that hold an object; others, malformed ones too, are dropped. ``limit`` counts lines of the file, blank ones too."""
    lines = with_line_numbers(spark, path)
    rows = lines if limit is None else lines.where(F.col("_pos") < limit)
    return rows.where(_is_object(F.col("value"))).select(F.from_json("value", _row_type(schema)).alias("r"), "_pos").select("r.*", "_pos")


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value, _pos): lines with their 0-based numbers. Numbers continue over a file's splits: lines before a split are counted first."""
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = lines.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(F.broadcast(starts), "p").select("value", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("_pos"))


#: Why a line, an element or a file gives no record.
NOT_JSON, NOT_AN_OBJECT = "not JSON", "not an object"


def _numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, place, value): ``place`` orders the lines of a block, ``block`` (where it begins in the file) those of a file."""
    meta = F.col("_metadata")
    return spark.read.text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def line_files(spark: SparkSession, path: str) -> dict[str, bool]:
    """Each file below a path that has text, and whether it is one of JSON lines: by its name, or because its first line is an object and more follow.

    The names come to the driver, which lists them for every read."""
    lines = _numbered_lines(spark, path).where(~_blank(F.col("value")))
    each = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "place")).alias("first"), F.count("*").alias("n"))
    by_lines = F.lower("file").endswith(".jsonl") | ((F.col("n") > 1) & _is_object(F.col("first")))
    return {r.file: r.by_lines for r in each.select("file", by_lines.alias("by_lines")).collect()}


def _literal(file: str) -> str:
    """A file's name as a path without patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def _fault(value: Column) -> Column:
    return F.when(~_is_json(value), NOT_JSON).when(~_is_object(value), NOT_AN_OBJECT)


_PARSED = "file string, block bigint, place bigint, item int, value string, fault string"


def parsed_records(spark: SparkSession, path: str, kind: str = "samples", fall_back: bool = True) -> DataFrame:
    """(file, block, place, item, value, fault): every line of files of JSON lines (blank ones with a null value), and every element of files that are one JSON value, with what is wrong with it.

    Each file is read by its own format. Files of lines are split like any text. Other files are an array, an object that wraps one (``samples``: under samples, data or items;
    ``corpus``: under records, data or examples), or one record. ``item`` numbers elements from 1, and is 0 where the file as a whole is no JSON. Corpora that are not one JSON value are read by lines too, and ``item`` is then the line;
    so are, with ``fall_back`` alone, lines in a file that isn't named ``.jsonl``."""
    found = line_files(spark, path)
    named = {f for f in found if f.lower().endswith(".jsonl")}
    lines = sorted(f for f, by_lines in found.items() if by_lines and (f in named or kind == "corpus" and fall_back))
    others = sorted(set(found) - set(lines))
    out = spark.createDataFrame([], _PARSED)
    if lines:
        rows = _numbered_lines(spark, [_literal(f) for f in lines])
        blank = _blank(F.col("value"))
        out = out.unionByName(rows.select("file", "block", "place", F.lit(None).cast("int").alias("item"), F.when(~blank, F.col("value")).alias("value"), F.when(~blank, _fault(F.col("value"))).alias("fault")))
    if others:
        whole = spark.read.text([_literal(f) for f in others], wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        text, fields = F.col("text"), F.col("fields")
        # what is said of a whole file is settled before its elements are listed: beside the list it would be worked out anew for each of them
        whole = settle(whole, {"broken": ~_is_json(text), "fields": F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>"))})
        array = F.coalesce(*[F.when(F.try_element_at(fields, F.lit(key)).rlike(r"^\s*\["), F.try_element_at(fields, F.lit(key))) for key in _WRAPPERS[kind]])
        whole = settle(whole, {"array": F.when(text.rlike(r"^\s*\["), text).otherwise(array)})
        # an element that is no string is its JSON text
        sound = F.when(F.col("array").isNotNull(), F.from_json("array", "array<string>")).otherwise(F.array(text))
        by_line = F.split(text, "\n") if kind == "corpus" and fall_back else F.array(text)
        items = whole.select("file", "broken", F.posexplode(F.when(F.col("broken"), by_line).otherwise(sound)).alias("at", "value"))
        first = 1 if kind == "corpus" and fall_back else 0
        fault = F.when(F.col("broken"), _fault(F.col("value")) if first else F.lit(NOT_JSON)).otherwise(F.when(~_is_object(F.col("value")), NOT_AN_OBJECT))
        kept = items.where(~F.col("broken") | ~_blank(F.coalesce("value", F.lit(""))))
        none = F.lit(None).cast("bigint")
        out = out.unionByName(kept.select("file", none.alias("block"), none.alias("place"), (F.col("at") + F.when(F.col("broken"), first).otherwise(1)).alias("item"), "value", fault.alias("fault")))
    return out


def read_json_documents(spark: SparkSession, path: str, schema: Schema, kind: str = "samples", fall_back: bool = True) -> DataFrame:
    """Records of JSON files, each file by its own format as in parsed_records(). Elements that are no objects are dropped.

    A malformed line fails the read, and a file that is neither JSON nor may be read by lines is an error. A ``.jsonl`` path is read by lines."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    parsed, value = parsed_records(spark, path, kind, fall_back), F.col("value")
    if not (kind == "corpus" and fall_back) and (bad := parsed.where(F.col("fault") == NOT_JSON).select("file").first()):
        raise ValueError(f"{bad['file']} is not JSON")
    failed = F.raise_error(F.concat(F.lit("not JSON: "), F.substring(value, 1, 80))).cast("boolean")
    sound = parsed.where(F.when(F.col("fault") == NOT_JSON, failed).otherwise(value.isNotNull() & F.col("fault").isNull()))
    return sound.select(F.from_json(value, _row_type(schema)).alias("r")).select("r.*")


def read_with_quarantine(spark: SparkSession, path: str, schema: Schema, kind: str = "samples", fall_back: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, bad): what parsed_records() finds, split in one pass over the files. ``bad`` is (file, line, reason, value) for write_quarantine().

    ``line`` counts lines from 1 in files of lines, blank ones too, and elements elsewhere; it is 0 for a file that is no JSON at all. The pass is stored in the shared folder, sound
    and bad rows apart, so neither side reads the other's."""
    root = scratch_path(spark, "parsed")
    parsed = parsed_records(spark, path, kind, fall_back)
    parsed.withColumn("bad", F.col("fault").isNotNull()).write.partitionBy("bad").parquet(root)
    stored = spark.read.schema(f"{_PARSED}, bad boolean").parquet(root)
    records = stored.where("not bad and value is not null").select(F.from_json("value", _row_type(schema)).alias("r")).select("r.*")
    # lines before a block: the sizes of the file's blocks before it; a task may hold several blocks, one after the other
    blocks = stored.where("block is not null").groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("from"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    line = F.coalesce(F.col("item").cast("bigint"), F.col("start") + F.col("place") - F.col("from") + 1)
    bad = stored.where("bad").join(starts, ["file", "block"], "left").select("file", line.alias("line"), F.col("fault").alias("reason"), "value")
    return records, bad


def read_keyed_objects(spark: SparkSession, path: str, record: str, key: str = "image_id") -> DataFrame:
    """Rows of a file that is one object ``{key: record}``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias(key, "r")).select(key, "r.*")


def read_mapping(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, raw_type, event_type) and (dataset, event_type, raw_role, role) of an ontology mapping file; keys in lower case, empty pairs dropped.
    Of keys that differ in case only the last counts."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    if not rows:
        raise ValueError(f"no mapping for {dataset}")
    spec = json.loads(rows[0][0])
    clean = lambda pairs: {k.strip().lower(): str(v).strip() for k, v in (pairs or {}).items() if k.strip() and str(v or "").strip()}.items()
    types = [(dataset, k, v) for k, v in clean(spec.get("event_type_map"))]
    roles = [(dataset, t.strip(), k, v) for t, pairs in (spec.get("role_map") or {}).items() for k, v in clean(pairs)]
    return spark.createDataFrame(types, "dataset string, raw_type string, event_type string"), spark.createDataFrame(roles, "dataset string, event_type string, raw_role string, role string")


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """Vector shards as one table; an error if all are empty."""
    out = spark.read.parquet(*paths)
    if out.isEmpty():
        raise ValueError("all shards are empty")
    return out


def existing_indexes(spark: SparkSession, roots: dict[str, str]) -> dict[str, DataFrame]:
    """The saved indexes that exist, by name; others are left out."""
    return {name: load_index(spark, root) for name, root in roots.items() if snapshots.numbers(spark, root)}


def index_name(path: str) -> str:
    """The name of the index that a corpus file is for."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    # Corpora and their indexes.
    return {"ace2005.text": "ace_text", "maven_arg.text": "maven_text", "swig.text": "swig_text", "bridge": "bridge"}.get(stem, stem.replace(".", "_"))


def read_manifest(spark: SparkSession, root: str) -> dict:
    """A saved index's newest manifest."""
    _, manifest = snapshots.latest(spark, root)
    if manifest is None:
        raise ValueError(f"{root} is no index")
    return manifest


def load_index(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A saved index, or an earlier snapshot of it that is still there; an error unless its rows are as many as its manifest says."""
    manifest = read_manifest(spark, root) if number is None else snapshots.read(spark, root, number)
    vectors = spark.read.parquet(*[f"{root}/{part}" for part in manifest["parts"]])
    if (n := vectors.count()) != manifest["record_count"]:
        raise ValueError(f"{root}: {n} rows, {manifest['record_count']} in the manifest")
    return vectors


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, mime) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", mime_of_path(F.col("path")).alias("mime"))


def mime_of_path(path: Column) -> Column:
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind == "", "application/octet-stream").otherwise(F.concat(F.lit("image/"), kind))


def inline_image(reference: Column) -> Column:
    """Bytes of a ``data:`` URL column; null for other references."""
    return F.when(reference.startswith("data:") & reference.contains(";base64,"), F.unbase64(F.substring_index(reference, ";base64,", -1)))


def inline_mime(reference: Column) -> Column:
    """The kind that a ``data:`` URL names; null for other references."""
    return F.when(reference.startswith("data:"), F.coalesce(F.nullif(F.regexp_extract(reference, r"^data:([^;,]*)", 1), F.lit("")), F.lit("text/plain")))


def with_image_bytes(rows: DataFrame, reference: str, files: DataFrame | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """rows with ``content`` and ``mime`` of their references: inline data, files from read_images(), or what a provider has fetched, as
    (reference, content, mime). Null where a reference is none of these."""
    ref = F.col(reference)
    out = rows.withColumns({"content": inline_image(ref), "mime": F.when(inline_image(ref).isNotNull(), inline_mime(ref))})
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    for known, key in ((files, "path"), (fetched, "reference")):
        if known is not None:
            own = known.select(plain(F.col(key)).alias("__key"), F.col("content").alias("__content"), F.col("mime").alias("__mime"))
            out = out.join(own, plain(ref) == F.col("__key"), "left")
            out = out.withColumns({"content": F.coalesce("content", "__content"), "mime": F.coalesce("mime", "__mime")}).drop("__key", "__content", "__mime")
    return out


def read_situations(spark: SparkSession, path: str) -> DataFrame:
    """(image, verb, frame_length, roles) of a file of annotations by image, ``{image: {verb, frames, bb}}``: the roles of the first frame with their first noun, and whether any has a box.

    The image is named without its ending, ``frame_length`` is one less than the frame's roles, and a box that begins with -1 is none."""
    rows = read_keyed_objects(spark, path, "verb: string, frames: array<map<string,string>>, bb: map<string,array<double>>", "image")
    frame = F.coalesce(F.try_element_at("frames", F.lit(1)), F.create_map().cast("map<string,string>"))
    left = lambda role: F.try_element_at(F.try_element_at("bb", role), F.lit(1))
    roles = F.transform(F.array_sort(F.map_keys(frame)), lambda r: F.struct(r.alias("role"), F.try_element_at(frame, r).alias("noun"), F.coalesce(left(r) != -1, F.lit(False)).alias("boxed")))
    return rows.select(F.substring_index("image", ".", 1).alias("image"), "verb", (F.size(frame) - 1).alias("frame_length"), roles.alias("roles"))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, index) of a class list in CSV."""
    return spark.read.schema("name string, index int").csv(path)


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """(image) of a list with a file name a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("image")).where("image != ''")


def read_npy_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row, embedding) of ``.npy`` files with one matrix each; empty ones give no rows, other shapes are an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                if matrix.ndim != 2:
                    raise ValueError(f"{name} holds no matrix")
                for k in range(0, len(matrix), 4096):
                    part = matrix[k : k + 4096].astype(np.float32)
                    yield pd.DataFrame({"shard": name, "row": np.arange(k, k + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(rows, "shard string, row long, embedding array<float>")


def read_embedding_shards(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Vectors of ``NAME.emb.npy`` files with the metadata lines of ``NAME.meta.jsonl`` beside them, row by row: the columns of schema, ``shard``, ``row`` and
    ``embedding``. Shards without rows are skipped; an error if a shard's vectors and lines differ in number, or if there are no vectors at all."""
    vectors = read_npy_shards(spark, path).withColumn("shard", F.regexp_replace("shard", r"\.emb\.npy$", ""))
    texts = spark.read.option("pathGlobFilter", "*.meta.jsonl").text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"\.meta\.jsonl$", "").alias("s"), "value")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "file:/")
    lines = texts.select(plain("s").alias("shard"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    vectors = vectors.withColumn("shard", plain("shard"))
    sizes = [x.groupBy("shard").agg(F.count("*").alias(n)) for x, n in ((vectors, "vectors"), (lines, "lines"))]
    both = sizes[0].join(sizes[1], "shard", "full").fillna(0)
    if wrong := both.where("vectors != lines").first():
        raise ValueError(f"{wrong['shard']}: {wrong['vectors']} vectors, {wrong['lines']} lines of metadata")
    if both.isEmpty():
        raise ValueError("all shards are empty")
    meta = lines.select("shard", F.col("row").cast("long").alias("row"), F.from_json("line", _row_type(schema)).alias("r"))
    return vectors.join(meta, ["shard", "row"]).select("r.*", "shard", "row", "embedding")
