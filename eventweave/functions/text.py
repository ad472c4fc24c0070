"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it; the same class in Java's and RE2's syntax.
WS = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
#: The characters of that class.
WS_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words with an optional apostrophe part, or single characters that are neither letters, digits, underscores nor white space.
TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[^\p{L}\p{N}_\p{Z}\x09-\x0d\x1c-\x1f\x85]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once and written once in the plan, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def truthy(col: Column) -> Column:
    """A value as trimmed text; null is the empty string."""
    return trim_ws(F.coalesce(col.cast("string"), F.lit("")))


def trim_ws(col: Column) -> Column:
    """Without white space at both ends; takes no pattern."""
    return F.btrim(col, F.lit(WS_CHARACTERS))


def clean_text(col: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return trim_ws(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), f"{WS}+", " "))


def tokenize(col: Column) -> Column:
    """Tokens in order, as written."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def token_sequence(text: Column, given: Column | None = None) -> Column:
    """Given tokens unless there are none, else tokens of the text."""
    own = tokenize(text)
    return own if given is None else F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(own)


def content_tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric ASCII tokens of three characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def overlap_share(reference: Column, candidate: Column) -> Column:
    """The share of reference's tokens that candidate holds; 0 if either is empty."""
    return F.when(F.size(reference) > 0, F.size(F.array_intersect(reference, candidate)) / F.greatest(F.size(reference), F.lit(1))).otherwise(F.lit(0.0))


def squeeze_key(col: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]", "")


def mapping_key(col: Column) -> Column:
    return F.lower(truthy(col))


def rewrite_query(col: Column, max_terms: int = 12) -> Column:
    """A search query: punctuation other than ``: / . -`` and runs of white space become spaces; the first terms."""
    plain = clean_text(F.regexp_replace(clean_text(col), r"[^\p{L}\p{N}_\p{Z}\x09-\x0d\x1c-\x1f\x85:/.\-]", " "))
    return F.array_join(F.slice(F.split(plain, " "), 1, max_terms), " ")


def preview(col: Column, limit: int = 120) -> Column:
    """Clean text, cut with dots beyond limit characters."""
    clean = clean_text(col)
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("..."))).otherwise(clean)


def skip_reason(reason: str, detail: Column | None = None) -> Column:
    """``reason`` or ``reason:detail`` in lower case with underscores for spaces."""
    if detail is None:
        return F.lit(reason)
    key = F.regexp_replace(F.lower(clean_text(detail)), " ", "_")
    return F.when(key == "", F.lit(reason)).otherwise(F.concat(F.lit(reason + ":"), key))


def retrieval_text(*parts: Column) -> Column:
    """Clean parts that aren't empty, joined by spaces; array parts are flattened one level."""
    flat = F.flatten(F.array(*parts))
    return F.array_join(F.filter(F.transform(flat, clean_text), lambda x: x != ""), " ")


def text_part(col: Column) -> Column:
    return F.array(col.cast("string"))


def json_object(col: Column) -> Column:
    """The JSON object in a model's answer: without code fences, else from the first brace to the last; null if there is none."""
    bare = trim_ws(F.regexp_replace(trim_ws(col), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(_is_object(bare), bare)
    return F.coalesce(whole, F.when(_is_object(inner), inner))


def _is_object(col: Column) -> Column:
    return col.startswith("{") & F.from_json(col, "map<string,string>").isNotNull()


def image_signal(col: Column) -> Column:
    """What follows ``Image:`` at the start of a line of a perception summary."""
    return trim_ws(F.regexp_extract(F.coalesce(col, F.lit("")), r"(?im)^image:[^\S\n]*(.*)$", 1))


def redact_reference(col: Column) -> Column:
    """An image reference that is safe to log: inline data is replaced by its kind."""
    return F.when(col.startswith("data:"), F.concat(F.regexp_extract(col, r"^(data:[^;,]*)", 1), F.lit(";<redacted>"))).otherwise(col)


def identity(col: Column) -> Column:
    """A stable identity of image bytes or of a reference."""
    return F.sha2(col.cast("binary"), 256)


def file_identity(path: Column, modified: Column, size: Column) -> Column:
    """An identity of a file that changes when it is written again: path, time of the last change and size."""
    return F.sha2(F.concat_ws("|", path, F.unix_micros(modified).cast("string"), size.cast("string")), 256)


def recency_score(published: Column, as_of: Column) -> Column:
    """1.0 up to 3 days of age, 0.7 up to 14, 0.3 up to 60, else 0.1; 0 without a readable date. Times without a zone are UTC; future ones have age 0."""
    value = truthy(published)
    zoned = F.regexp_replace(value, "Z$", "+00:00")
    formats = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm", "yyyyMMdd")
    parsed = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in formats])
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(parsed)) / F.lit(86_400_000_000.0))
    return F.when((value == "") | parsed.isNull(), 0.0).when(age <= 3, 1.0).when(age <= 14, 0.7).when(age <= 60, 0.3).otherwise(0.1)
