"""Cross-site boilerplate lines by distinct-site spread.

HyperLogLog sketches of the sites of every line hash are merged by aggregation. Estimates well above the threshold count as boilerplate and
estimates well below as not; lines between get an exact count of distinct sites. All of it is
DataFrame code: sketches, counts, joins and the rebuilding of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.llm.scratch import discard, materialize

#: log2 of a sketch's registers: a relative error of 1.04 / 64 = 1.6 %.
LG_REGISTERS = 12
#: Estimates this near the threshold, relative to it, are counted exactly: five standard errors.
MARGIN = 0.0825


def line_hash(line: F.Column) -> F.Column:
    """128 bits of a line without white space (U+0020) at its ends, as a struct."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(trimmed, F.lit(1)).alias("h2"))


def split_lines(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2), stored, of lines on at least min_sites sites, from rows (h1, h2, site). Rows without a site count for no site."""
    sited = lines.where(F.col("site").isNotNull())
    sketches = sited.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch"), F.count("*").alias("n"))
    # a line on fewer rows than min_sites is on fewer sites
    spread = sketches.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - MARGIN) - 1), "line-spread")
    clear = F.col("sites") > min_sites * (1 + MARGIN) + 1
    near = spread.where(~clear).select("h1", "h2")
    exact = sited.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    out = materialize(spread.where(clear).select("h1", "h2").unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")
    discard(spread)
    return out


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", spare: str = "copies") -> DataFrame:
    """docs with ``text`` rid of boilerplate lines, and ``n_lines`` and ``n_removed``.

    A line (its text up to line feeds, without spaces at its ends) is boilerplate when it stands in documents of at least min_sites distinct sites;
    blank lines never are. ``spare`` says which documents are left whole all the same. "copies": those whose lines, but for blank ones, are all boilerplate and whose whole text another
    document has too (another id, or another row without an id), so that deduplication still sees them. "none": no document. Null texts stay null with no
    lines; rows with a null id or site are treated like others, though a null site adds to no line's spread. Repeated rows get equal results. A very long text is
    rebuilt in proportion to its lines; an empty table gives no rows. Columns named like the new ones are replaced, others may have any name.
    """
    if spare not in ("copies", "none"):
        raise ValueError(f"spare must be 'copies' or 'none', not {spare!r}")
    text, lines = docs[text_col].cast("string"), split_lines(docs[text_col].cast("string"))
    # all that is decided about a row follows from its text, so rows are known by their id and text hashes
    keys = [docs[id_col].cast("string").alias("k0"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]
    exploded = docs.where(text.isNotNull()).select(*keys, docs[site_col].cast("string").alias("site"), F.posexplode(F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), (F.trim(x) != "").alias("full"), F.length(x).alias("size")))).alias("pos", "line"))
    rows = exploded.where("line.full").select("k0", "k1", "k2", "site", F.struct("pos", "line.size").alias("place"), F.col("line.h.h1").alias("h1"), F.col("line.h.h2").alias("h2"))
    found = boilerplate_lines(rows.select("h1", "h2", "site"), min_sites)
    hits = rows.join(found, ["h1", "h2"], "left_semi").groupBy("k0", "k1", "k2").agg(F.collect_set("place").alias("removed"), F.count("*").alias("n"))
    if spare == "copies":
        # rows without an id share a group here but are documents of their own
        hits = materialize(hits.withColumn("n", F.when(F.col("k0").isNull(), F.expr("n div size(removed)")).otherwise(1)), "boilerplate-hits")
        hits = with_copied(hits)
    else:
        hits = hits.withColumn("copied", F.lit(None).cast("boolean"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = lambda c: F.col(f"d.row.`{c}`")
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *keys).alias("d")
    on = F.col("d.k0").eqNullSafe(F.col("h.k0")) & (F.col("d.k1") == F.col("h.k1")) & (F.col("d.k2") == F.col("h.k2"))
    joined = keyed.join(hits.alias("h"), on, "left")
    whole_text, removed = row(text_col).cast("string"), F.col("h.removed")
    split = split_lines(whole_text)
    whole = F.coalesce("h.copied", F.lit(False)) & (F.size(removed) == F.size(F.filter(split, lambda x: F.trim(x) != "")))
    act = removed.isNotNull() & ~whole
    # what is left are the runs of lines between removed ones, so the work is in proportion to the lines
    cuts = F.array_sort(F.transform(removed, lambda p: p["pos"]))
    ends, begins = F.concat(cuts, F.array(F.size(split))), F.concat(F.array(F.lit(-1)), cuts)
    runs = F.zip_with(begins, ends, lambda a, b: F.slice(split, a + 2, b - a - 1))
    kept = F.array_join(F.flatten(runs), "\n")
    return joined.select(
        *[F.when(act, kept).otherwise(whole_text).alias(c) if c == text_col else row(c).alias(c) for c in names],
        F.when(whole_text.isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.when(act, F.size(removed)).otherwise(0).alias("n_removed"),
    )


def with_copied(hits: DataFrame) -> DataFrame:
    """Stored rows (k1, k2, n, ...) with ``copied``: whether the n of all rows of their text are more than one.

    A text with more than a thousandth of the rows is looked up by broadcast, since its rows would meet in one task; there are a thousand such texts at most."""
    texts = hits.groupBy("k1", "k2").agg(F.sum("n").alias("documents"), F.count("*").alias("rows")).where("documents > 1")
    many = F.col("rows") > max(64, hits.count() // 1000)
    hot = F.broadcast(texts.where(many).select("k1", "k2", F.lit(True).alias("hot")))
    marked = hits.join(hot, ["k1", "k2"], "left")
    rest = marked.where("hot is null").drop("hot").join(texts.where(~many).select("k1", "k2", F.lit(True).alias("copied")), ["k1", "k2"], "left")
    return rest.unionByName(marked.where("hot").withColumnRenamed("hot", "copied"))
