"""Text, span, box and ontology functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventweave import ontology as o
from eventweave.functions import bbox, spans, text
from eventweave.operators import matching as m


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_cleaning(spark):
    row = one(spark, text.tokenize(F.lit("Obama's 17-year-old café_x, naïve.")), text.clean_text(F.lit(" a\t b \n c ")), text.content_tokens(F.lit("The the of U.N. talks")), text.clean_text(F.lit(None)))
    assert row[0] == ["Obama's", "17", "-", "year", "-", "old", "caf", "x", ",", "na", "ve", "."]
    assert row[1:] == ("a b c", ["the", "talks"], "")


def test_retrieval_text_previews_and_reasons(spark):
    row = one(spark, text.retrieval_text(text.text_part(F.lit(" a  b")), F.array(F.lit(""), F.lit("c"))), text.preview(F.lit("x" * 130)), text.skip_reason("unmapped_event_type", F.lit("Unknown:Event x")), text.skip_reason("missing_trigger"))
    assert row[0] == "a b c" and row[1] == "x" * 120 + "..." and row[2] == "unmapped_event_type:unknown:event_x" and row[3] == "missing_trigger"


def test_json_objects_in_answers(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('Sure: {"a": {"b": 2}} done',), ("none",), (None,)], "x string").select(text.json_object(F.col("x"))).collect()
    assert [r[0] for r in rows] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]


def test_recency(spark):
    values = ["2024-03-30", "2024-03-20T00:00:00Z", "2024-02-15 10:00:00", "2023-01-01", "2025-01-01", "soon", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "d string").select(text.recency_score(F.col("d"), F.lit("2024-03-31 00:00:00").cast("timestamp"))).collect()
    assert [r[0] for r in rows] == [1.0, 0.7, 0.3, 0.1, 1.0, 0.0, 0.0, 0.0]


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    a, b = box(0, 0, 10, 10), box(1, 1, 11, 11)
    row = one(spark, bbox.iou(a, b), bbox.iou(a, box(20, 20, 30, 30)), bbox.pixel_match(a, b), bbox.pixel_match(F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")), bbox.normalize_bbox(F.array(F.lit("1"), F.lit("2.5"), F.lit("3"), F.lit("x"))), bbox.normalize_bbox(F.array(F.lit("1"), F.lit("2.5"), F.lit("3"), F.lit("4"))))
    assert abs(row[0] - 81 / 119) < 1e-12 and row[1:4] == (0.0, True, True) and row[4] is None and row[5] == [1.0, 2.5, 3.0, 4.0]
    quality = [bbox.box_quality(box(*p), box(*g), 0.5, 0.1, 0.8, 0.6) for p, g in (((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 30, 30), (10, 10, 20, 20)), ((12, 12, 16, 16), (10, 10, 20, 20)), ((0, 0, 5, 5), (50, 50, 60, 60)))]
    assert tuple(one(spark, *quality)) == ("matched", "box_not_precise_enough_oversized", "box_not_precise_enough_undersized", "no_overlap")
    assert tuple(one(spark, bbox.box_quality(box(0, 0, 30, 30), box(10, 10, 20, 20)), bbox.box_quality(box(0, 0, 16, 16), box(0, 0, 10, 10)))) == ("weak_overlap", "box_not_precise_enough_oversized")
    names = one(spark, bbox.quality_bucket(F.lit("matched"), "fp"), bbox.quality_bucket(F.lit("weak_overlap"), "fn"), bbox.rescale(F.lit(12.0), F.lit(2.0), F.lit(4.0)))
    assert tuple(names) == ("image.fp_spurious_argument", "image.fn_weak_overlap_same_role", 2)


def test_ontology_names(spark):
    row = one(spark, o.canonical_type(F.lit("Justice:ArrestJail")), o.canonical_type(F.lit(" transaction transfermoney")), o.canonical_type(F.lit("Other")), o.canonical_role(F.lit("suspect")), o.canonical_role_for(F.lit("Contact:Meet"), F.lit("entity")), o.canonical_role_for(F.lit("Contact:Phone-Write"), F.lit("Entity")), o.visibility(F.lit("Life:Die"), F.lit("Victim")), o.visibility(F.lit("x"), F.lit("y")))
    assert tuple(row) == ("Justice:Arrest-Jail", "Transaction:Transfer-Money", "Other", "Person", "Participant", "Entity", "strong", "weak")
    weak = one(spark, o.is_weak_place_label(F.lit(" Street ")), o.is_weak_place_label(F.lit("market street")), o.mentions_weak_place(F.lit("Market Street")), o.mentions_weak_place(F.lit("")))
    assert tuple(weak) == (True, False, True, False)
    assert o.event_roles(spark).count() == 29


def test_preferred_boundaries(spark):
    cases = {"a man": (1, 2), "Two Chicago police officers": (3, 4), "President Barack Obama": (1, 3), "former President Barack Obama": (2, 4), "police officer John Smith": (2, 4), "the 17 men": (2, 3), "Barack Obama": (0, 2), "the": (0, 1), '" soldiers "': (1, 2), "officers": (0, 1), "Dr Ludwig van Beethoven": (1, 4), "the former coach": (2, 3), "police John Smith": (2, 3), "Mr . Smith": (2, 3), "General Police Officer Anna": (3, 4), "One Two": (0, 2), ", the": (0, 2), "Paris , France ,": (0, 3)}
    df = spark.createDataFrame([(k, k.split()) for k in cases], "k string, w array<string>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("w").alias("end")))
    got = {r.k: (r.s[0].start, r.s[0].end) for r in df.select("k", spans.preferred_spans(F.col("w"), whole).alias("s")).collect()}
    assert got == cases
    row = spark.sql("select split('a man saw President Barack Obama', ' ') as w").select(spans.preferred_spans(F.col("w"), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 2), (3, 6), (4, 9), (2, 2))])).alias("s")).first()
    assert [tuple(x) for x in row.s] == [(1, 2, True, False, False), (4, 6, False, False, True), (4, 9, False, False, False), (2, 2, False, False, False)]


def test_spans_in_text(spark):
    toks = F.array(*[F.lit(t) for t in "the man saw the man".split()])
    row = one(spark, m.phrase_starts(toks, F.array(F.lit("the"), F.lit("man"))), spans.unique_span(toks, F.lit("the man")), spans.unique_span(toks, F.lit("saw")), spans.span_matches(F.lit(3), F.lit(5), toks, F.lit("the man")), spans.span_matches(F.lit(3), F.lit(9), toks, F.lit("the man")))
    assert row[0] == [0, 3] and row[1] is None and tuple(row[2]) == (2, 3) and row[3:] == (True, False)
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    near = one(spark, m.choose_nearest(F.array(span(0, 2), span(3, 5)), F.array(span(2, 3))), m.choose_nearest(F.array(span(0, 1), span(3, 5)), F.array(span(4, 5))), m.choose_nearest(F.array(span(0, 2), span(3, 5)), none))
    assert near[0] is None and tuple(near[1]) == (3, 5) and near[2] is None
