"""Paths and rules that contract trees report, on plain documents."""

from pyspark.sql import functions as F

from trueframe.operators import contract as k
from trueframe.plans import contract as plan

TREE = k.Struct({"name": k.FILLED, "parts": k.Items(k.Struct({"n": k.COUNT, "tags": k.Optional(k.TEXTS)}), least=1, most=2),
                 "link": k.Optional(k.URL), "share": k.FINITE})
SCHEMA = "id int, d struct<name:string,parts:array<struct<n:double,tags:array<string>>>,link:string,share:double>"


def broken(spark, doc):
    rows = k.validate_document(spark.createDataFrame([(1, doc)], SCHEMA), "id", "d", TREE).collect()
    return sorted((r.path, r.rule) for r in rows)


def test_paths_of_violations(spark):
    good = ("a", [(1.0, ["x"]), (0.0, None)], "HTTPS://a/b", 0.5)
    assert broken(spark, good) == []
    assert broken(spark, ("", [(1.5, [None, "y"]), (-1.0, [])], "ftp://a", float("inf"))) == [
        ("result.link", "format"), ("result.name", "length"), ("result.parts[0].n", "count"), ("result.parts[0].tags[0]", "missing"),
        ("result.parts[1].n", "count"), ("result.share", "finite")]
    assert broken(spark, (None, None, None, None)) == [("result.name", "length"), ("result.parts", "missing"), ("result.share", "finite")]
    assert broken(spark, ("a", [], None, float("nan"))) == [("result.parts", "size"), ("result.share", "finite")]
    assert broken(spark, ("a", [(1.0, None)] * 3, None, 1.0)) == [("result.parts", "size")]
    assert broken(spark, ("a", [None], None, 1.0)) == [("result.parts[0]", "missing")]
    assert broken(spark, None) == [("result", "missing")]


def test_every_value_of_the_contract_is_listed_once():
    assert [(p, v.rule) for p, v in sorted(plan.leaves(k.RESULT), key=lambda x: x[0])] == sorted(plan.RULES.items())


def test_absent_optional_parts_break_nothing(spark):
    whole = plan.document(k.RESULT, F.lit(-1), plan.NUMBERS)
    gaps = ["specialist_evidence", "youtube", "media_receipt", "social_context"]
    kinds = {f.name: f.dataType for f in spark.range(1).select(whole.alias("d")).schema["d"].dataType.fields}
    less = whole
    for name in gaps:
        less = less.withField(name, F.lit(None).cast(kinds[name]))
    docs = spark.range(1).select("id", less.alias("d"))
    assert k.validate_document(docs, "id", "d").count() == 0
    assert [tuple(r) for r in k.validate_document(docs.select("id", F.col("d").withField(
        "adjustments", F.lit(None).cast(kinds["adjustments"])).alias("d")), "id", "d").collect()] == [(0, "result.adjustments", "missing")]
