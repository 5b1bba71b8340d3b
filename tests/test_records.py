"""Hand-worked cases for record parsing and cleaning."""

from pyspark.sql import functions as F

from graphloom.functions.text import clean_field, joined_text
from graphloom.operators import records as r

SAMPLE = """entity<|#|>World Athletics Championship<|#|>event<|#|>A global sports competition in track and field.
entity<|#|>Tokyo<|#|>location<|#|>The host city of the championship.
entity<|#|>Noah Carter<|#|>person<|#|>A sprinter who set a new record.
entity<|#|>100m Sprint Record<|#|>metric<|#|>A benchmark recently broken.
entity<|#|>Carbon-Fiber Spikes<|#|>equipment<|#|>Advanced sprinting shoes.
relation<|#|>World Athletics Championship<|#|>Tokyo<|#|>event location<|#|>It is hosted there.
relation<|#|>Noah Carter<|#|>100m Sprint Record<|#|>record-breaking<|#|>He set it.
relation<|#|>A<|#|>B<|#|>too few fields
relation<|#|>A<|#|>A<|#|>self<|#|>loop
<|COMPLETE|>"""


def output(spark, *texts):
    return spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, ord int, result string")


def test_parsing(spark):
    out = output(spark, SAMPLE)
    ents = r.parse_entities(out).orderBy("line_no").collect()
    assert [e["entity_type"] for e in ents] == ["event", "location", "person", "metric", "equipment"]
    assert {e["confidence"] for e in ents} == {3}
    rels = r.parse_relationships(out).collect()
    assert len(rels) == 2 and {x["weight"] for x in rels} == {1.0}


def test_confidence_and_type(spark):
    lines = "\n".join(f"entity<|#|>Name {c}<|#|>Robot<|#|>some description{m}" for c, m in
                      (("a", "<|#|>9"), ("b", "<|#|>0"), ("c", "<|#|>x"), ("d", "")))
    got = r.parse_entities(output(spark, lines)).orderBy("line_no").collect()
    assert [e["confidence"] for e in got] == [5, 1, 3, 3] and {e["entity_type"] for e in got} == {"other"}


def test_fields_are_cleaned_once(spark):
    for parse in (r.parse_entities, r.parse_relationships):
        plan = parse(output(spark, SAMPLE))._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter " in line]
        assert filters and not any(f"{costly}(" in line for line in filters for costly in ("regexp_replace", "split"))


def test_quality(spark):
    rows = [("42", "a long description"), ("The", "a long description"), ("X", "a long description"),
            ("--", "a long description"), ("Fine", "nine char"), ("Fine", "ten chars!")]
    df = spark.createDataFrame(rows, "entity_name string, description string")
    assert [x["description"] for x in r.good_entities(df).collect()] == ["ten chars!"]


def test_clean_field(spark):
    df = spark.createDataFrame([('"A<b>/c  d"',)], "x string")
    assert df.select(clean_field(F.col("x"))).first()[0] == "Abc d"


def test_dedup_entities(spark):
    rows = [(1, "Acme", "x one"), (2, "ACME", "X ONE"), (3, "acme", "y two"), (4, "Solo", "z" * 600)]
    df = spark.createDataFrame(rows, "ord int, entity_name string, description string").withColumns(
        {"entity_type": F.lit("t"), "chunk_id": F.col("ord").cast("string")})
    got = {x["entity_name"]: x for x in r.dedup_entities(df).collect()}
    assert got["Acme"]["description"] == "x one; y two" and got["Acme"]["n_sources"] == 3
    assert got["Solo"]["description"] == "z" * 600


def test_joined_text_is_exact_for_large_groups(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 900).cast("string").alias("d"))
    want = "; ".join(str(n) for n in range(900))[:500]
    assert joined_text(df, ["k"], "d", "o", 500).first()["description"] == want


def test_validation(spark):
    ents = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "ord int, entity_name string")
    rels = spark.createDataFrame([("alpha", "BETA"), ("Alpha", "alpha"), ("Alpha", "Gamma"), ("Alpha", "Beta"), ("Beta", "Beta")],
                                 "source_id string, target_id string")
    assert sorted(map(tuple, r.validate_relationships(rels, ents).collect())) == [("Alpha", "Beta")] * 2
    ok, bad = r.split_relationships(rels, ents)
    assert [tuple(x) for x in ok.collect()] == [("Alpha", "Beta")]
    assert sorted(x["reason"] for x in bad.collect()) == ["self-loop", "source missing", "target missing", "target missing"]
    left, report = r.clean_orphans(rels, ents, dry_run=False)
    assert left.count() == 2 and tuple(report.first()) == (5, 3, 3)
    assert tuple(r.clean_orphans(rels, ents)[1].first()) == (5, 3, 0)


def test_spotting_matches_plain_regex(spark):
    import re
    text = "Ask Mary Ann Lee about GPT and API in New  York, École Zoé mcDonald RAGtime"
    found = re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text) + re.findall("GPT|API|LLM|RAG|AI|ML|DL", text)
    want = sorted(set(found), key=lambda e: (-len(e), e))[:5]
    assert spark.createDataFrame([(text,)], "t string").select(r.spot_entities(F.col("t"))).first()[0] == want


def test_joined_text_reaches_its_last_character(spark):
    rows = [("k", chr(0x4E00 + n), n) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, d string, o long")
    want = "; ".join(r[1] for r in rows)[:500]
    assert len(want) == 500 and joined_text(df, ["k"], "d", "o", 500).first()["description"] == want
