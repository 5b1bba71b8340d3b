"""Chunking and sources."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import markup, pieces
from graphloom.functions.pieces import ChunkSettings, count_words
from graphloom.operators import chunking as c
from graphloom.sources import files, store


@pytest.mark.parametrize("n, parts", [(500, 1), (501, 2), (950, 2), (1200, 3)])
def test_windows(spark, n, parts):
    text = " ".join(f"w{k}" for k in range(n))
    assert len(pieces.windows(text, ChunkSettings())) == parts
    got = c.token_windows(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("part").collect()
    assert [g["content"].split()[0] for g in got] == [f"w{450 * k}" for k in range(parts)]
    assert got[-1]["content"].split()[-1] == f"w{n - 1}"


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        ChunkSettings(10, 10)


def test_sentence_aware_windows_cover_the_text():
    text = " ".join(("stop." if k % 7 == 0 else f"w{k}") for k in range(300))
    parts = pieces.windows(text, ChunkSettings(50, 10, sentence_aware=True))
    assert all(p.endswith("stop.") for p in parts[:-1]) and parts[-1].endswith("w299")
    assert sum(len(p.split()) - 10 for p in parts) + 10 == 300


def test_sections():
    assert list(pieces.sections(["# A", "## B", "# C"])) == ["A", "A > B", "C"]
    assert list(pieces.sections(["####### x", "#x", "x"])) == ["ROOT"] * 3


def test_breadcrumb(spark):
    assert pieces.breadcrumb("A", 1, 1) == "**[SECTION] A**"
    assert pieces.breadcrumb("A", 2, 3) == "**[SECTION] A — part 2/3**"
    got = spark.range(1).select(c.with_breadcrumb(F.lit("A"), F.lit("x"), F.lit(2), F.lit(3))).first()[0]
    assert got == "**[SECTION] A — part 2/3**\n\nx"


def test_sound(spark):
    df = spark.createDataFrame([("short",), ("   " * 9,), ("ÃÃabcdefgh",), ("good enough",)], "x string")
    assert [r["x"] for r in df.where(c.is_sound(F.col("x"))).collect()] == ["good enough"]


def test_tables_are_packed_with_their_header():
    rows = [f"| r{k} | v |" for k in range(30)]
    text = "\n".join(["before", "| a | b |", "|---|---|", *rows, "after"])
    assert pieces.find_table(text.split("\n")) == (1, 33)
    parts = pieces.split_buffer(text, ChunkSettings(60, 5), count_words)
    assert all("| a | b |\n|---|---|" in p for p in parts) and all(count_words(p) <= 60 for p in parts)
    assert [line for p in parts for line in p.split("\n") if line.startswith("| r")] == rows
    assert parts[-1].endswith("after")
    assert pieces.find_table(["| a |", ""]) is None


def test_table_span_agrees_with_python(spark):
    texts = ["x", "| a |\n|--|\n| 1 |\nend", "p\n| a |\n| : |\n| 1 |", "q\n|a|\n |:-| \n|1|", "|a|\n|-|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(c.table_span(F.col("t"))).collect()]
    assert got == [pieces.find_table(t.split("\n")) for t in texts]


def test_chunks_cover_whole_documents(spark):
    text = "\n".join(["# Top", *[f"line {k} " + "w " * (k % 90) for k in range(200)], "## Sub", "ok", "the end"])
    df = spark.createDataFrame([("d", text, "a/b.md")], "doc_id string, text string, file_path string")
    rows = c.chunk_documents(df, ChunkSettings(120, 10)).orderBy("order").collect()
    assert [r["order"] for r in rows] == list(range(len(rows))) and len({r["chunk_id"] for r in rows}) == len(rows)
    said = set(" ".join(r["content"] for r in rows).split())
    assert set(text.split()) <= said and rows[0]["file_type"] == "MD" and rows[0]["section"] == "Top"
    assert max(r["tokens"] for r in rows) <= 120


def test_tiny_pieces_join_the_one_before(spark):
    df = spark.createDataFrame([(["ab", "longer", "x", " y ", "another", "z"],)], "p array<string>")
    assert df.select(c.merge_tiny(F.col("p"))).first()[0] == ["ab", "longer\nx\n y ", "another\nz"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve\r\ntext".encode())
    (tmp_path / "b.MD").write_bytes(b"caf\xe9")
    (tmp_path / "c.json").write_text('{"k": "é", "n": [1]}')
    (tmp_path / "d.html").write_text("<p>one<script>if (a</p>b) x()</script></p><!-- no --><b> two &amp; 3</b>")
    (tmp_path / "e.xml").write_text("<a> x <b>y</b></a>")
    (tmp_path / "f.csv").write_text('h1,h2\n1,"a, b"\n2,\n')
    (tmp_path / "g.json").write_text("{broken")
    (tmp_path / "h.exe").write_text("no")
    (tmp_path / "i.docx").write_bytes(b"raw")
    got = {r["file_path"].rsplit("/", 1)[1]: r["text"] for r in files.read_documents(
        spark, str(tmp_path), binary_parsers={"docx": lambda b: f"{len(b)} bytes"}).collect()}
    assert got == {
        "a.txt": "naïve\ntext", "b.MD": "café", "c.json": json.dumps({"k": "é", "n": [1]}, indent=2, ensure_ascii=False),
        "d.html": "one\ntwo & 3", "e.xml": "x\ny", "f.csv": "h1 | h2\n1 | a, b\n2 |", "i.docx": "3 bytes",
    }


def test_csv_blocks():
    text = "a,b\n" + "\n".join(f"{k},x" for k in range(400))
    blocks = markup.csv_text(text).split("\n\n")
    assert len(blocks) > 1 and all(b.startswith("a | b\n") for b in blocks)


def test_safe_name(spark):
    assert spark.createDataFrame([("my file (1)?.pdf",)], "n string").select(files.safe_name(F.col("n"))).first()[0] == "my file 1.pdf"


def test_store_round_trip(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("doc_id"), F.array(F.lit(1.5)).alias("embedding"))
    store.save_vectors(df, str(tmp_path / "v"))
    assert sorted(map(str, store.load_vectors(spark, str(tmp_path / "v")).collect())) == sorted(map(str, df.collect()))
    store.append(df.withColumn("user_id", F.lit("u")), str(tmp_path / "t"))
    store.append(df.withColumn("user_id", F.lit("w")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("user_id = 'w'").count() == 20
    store.export_csv(df.select("idx"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 20


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = store.upsert(old, new, ["k"])
    want = [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, store.upsert(once, new, ["k"]).collect()))


def test_upsert_adds_new_fields(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "k int, v string, extra int")
    got = store.upsert(old, new, ["k"])
    assert got.columns == ["k", "v", "extra"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "c", 5), (3, "d", 6)]


def test_tokens_are_the_same_in_both_engines(spark):
    from graphloom.functions.pieces import count_words
    from graphloom.functions.text import strip, token_count

    texts = ["un\u00a0mot et\u202fdeux", "a\x1cb c\x85d", "\u3000x y\u2009z ", "", "plain text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(token_count(F.col("t")).alias("n"), strip(F.col("t")).alias("s")).collect()
    assert [(r["n"], r["s"]) for r in got] == [(count_words(t), t.strip()) for t in texts]


def test_null_texts_are_empty(spark):
    from graphloom.operators import chunking

    docs = spark.createDataFrame([(1, None), (2, "# A\nb")], "doc_id long, text string")
    assert {(r.doc_id, r.section) for r in chunking.line_sections(docs).collect()} >= {(2, "A")}
    assert {r.text for r in files.parse_column(docs.withColumnRenamed("text", "html"), "html", markup.html_text).collect()} == {"", "# A\nb"}
    tables = spark.createDataFrame([(1, None, None, None), (2, "h", ["a", None], "p")], "doc_id long, header string, rows array<string>, prefix string")
    assert chunking.packed_rows(tables).count() == 2
