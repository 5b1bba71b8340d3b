"""Round trips of archives and token files, packing, and the separator scan."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing, tokenfiles, warc
from graphloom.llm.common import file_system, folder
from graphloom.llm.tokens import Encoder
from tests.llm.data import documents, empty, texts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sZ É.,!|1\n\t İ̇Σ²{}"), max_size=40), min_size=1, max_size=4))
def test_words_encode_like_whole_texts(some):
    for path in (BYTE, WORD):
        encoder = Encoder.of(path)
        assert encoder.encode(some) == encoder.whole(some)


def test_special_strings():
    text = ["a <|endoftext|> b"]
    end = (50256).to_bytes(4, "little")
    assert end in Encoder.of(BYTE).encode(text)[0]
    assert end not in Encoder.of(BYTE, True).encode(text)[0]


def ids_of(path: str, text: str | None, end: int = 0) -> np.ndarray:
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    path = folder(spark, "tokens")
    docs = documents(spark)
    manifest = tokenfiles.write_parquet(docs, path, BYTE, encoding=encoding, group_tokens=500)
    got = tokenfiles.read_digests(manifest, path).collect()
    want = [(r.doc_id, ids_of(BYTE, r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    some = tokenfiles.read_parquet(manifest, path, 6, 12).collect()
    assert sorted(r.doc_id for r in some) == [6, 9, 12]
    fs, root = file_system(path)
    column = pq.ParquetFile(fs.open_input_file(f"{root}/{manifest.first().file}")).metadata.row_group(0).column(3)
    assert column.has_column_index and column.has_offset_index
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_token_files_of_many_ranges(spark):
    path, ranges = folder(spark, "tokens"), 6 * spark.sparkContext.defaultParallelism
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, (str(ranges), "false")):
            spark.conf.set(k, v)
        rows = spark.range(900).selectExpr(
            "CASE WHEN id % 30 > 0 THEN id DIV 2 END AS doc_id", "repeat('word ', CAST(id % 7 AS INT)) || id % 90 AS text"
        )
        manifest = tokenfiles.write_parquet(rows, path, BYTE, range_bytes=1)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert manifest.count() > 2 * spark.sparkContext.defaultParallelism
    got = sorted(tokenfiles.read_digests(manifest, path).collect(), key=lambda r: r.start)
    assert len(got) == 900
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert known == sorted(known)


def test_token_files_are_read_by_column(spark):
    """Lengths and places come without the ids: their bytes may be gone from the file."""
    path = folder(spark, "tokens")
    rows = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 9 AS INT)) AS text")
    manifest = tokenfiles.write_parquet(rows, path, BYTE, group_tokens=40)
    whole = {r.doc_id: r for r in tokenfiles.read_parquet(manifest, path).collect()}
    fs, root = file_system(path)
    for file in {r.file for r in manifest.collect()}:
        with fs.open_input_file(f"{root}/{file}") as f:
            data = bytearray(f.read())
            told = pq.ParquetFile(pa.BufferReader(bytes(data))).metadata
        for group in range(told.num_row_groups):
            ids = told.row_group(group).column(3)
            low = ids.dictionary_page_offset or ids.data_page_offset
            data[low : low + ids.total_compressed_size] = b"\xff" * ids.total_compressed_size
        with fs.open_output_stream(f"{root}/{file}", compression=None) as out:
            out.write(bytes(data))
    some = tokenfiles.read_parquet(manifest, path, columns=["n_tokens", "doc_id", "start"])
    assert some.columns == ["n_tokens", "doc_id", "start"]
    assert {r.doc_id: (r.start, r.n_tokens) for r in some.collect()} == {d: (r.start, len(r.ids)) for d, r in whole.items()}
    ranged = tokenfiles.read_parquet(manifest, path, 50, 59, columns=["n_tokens"]).collect()
    assert sorted(r.n_tokens for r in ranged) == sorted(whole[d].n_tokens for d in range(50, 60))
    with pytest.raises(ValueError, match="no such columns"):
        tokenfiles.read_parquet(manifest, path, columns=["text"])


def test_token_files_of_nothing(spark):
    path = folder(spark, "tokens")
    manifest = tokenfiles.write_parquet(empty(spark), path, BYTE)
    assert manifest.count() == 0 and tokenfiles.read_parquet(manifest, path).count() == 0


@pytest.mark.parametrize("block, width", [(4, 4), (12, 2), (64, 4), (4_000_000, 2)])
def test_separator_scan(spark, block, width):
    path = folder(spark, "flat")
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    rng = np.random.default_rng(block)
    files, want = [], set()
    for k in range(4):
        ids = np.where(rng.random(200) < (0.0, 0.05, 0.4, 1.0)[k], 9, 1).astype(f"<u{width}")
        with fs.open_output_stream(f"{root}/f{k}") as out:
            out.write(ids.tobytes())
        files.append((f"f{k}", ids.nbytes))
        ends = [*(np.flatnonzero(ids == 9) + 1).tolist()]
        open_tail = not ends or ends[-1] != len(ids)
        edges = [0, *ends, *([len(ids)] if open_tail else [])]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want.add((f"f{k}", i, a, b - a, not (open_tail and b == len(ids))))
    files.append(("none", 0))
    got = tokenfiles.scan_flat(spark.createDataFrame(files, "file string, n_bytes long"), path, 9, width, block)
    assert {tuple(r) for r in got.collect()} == want


def test_counted_documents(spark):
    docs = documents(spark)
    got = tokenfiles.count_tokens(docs, BYTE, 50256).collect()
    encoder = Encoder.of(BYTE, True)
    want = Counter((r.doc_id, len(encoder.whole([r.text or ""])[0]) // 4 + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert len({(r.file, r.ordinal) for r in got}) == len(got)
    many = docs.repartition(5 * spark.sparkContext.defaultParallelism)
    assert len({(r.file, r.ordinal) for r in tokenfiles.count_tokens(many, BYTE, 50256).collect()}) == len(got)
    assert tokenfiles.count_tokens(empty(spark), BYTE, 50256).count() == 0


def test_packing(spark):
    docs = documents(spark)
    got = packing.pack(docs, WORD, capacity=64).collect()
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(texts()):
        ids = ids_of(WORD, text)
        copies = 2 if i in (6, 11) else 1
        assert len(per_doc[i * 3]) == copies * -(-len(ids) // 64)
        for r in per_doc[i * 3]:
            assert r.start == 64 * r.piece and r.length == min(64, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    tokens = sum(r.length for r in got)
    assert len(sequences) <= -(-tokens // 64) + 2
    assert packing.pack(empty(spark), WORD).count() == 0


def test_packing_of_many_partitions(spark):
    n = 3 * spark.sparkContext.defaultParallelism
    docs = spark.range(600, numPartitions=n).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 7 AS INT)) AS text")
    sequences = defaultdict(list)
    for r in packing.pack(docs, WORD, capacity=64).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(30, 45))
def test_best_two_fit_places_everything(lengths, capacity):
    length = np.array(sorted(lengths))
    counts = np.bincount(length, minlength=capacity + 1)
    slots = packing.Slots(packing.best_two_fit(counts, capacity))
    rank = np.arange(len(length)) - np.searchsorted(length, length)
    sequence, offset = slots.place(length, rank)
    for k in range(slots.sequences):
        own = np.flatnonzero(sequence == k)
        own = own[np.argsort(offset[own])]
        assert len(own) and (offset[own] == np.cumsum(length[own]) - length[own]).all() and length[own].sum() <= capacity


def test_two_fit_more_tightly_than_one():
    # After 11 the longest that fits is 8, which leaves 1; 5 and 4 in its place leave nothing.
    assert packing.best_two_fit(np.bincount([11, 8, 5, 4], minlength=21), 20) == [(1, [(11, 1), (5, 1), (4, 1)]), (1, [(8, 1)])]


def pages(spark):
    rows = [
        (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (9, "http://c", "<p>one</p>"), (3, None, None), (4, "http://d", ""),
        (5, "http://e\nx", "é日本" * 1000), (None, "http://f", "<p>one</p>"), (6, "http://g", "\r\n\r\nHTTP"), (6, "http://g", "\r\n\r\nHTTP"),
    ]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keeper int")


@pytest.mark.parametrize("min_bytes", [0, 1, 11])
def test_archives_round_trip(spark, min_bytes):
    got = warc.round_trip(pages(spark), min_bytes).collect()
    rows = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    keeper = {}
    for page_id, body in rows:
        keeper[body] = max(keeper.get(body, -1), -1 if page_id is None else page_id)
    want = Counter()
    for page_id, body in rows:
        other = len(body) >= min_bytes and page_id != keeper[body]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[(page_id, len(body), digest, "revisit" if other else "response", keeper[body] if other else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) in dict(map(reversed, rows)) for r in got if r.record_type == "response")


def test_selected_records_in_coalesced_reads(spark):
    path = folder(spark, "warc")
    table = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(300)], "page_id long, url string, html string")
    index = warc.write_archives(table, path, file_bytes=4_000)
    assert index.select("file").distinct().count() > 3
    some = warc.read_records(index.filter("page_id % 7 = 0"), path, gap=200, most=2_000).collect()
    assert {r.page_id: bytes(r.payload) for r in some} == {i: (f"<p>{i}</p>" * 50).encode() for i in range(0, 300, 7)}
    none = warc.write_archives(table.limit(0), folder(spark, "warc"))
    assert none.count() == 0
