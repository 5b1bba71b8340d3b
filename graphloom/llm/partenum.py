"""N-gram Jaccard join: PartEnum signatures.

Sets of word shingles are put into bands of size. In a band, two sets of the wanted likeness differ in
at most k shingles. The domain of shingles is cut by hash into ``first`` partitions, each of these into
``second`` partitions, and a signature is made for every choice of ``second - spare`` of the latter: of
the first-level partitions at least ``slack + 1`` hold ``spare`` differences or fewer, and in each of
those one choice of second-level partitions has no difference at all, so its signature is shared.

Every pair that shares a signature counts as a candidate, yet pairs are not formed within buckets:
each member meets the least member first, then the most typical one, and only then members that are
still in other components.
Of its buckets with more than ``HOT`` sets (a passage that many documents share) each set leaves out the
``slack`` largest: alike sets share signatures of more partitions than that, and the one in the least
bucket of these is left out by neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hash_spans, mix, partitions_for, select, stored, windows
from graphloom.llm.components import components

WORDS = 5
#: Rows without doc_id get numbers from here on, by the hash of their text: larger than any doc_id, and unlike for unlike texts.
NO_ID = 1 << 62
#: Buckets of more sets than this are hot.
HOT = 4
#: Shingles whose signatures one group of buckets has, about.
GROUP_SHINGLES = 400_000
_HASH_BITS = 40
#: Buckets of the least sketch, which is also what joins look at.
SKETCH_BITS = 1024


@dataclass(frozen=True)
class Bands:
    """Overlapping bands of set sizes and their signature schemes.

    Two sets are alike if 100 * intersection >= ``percent`` * union. Bands are ``ratio`` wide and overlap so
    that any two sizes that can be alike are in one band together.
    """

    percent: int = 80
    ratio: float = 1.5625
    second: int = 3
    spare: int = 1
    slack: float = 0.08
    largest: int = 1 << 34

    @cached_property
    def edges(self) -> list[tuple[int, int]]:
        low, out = 1, []
        while low <= self.largest:
            high = max(low, int(low * self.ratio))
            out.append((low, high))
            # The least size alike to the first size beyond this band.
            low = max(low + 1, -(-self.percent * (high + 1) // 100))
        return out

    def differences(self, total: int) -> int:
        """Most differences between alike sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    @cached_property
    def schemes(self) -> list[tuple[int, int, int, int]]:
        """First-level and second-level partitions, spare and slack of each band; (0, …) where only equal sets are alike."""
        out = []
        for low, high in self.edges:
            k = self.differences(2 * high)
            if high * 100 < self.percent * (high + 1):  # one shingle less is already too different
                out.append((0, 0, 0, 0))
                continue
            second, spare = (self.second, self.spare) if k > 2 * self.spare else (1, 0)
            least = k // (spare + 1) + 1
            slack = max(1, int(self.slack * least))
            out.append((least + slack, second, spare, slack))
        return out

    def of(self, size: int) -> range:
        """The bands that have a size."""
        low = next(i for i, (_, high) in enumerate(self.edges) if high >= size)
        high = low
        while high + 1 < len(self.edges) and self.edges[high + 1][0] <= size:
            high += 1
        return range(low, high + 1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[list[np.ndarray]]:
    """For runs of documents, the sorted distinct hashes of each document's shingles."""
    for block in blocks(column, lower=True):
        start, end, doc = block.words()
        h = hash_spans(block.data, start, end)
        grams, first = windows(h, doc, words)
        own = doc[first]
        edge = np.searchsorted(doc, np.arange(block.n + 1))
        few = np.flatnonzero((np.diff(edge) > 0) & (np.diff(edge) < words))
        if len(few):  # with fewer words the whole sequence is one shingle
            whole = np.zeros(len(few), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(words - 1):
                    has = edge[few] + j < edge[few + 1]
                    whole[has] = mix(whole[has] * np.uint64(31) + h[edge[few][has] + j] + np.uint64(j + 1))
            grams, own = np.concatenate((grams, whole)), np.concatenate((own, few))
        order = np.lexsort((grams, own))
        grams, own = grams[order], own[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
        grams, own = grams[new], own[new]
        yield np.split(grams, np.searchsorted(own, np.arange(1, block.n)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 2^j hash buckets, two for a shingle or more, as packed bits.

    Where two sets' parities differ there is a difference in the bucket, so they differ in as many shingles at least.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(shingles)).bit_length())
    place = (shingles >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))


def folded(parity: np.ndarray, n_bytes: int) -> np.ndarray:
    """A sketch with fewer buckets: neighbours put together."""
    if len(parity) == n_bytes:
        return parity
    bits = np.unpackbits(parity).reshape(8 * n_bytes, -1)
    return np.packbits(np.bitwise_xor.reduce(bits, axis=1))


def least_differences(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the differences of two sets, from their sketches."""
    n = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n) ^ folded(b, n)).sum())


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set in all its bands; the band is in the highest eight bits."""
    out = []
    for band in bands.of(len(shingles)) if len(shingles) else ():
        first, second, spare, _ = bands.schemes[band]
        if not first:
            continue
        with np.errstate(over="ignore"):
            own = mix(shingles + np.uint64(0x51ED270B * (band + 1)))
            cells = first * second
            # The cell of a shingle, by the upper half of its hash; what it adds to it, by all of it.
            cell = ((own >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own[order]), dtype=np.uint64)))
            at = np.searchsorted(cell[order], np.arange(cells + 1))
            sums = (total[at[1:]] - total[at[:-1]]).reshape(first, second)
            for c, chosen in enumerate(combinations(range(second), second - spare)):
                where = (np.arange(first, dtype=np.uint64) * np.uint64(64) + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
                # Cells stay apart in the hash: a set is the list of its cells' sums.
                h = where.copy()
                for j in chosen:
                    h = mix(h + sums[:, j] * np.uint64(2 * j + 3))
                out.append((h >> np.uint64(8)) | (np.uint64(band) << np.uint64(56)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _ids(narrow: DataFrame) -> DataFrame:
    unnamed = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    return narrow.withColumn("doc_id", F.coalesce(narrow.doc_id.cast("long"), unnamed))


def sets_table(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (shingles), set_a and set_b (hash of the set in two longs), sketch and fold (its least form) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sketch", pa.binary()), ("fold", pa.list_(pa.int64()))])
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), words):
                with np.errstate(over="ignore"):
                    a = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
                    b = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
                sketches = [sketch(s) for s in sets]
                folds = [folded(s, SKETCH_BITS // 8).view(np.int64) for s in sketches]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), pa.array([s.tobytes() for s in sketches], pa.binary()),
                     pa.array(folds, pa.list_(pa.int64()))], schema=schema,
                )
                at += len(sets)

    return _ids(select(documents, "doc_id", "text")).mapInArrow(run, "doc_id long, n long, set_a long, set_b long, sketch binary, fold array<long>")


def buckets(documents: DataFrame, groups: int, bands: Bands, words: int = WORDS) -> DataFrame:
    """group, ids and marks: signatures dealt into ``groups`` by hash, as packed arrays.

    Of equal sets that one task reads, only the first is signed. A row has the signatures of some documents
    in one group: a table of their ids, and for every signature its band and hash and a place in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary())])
        seen: set[bytes] = set()
        docs: list[int] = []
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            marks = np.concatenate(held)
            own = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            # The group comes from the lower 24 bits; most of these are not in the hash that is kept.
            group = (mix(marks & np.uint64((1 << 24) - 1)) % np.uint64(groups)).astype(np.int32)
            order = np.lexsort((own, group))
            marks, own, group = marks[order], own[order], group[order]
            run = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            ids = np.array(docs, np.int64)
            rows: tuple[list, list, list] = ([], [], [])
            for a, b in zip(run[:-1], run[1:]):
                used, place = np.unique(own[a:b], return_inverse=True)
                part = marks[a:b]
                rows[0].append(int(group[a]))
                rows[1].append(ids[used].tobytes())
                # Band and hash take 48 bits, the place 16.
                keep = ((part >> np.uint64(56)) << np.uint64(40)) | ((part >> np.uint64(16)) & np.uint64((1 << _HASH_BITS) - 1))
                rows[2].append(((keep << np.uint64(16)) | place.astype(np.uint64)).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], schema=schema)

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for sets in shingle_sets(batch.column(1), words):
                for doc_id, shingles in zip(ids[at : at + len(sets)], sets):
                    with np.errstate(over="ignore"):
                        key = shingles.sum(dtype=np.uint64).tobytes() + mix(shingles).sum(dtype=np.uint64).tobytes()
                    if not len(shingles) or key in seen:
                        continue
                    seen.add(key)
                    marks = signatures(shingles, bands)
                    if len(marks):
                        docs.append(doc_id)
                        held.append(marks)
                        count += len(marks)
                    if count > 1_000_000 or len(docs) == 1 << 16:
                        yield flush()
                        docs, held, count = [], [], 0
                at += len(sets)
        if docs:
            yield flush()

    return _ids(select(documents, "doc_id", "text")).mapInArrow(run, "group int, ids binary, marks binary")


def bucket_members(dealt: DataFrame) -> DataFrame:
    """signature, doc_id, least (the least doc_id of the bucket) and size, for buckets of two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("signature", pa.int64()), ("doc_id", pa.int64()), ("least", pa.int64()), ("size", pa.int32())])
        now, marks, ids = None, [], []

        def judged() -> Iterator[pa.RecordBatch]:
            mark, doc = np.concatenate(marks), np.concatenate(ids)
            order = np.lexsort((doc, mark))
            mark, doc = mark[order], doc[order]
            run = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1], [True])))
            size = np.repeat(np.diff(run), np.diff(run))
            least = np.repeat(doc[run[:-1]], np.diff(run))
            many = size > 1
            with np.errstate(over="ignore"):  # the group is part of the signature
                named = (mark[many] & ~np.uint64((1 << _HASH_BITS) - 1)) << np.uint64(16) | (mix(mark[many] + mix(np.full(1, now, np.uint64))) >> np.uint64(8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(named.view(np.int64)), pa.array(doc[many]), pa.array(least[many]), pa.array(size[many].astype(np.int32))], schema=schema
            )

        for batch in batches:
            for group, table, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if group != now and marks:
                    yield from judged()
                    marks, ids = [], []
                now = group
                raw = np.frombuffer(packed, np.uint64)
                marks.append(raw >> np.uint64(16))
                ids.append(np.frombuffer(table, np.int64)[(raw & np.uint64(0xFFFF)).astype(np.int64)])
        if marks:
            yield from judged()

    near = dealt.repartition("group").sortWithinPartitions("group")
    return near.mapInArrow(run, "signature long, doc_id long, least long, size int")


def _close(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of representatives whose sizes and sketches let them be alike: a, b."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    percent = bands.percent
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                least_differences(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= bands.differences(n + m)
                for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            ]
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            if kept.num_rows:
                yield kept

    return sized.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs that are alike, by exact intersection of their sets: a, b."""
    needed = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), words):
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), lists], schema=schema)
                at += len(sets)

    texts = _ids(select(documents, "doc_id", "text")).join(needed, "doc_id", "left_semi")
    laid = stored(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>"), "shingles")
    a = laid.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    b = laid.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("i"), (F.size("of_a") + F.size("of_b") - common).alias("u"))
    return both.filter(100 * F.col("i") >= percent * F.col("u")).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, bands: Bands = Bands(), words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set has its distinct shingles of ``words`` words (A-Z in lower case); with fewer words the
    whole sequence is one shingle. Two documents link when 100 * intersection >= ``bands.percent`` * union;
    component_id is the least doc_id reachable by links. All links count, none is missed.

    Null and empty texts, and texts of blanks, have an empty set and link with nothing: their component is
    their own id. Repeated rows give repeated results. Rows with one doc_id are one document for its links.
    Rows with a null doc_id are a document for each text, larger than any id (ids are below 2^62); their component_id is
    null if no id is reachable.
    Other columns are ignored, an empty table gives an empty result.
    """
    spark = documents.sparkSession
    sets = stored(sets_table(documents, words), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = partitions_for(total, GROUP_SHINGLES, 4 * spark.sparkContext.defaultParallelism, 1 << 24)
    # Equal sets are one class, led by its least id.
    led = sets.filter("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("fold").alias("fold"))
    classes = stored(led, "classes")
    of = stored(
        sets.filter("n > 0").select("doc_id", "set_a", "set_b", "n").join(classes.drop("sketch", "fold"), ["set_a", "set_b", "n"])
        .select("doc_id", "rep").distinct(),
        "class-of",
    )
    lead = classes.select("rep", "n", "sketch")
    folds = classes.select("rep", "n", "fold")

    members = stored(bucket_members(buckets(documents, groups, bands, words)), "buckets")
    star = members.filter("doc_id <> least").select("doc_id", "least").distinct()
    named = star.join(of, "doc_id").select("least", F.col("rep").alias("x")).join(
        of.select(F.col("doc_id").alias("least"), F.col("rep").alias("y")), "least"
    )
    pairs = named.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = stored(_close(pairs, lead, bands), "pairs")
    links = stored(_alike(tried, documents, words, bands.percent), "linked")
    same_id = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    found = stored(components(links.union(same_id)), "components")

    kept = stored(_kept(members, of, bands), "kept")
    for choose in (_typical_pairs, _other_pairs):
        more = stored(_close(choose(_mixed(kept, found), tried, folds, bands.percent), lead, bands), "pairs")
        if more.isEmpty():
            continue
        tried = tried.union(more)
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored(components(known.union(_alike(more, documents, words, bands.percent))), "components")
    label = classes.select("set_a", "set_b", "n", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    label = label.select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n", "set_a", "set_b").join(label, ["set_a", "set_b", "n"], "left")
    real = lambda c: F.when(c < NO_ID, c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        real(F.coalesce("component", "doc_id")).alias("component_id"),
    )


def _kept(members: DataFrame, of: DataFrame, bands: Bands) -> DataFrame:
    """signature and rep (the class of a member) of buckets of three or more, without what a set may leave out."""
    wide = members.filter("size > 2")
    band = F.shiftrightunsigned("signature", 56).cast("int")
    slack = members.sparkSession.createDataFrame([(i, s[3]) for i, s in enumerate(bands.schemes)], "band int, slack int")
    # Of the hot buckets of a set its ``slack`` largest are left out; all sets agree on the order of buckets.
    largest = Window.partitionBy("doc_id", "band").orderBy(F.desc("size"), "signature")
    hot = wide.filter(F.col("size") > HOT).withColumn("band", band).withColumn("place", F.row_number().over(largest))
    left = hot.join(F.broadcast(slack), "band").filter("place > slack")
    rows = wide.filter(F.col("size") <= HOT).select("signature", "doc_id").union(left.select("signature", "doc_id"))
    return rows.join(of, "doc_id").select("signature", "rep")


def _mixed(kept: DataFrame, found: DataFrame) -> DataFrame:
    """signature, rep and component of the buckets that still have members of several components."""
    labels = found.select(F.col("node").alias("rep"), "component")
    named = kept.join(labels, "rep", "left").select("signature", "rep", F.coalesce("component", "rep").alias("component"))
    spread = named.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return stored(named.join(spread.select("signature"), "signature", "left_semi").distinct(), "mixed")


def _pairs(met: DataFrame, tried: DataFrame) -> DataFrame:
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def _typical_pairs(mixed: DataFrame, tried: DataFrame, folds: DataFrame, percent: int) -> DataFrame:
    """Every member with the member of its bucket that is in most buckets: a text that others are edits of."""
    often = mixed.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    centre = mixed.join(often, "rep").groupBy("signature").agg(F.max(F.struct("n", -F.col("rep"))).alias("best"))
    centre = centre.select("signature", (-F.col("best.col2")).alias("x"))
    own = mixed.select(F.col("rep").alias("x"), F.col("component").alias("of_x")).distinct()
    met = mixed.join(centre, "signature").join(own, "x").filter("component <> of_x")
    return _pairs(met.withColumnRenamed("rep", "y"), tried)


def _other_pairs(mixed: DataFrame, tried: DataFrame, folds: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that are still in different components and can be alike by their sizes and folded sketches.

    Of two such members one at least is outside the bucket's most frequent component. The join itself looks at
    sizes and sketches, so that pairs which are not alike are never rows.
    """
    counted = mixed.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("signature").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    told = mixed.join(folds, "rep")
    rare = told.join(main, "signature").filter("component <> main")
    rare = rare.select("signature", *[F.col(c).alias(f"x_{c}") for c in ("rep", "component", "n", "fold")])
    apart = sum((F.bit_count(F.col("fold")[i].bitwiseXOR(F.col("x_fold")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    near = (
        (F.col("x_component") != F.col("component"))
        & (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n"))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("x_n")))
    )
    met = rare.join(told.withColumnRenamed("signature", "s"), (F.col("signature") == F.col("s")) & near)
    return _pairs(met.select(F.col("x_rep").alias("x"), F.col("rep").alias("y")), tried)
