"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart (r even) have a value within r / 2 bits of both. So every distinct fingerprint
emits all values within r / 2 bits, and a shuffle on the values brings all linked fingerprints together; any two that
meet are at most r bits apart, which a check of the differing bits confirms. A value's group holds at most the ball's
size of distinct fingerprints, whatever the copies: equal documents share one fingerprint, and it is fingerprints that
are dealt out. Within a group links join neighbours in order; that keeps every component.

`near_duplicates` joins all pairs of at least a given Jaccard similarity of word shingles. Equal word sequences are one
class from the start. Fingerprints of several seeds are taken over a document's distinct words, and classes that meet in
any of them are compared exactly; that links most copies cheaply. All other pairs come from an exact prefix filter: of two
sets with that similarity, the first shingles of either, in any one order of all shingles, have one in common. The order
is from rare to frequent by a sketch of counts, so the sketch's errors cost time and no pair.

Cases: a null or empty text has no words and fingerprint zero; fewer words than a shingle give one shingle; rows with
equal ids are rows of one document; a row without an id has a fingerprint and gets the class of its fingerprint (null,
if no row with an id shares the class) and is never removed; an empty table gives no rows; other columns pass untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.llm.common import BASES, Work, few, mix, span_hashes, text_chunks, unused
from tidewake.llm.graph import components

SEED = 42
#: Seeds of the candidate fingerprints of near_duplicates, of 64 bits each; each half is a fingerprint of its own.
TABLE_SEEDS = (1, 2)
HALF_BITS = 32
#: Differing bits of 64 of the shingles' fingerprint beyond which a meeting is left to the prefix filter: at a similarity
#: of 0.8 some 10 differ, of unrelated texts 32.
NEAR_BITS = 22
#: Counters of the sketch that orders shingles, and counters of a row of it.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
#: Texts of a task that must have one of a counter's shingles for the counter to be reported.
HEAVY = 4
#: Bytes of text whose shingles are made at a time.
SPAN_BYTES = 1 << 18
#: Classes of one shingle that are compared with each other at a time; more are dealt into parts, and pairs of parts.
PART_ROWS = 1000
#: Feature values whose bits are counted in one byte lane, and such groups that are added up at a time.
LANE, LANES = 255, 512
#: For each byte, its bits in eight byte lanes.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words joined by one blank each: bytes, starts and ends of words in them, first word of each text."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inside = ~blank
    begin = inside.copy()
    begin[1:] &= blank[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    number = np.cumsum(begin) - 1
    kept = np.flatnonzero(inside)
    out = np.full(len(kept) + len(starts), 0x20, np.uint8)
    out[np.arange(len(kept)) + number[kept]] = data[kept]
    lengths = np.bincount(number[kept], minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return out, ends - lengths, ends, np.searchsorted(starts, offsets)


def majority(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the 64 bits that are set in over half of its values; first has where each text's values start."""
    n, size = len(first) - 1, np.diff(first)
    groups = -(-size // LANE)
    row = np.repeat(np.arange(n), groups)
    start = first[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(groups) - groups, groups))
    counts = np.zeros((n, 64), np.int64)
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(row), LANES):
        some, who = start[a : a + LANES], row[a : a + LANES]
        end = start[a + LANES] if a + LANES < len(start) else len(values)
        lanes = np.add.reduceat(SPREAD[raw[some[0] : end]], some - some[0], axis=0).view(np.uint8)
        at = np.flatnonzero(np.diff(who, prepend=-1))
        counts[who[at]] += np.add.reduceat(lanes, at, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_values(data: np.ndarray, offsets: np.ndarray, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle of every text, and where each text's values start."""
    joined, starts, ends, first = words(lower(data), offsets)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    a = first[row] + np.arange(len(row)) - at[row]
    b = np.minimum(a + size, first[row + 1]) - 1
    raw, value = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((value(raw[x:y], seed) for x, y in zip(starts[a].tolist(), ends[b].tolist())), np.uint64, len(row)), at


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(majority(*shingle_values(data, offsets, size)).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most radius of the bits, as signed 64-bit values."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Links (a, b) that join all fingerprints fp of a table of distinct ones which are at most radius bits apart."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is what a fingerprint emits")
    mask = F.explode(F.array(*[F.lit(m).cast("bigint") for m in ball(bits, radius // 2)])).alias("mask")
    met = distinct.select("fp", mask).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), "fp")
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    pairs = met.select("fp", before.alias("other")).filter("other is not null and other <> fp")
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def similar_classes(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document: the smallest doc_id that links of fingerprints reach."""
    work = Work(docs.sparkSession, "simhash")
    fps = work.save(fingerprints(docs, size), "fingerprints")
    distinct = work.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), radius), work)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = work.save(rooted.withColumn("k", F.xxhash64("root")).join(of_root.withColumn("k", F.xxhash64("root")), ["k", "root"]).select("fp", "component_id"), "classes")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (row, value), sorted."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _shingles(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and last word of every shingle; fewer words than a shingle are one."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    row = np.repeat(np.arange(len(n)), count)
    a = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, a, np.minimum(a + size, first[row + 1]) - 1


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the distinct shingles of the texts, sorted within a text."""
    joined, starts, ends, first = words(lower(data), offsets)
    row, a, b = _shingles(first, size)
    return _distinct(row, span_hashes(joined, starts[a], ends[b]))


def _salted(value: np.ndarray, seed: int) -> np.ndarray:
    return mix(value + np.uint64(seed * BASES[0] & (1 << 64) - 1))


def signatures(docs: DataFrame, size: int, seeds: tuple[int, ...]) -> DataFrame:
    """(doc_id, h1, h2, near, blocks, heavy) of each document with an id, and a row without one for each task.

    h1 and h2 are a 128-bit BLAKE2 digest of the word sequence, near the fingerprint of the distinct shingles, blocks the
    halves of the fingerprints of the distinct words. A task's row has the counters of the sketch that at least HEAVY of
    its texts have a shingle of, with that number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), SPAN_BYTES):
                joined, starts, ends, first = words(lower(data), offsets)
                edge = np.append(starts, len(joined))[first].tolist()
                raw = memoryview(joined)
                whole = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(edge, edge[1:])), np.int64).reshape(-1, 2)
                rows = np.arange(b - a + 1)
                row, value = _distinct(np.repeat(rows[:-1], np.diff(first)), span_hashes(joined, starts, ends))
                at = np.searchsorted(row, rows)
                sets = np.stack([majority(_salted(value, s), at) for s in seeds], axis=1)
                halves = np.stack([sets & np.uint64((1 << HALF_BITS) - 1), sets >> np.uint64(HALF_BITS)], axis=2).reshape(-1).view(np.int64)
                row, x, y = _shingles(first, size)
                row, value = _distinct(row, span_hashes(joined, starts[x], ends[y]))
                np.add.at(sketch, (value & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                near = majority(mix(value), np.searchsorted(row, rows)).view(np.int64)
                blocks = pa.ListArray.from_arrays(pa.array(rows * (2 * len(seeds)), pa.int32()), pa.array(halves))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(near), blocks, pa.nulls(b - a, counted)], names)
        heavy = np.flatnonzero(sketch >= HEAVY)
        pairs = pa.StructArray.from_arrays([pa.array(heavy), pa.array(sketch[heavy].astype(np.int64))], ["counter", "n"])
        told = pa.ListArray.from_arrays(pa.array([0, len(heavy)], pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.list_(pa.int64())), told], names)

    names, counted = ["doc_id", "h1", "h2", "near", "blocks", "heavy"], pa.list_(pa.struct([("counter", pa.int64()), ("n", pa.int64())]))
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 bigint, h2 bigint, near bigint, blocks array<bigint>, heavy array<struct<counter: bigint, n: bigint>>")


def frequency(heavy: DataFrame) -> np.ndarray:
    """A level for each counter of a sketch, eight a doubling of the texts that tasks report, from their lists `heavy`."""

    def row(group: pa.Table) -> pa.Table:
        out = np.zeros(SKETCH_ROW, np.uint8)
        n = np.asarray(group["n"]).astype(np.float64)
        out[np.asarray(group["counter"]) % SKETCH_ROW] = np.minimum(np.log2(np.maximum(n, 1)) * 8, 255)
        return pa.table({"k": group["k"].slice(0, 1), "levels": pa.array([out.tobytes()], pa.binary())})

    told = heavy.select(F.explode("heavy").alias("x")).groupBy("x.counter").agg(F.sum("x.n").alias("n"))
    rows = told.select(F.floor(F.col("counter") / SKETCH_ROW).cast("int").alias("k"), "counter", "n").groupBy("k").applyInArrow(row, "k int, levels binary").collect()
    out = np.zeros(SKETCH, np.uint8)
    for r in rows:
        out[r["k"] * SKETCH_ROW : (r["k"] + 1) * SKETCH_ROW] = np.frombuffer(r["levels"], np.uint8)
    return out


def ball_pairs(classes: DataFrame, work: Work, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of classes (class, near, blocks) that meet in the ball of one of their blocks, or in a crowded block.

    A class is paired with the least class of a ball's value and with the one before it in the order of the shingles'
    fingerprint, if that fingerprint allows the similarity; so a value gives at most two pairs for each of its classes.
    A block with over PART_ROWS classes is crowded: only its least class goes into the balls, the others are paired with
    that one, and with the one before them in their part of the block. So no task orders more classes of one key than
    PART_ROWS times the masks of a ball, whatever a hot block has; what does not meet is left to the prefix filter.
    """
    masks, me = F.array(*[F.lit(m).cast("bigint") for m in ball(HALF_BITS, radius // 2)]), F.struct("class", "near")
    block = classes.select("class", "near", F.posexplode("blocks").alias("seed", "fp"))
    block = block.select("class", "near", F.shiftleft(F.col("seed").cast("bigint"), HALF_BITS).bitwiseOR(F.col("fp")).alias("fp"))
    sizes = block.groupBy("fp").agg(F.count("*").alias("rows"), F.min(me).alias("least")).filter(F.col("rows") > PART_ROWS)
    crowded = work.save(sizes.select("fp", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts"), "least"), "crowded")
    known = few(crowded)
    dealt = block.join(known, "fp").withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
    dealt = dealt.select("class", "near", "least", F.lag(me).over(Window.partitionBy("fp", "part").orderBy("near", "class")).alias("before"))
    calm = block.join(known, "fp", "left_anti").select("class", "near", "fp").unionAll(crowded.select("least.class", "least.near", "fp"))
    met = calm.select("class", "near", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    group = Window.partitionBy("value")
    met = met.select("class", "near", F.min(me).over(group).alias("least"), F.lag(me).over(group.orderBy("near", "class")).alias("before"))
    pairs = met.unionAll(dealt).select("class", "near", F.explode(F.array("least", "before")).alias("other")).filter("other is not null and other.class <> class")
    pairs = pairs.filter(F.bit_count(F.col("near").bitwiseXOR(F.col("other.near"))) <= NEAR_BITS)
    return pairs.select(F.least("class", "other.class").alias("a"), F.greatest("class", "other.class").alias("b")).distinct()


def alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the texts (doc_id, text) have at least the Jaccard similarity of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
            keep = []
            for a, _, data, offsets in text_chunks(both, SPAN_BYTES, step=2):
                row, value = _shingle_sets(data, offsets, size)
                count = np.bincount(row, minlength=len(offsets) - 1).reshape(-1, 2)
                pair = row // 2
                order = np.lexsort((value, pair))
                twice = (pair[order][1:] == pair[order][:-1]) & (value[order][1:] == value[order][:-1])
                common = np.bincount(pair[order][1:][twice], minlength=len(count))
                keep.append(a // 2 + np.flatnonzero(common >= similarity * (count.sum(axis=1) - common)))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(few(pairs.select("a", "b")), "a")
    wanted = texts.join(few(pairs.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return left.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def prefixes(texts: DataFrame, size: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(shingle, class, root, n, rank) of the shingles that come first in each text: n has n - ceil(similarity n) + 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2), SPAN_BYTES):
                row, value = _shingle_sets(data, offsets, size)
                n = np.bincount(row, minlength=b - a)
                order = np.lexsort((value, levels[(value & np.uint64(SKETCH - 1)).astype(np.int64)], row))
                row, value = row[order], value[order]
                rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                first = rank < (n - np.ceil(similarity * n - 1e-6) + 1)[row]
                row, value, rank = row[first], value[first], rank[first]
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[row].astype(np.int32)), pa.array(rank.astype(np.int32))], ["shingle", "class", "root", "n", "rank"])

    kind = texts.schema["class"].dataType.simpleString()
    return texts.select("class", "root", "text").mapInArrow(run, f"shingle bigint, class {kind}, root {kind}, n int, rank int")


def prefix_pairs(entries: DataFrame, similarity: float, work: Work) -> DataFrame:
    """All pairs (a, b, a_root, b_root) of classes with different roots that may have the similarity, by common prefixes.

    Sets of n and m shingles with the similarity have at least s / (1 + s) (n + m) in common, so their first common
    shingle comes before what either can miss; in one of the two it is among the first (1 - s) / (1 + s) of the set
    (slim). Only rows of which one is slim and one is not of the shingle's most frequent root are joined: classes that
    are linked already are not compared, nor are texts that only end alike. A shingle of over PART_ROWS classes is
    compared in pairs of parts, each a key of its own, so no task has all of it.
    """
    share = similarity / (1 + similarity)
    groups = entries.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("rows")).filter("least <> most")
    groups = work.save(groups.select("shingle", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")), "groups")
    key = F.xxhash64("shingle")
    met = entries.withColumn("k", key).join(groups.withColumn("k", key), ["k", "shingle"])
    slim = F.col("rank") <= F.col("n") * (1 - 2 * share) + 1e-5
    met = work.save(met.select("shingle", "class", "root", "n", "rank", "parts", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"), slim.alias("slim")), "met")
    by_root = met.groupBy("shingle", "root").count()
    major = work.save(by_root.groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("major")), "major")
    dealt = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    kinds = F.explode(F.when(F.col("slim"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("kind")
    minor = met.withColumn("k", key).join(major.withColumn("k", key), ["k", "shingle"]).filter("root <> major")
    left = minor.select("*", kinds).select("shingle", "kind", F.col("part").alias("lo"), dealt, *[F.col(c).alias(f"x_{c}") for c in ("class", "root", "n", "rank")]).withColumnRenamed("other", "hi")
    right = met.select("shingle", F.col("slim").alias("kind"), F.col("part").alias("hi"), dealt, *[F.col(c).alias(f"y_{c}") for c in ("class", "root", "n", "rank")]).withColumnRenamed("other", "lo")
    both = left.join(right, ["shingle", "kind", "lo", "hi"]).filter("x_root <> y_root")
    least = F.ceil(share * (F.col("x_n") + F.col("y_n")) - 1e-6)
    both = both.filter((F.col("x_rank") <= F.col("x_n") - least) & (F.col("y_rank") <= F.col("y_n") - least))
    swap = F.col("x_class") > F.col("y_class")
    side = lambda c, one, two: F.when(swap, F.col(f"{one}_{c}")).otherwise(F.col(f"{two}_{c}"))
    return both.select(side("class", "y", "x").alias("a"), side("class", "x", "y").alias("b"), side("root", "y", "x").alias("a_root"), side("root", "x", "y").alias("b_root")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, seeds: tuple[int, ...] = TABLE_SEEDS, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) of every document with an id: the smallest doc_id of its group of copies and near copies.

    Pairs that meet in a ball are compared by exact Jaccard similarity: first each class with its least partner, then
    what the links so found leave in different components. Then every pair of classes of different components that the
    prefix filter cannot rule out is compared, so that no pair is lost. Tables are deleted as soon as no step needs them.
    """
    work = Work(docs.sparkSession, "near-duplicates")
    named = docs.select("doc_id", "text").filter("doc_id is not null")
    told = work.save(signatures(named, size, seeds), "signatures")
    signed = told.filter("doc_id is not null")
    least = F.min(F.struct("doc_id", "near", "blocks")).alias("least")
    same = work.save(signed.groupBy("h1", "h2").agg(least).select("h1", "h2", F.col("least.doc_id").alias("class"), "least.near", "least.blocks"), "same")
    pairs = work.save(ball_pairs(same, work, radius), "pairs")
    links = work.save(alike(pairs.groupBy("b").agg(F.min("a").alias("a")), named, size, similarity), "first")
    root = components(links, work, "balls")
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    more = work.save(pairs.filter("a_root <> b_root").select("a", "b"), "open")
    links = work.save(links.unionAll(work.save(alike(more, named, size, similarity), "second")), "links")
    root = components(links, work, "linked").withColumnRenamed("node", "class")
    classes = work.save(same.select("class").join(root, "class", "left").withColumn("root", F.coalesce("root", "class")), "classes")
    levels = frequency(told.filter("doc_id is null").select("heavy"))
    work.keep("signatures", "same", "classes")
    texts = named.join(few(classes.withColumnRenamed("class", "doc_id")), "doc_id").withColumnRenamed("doc_id", "class")
    entries = work.save(prefixes(texts, size, similarity, levels), "entries")
    rest = work.save(prefix_pairs(entries, similarity, work), "rest")
    work.keep("signatures", "same", "classes", "rest")
    found = alike(rest.select("a", "b"), named, size, similarity).join(rest, ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    final = components(work.save(found, "found"), work, "all").select(F.col("node").alias("root"), F.col("root").alias("component_id"))
    of_class = classes.join(final, "root", "left").select("class", F.coalesce("component_id", "root").alias("component_id"))
    of_class = same.select("h1", "h2", "class").join(of_class, "class").select("h1", "h2", "component_id")
    out = work.save(signed.select("doc_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("doc_id", "component_id"), "components")
    work.keep("components")
    return out


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without their copies and near copies: of each group the one with the smallest doc_id stays."""
    work = Work(docs.sparkSession, "copies")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = work.save(repeated, "repeated")
    if not repeated.isEmpty():  # of the rows of one id the first by the digest of its text stays; equal rows are one
        ids, row = few(repeated), unused("row", docs.columns)
        named = docs.filter("doc_id is not null")
        several = named.join(ids, "doc_id", "left_semi").select(docs.columns)
        first = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull())).alias(row)).select(f"{row}.*")
        docs = docs.filter("doc_id is null").unionAll(named.join(ids, "doc_id", "left_anti").select(docs.columns)).unionAll(first)
    gone = work.save(near_duplicates(docs, size, similarity).filter("doc_id <> component_id").select("doc_id"), "gone")
    return docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
