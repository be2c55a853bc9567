"""Divergence of sources by their terms: pointers to term starts, sorted per shard, whose equal runs give the counts.

A shard is a slice of an Arrow text column. Every start of a term in its buffer is a pointer; pointers are sorted by group
and then by a multikey quicksort whose characters are eight bytes: one sort by the first character of the suffix, and then
only within runs that are still equal and not at their term's end by the next. A run of equal pointers is a term of a
group: its length is the count, the documents that it passes through the document frequency. Spark adds up the shards.

A group is a language and a source. A term stays in its language if at least `least` documents have it. With V kept terms
and N of their occurrences, a count c has the share p = 1 + floor(UNIT (c + 1) / (N + V)), and p against q diverges by
floor((p - q)^2 / q); all numbers are whole. Pairs of sources are summed over all kept terms, in blocks of terms that Spark
deals out, with all sources of the language beside each block; the terms of a source are compared with the language's.

Cases: null text, language and source count as empty; rows are documents, whatever their ids; a group without terms has
counts of zero, and a language without kept terms pairs of value zero; ties are ordered by the item's UTF-8 bytes; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import Work, few, gather, text_bytes, text_chunks

UNIT = 1_000_000_000
#: Bytes of text whose pointers are sorted at a time.
SLICE_BYTES = 8 << 20
#: Rows of kept terms in one part of a language, or the number of its pairs of sources if that is more, as each part has a
#: sum for each pair; and sources whose pairs with all others one task sums.
PART_ROWS, BLOCK_SOURCES = 50_000, 512
#: Cells of sources by terms that are compared at a time.
CELLS = 1 << 18


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters A-Z, a-z and signs beyond ASCII in many texts."""
    inside = (data >= 0x80) | (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut], end[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers' order by (group, term), earlier ones first, and which of that order are the first of their term.

    Terms have no zero byte, so a term that ends within a character is padded with zeros and comes before longer ones.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    size, padded = ends - starts, np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))

    def character(who: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(size[who] - depth, 0, 8)
        drop = ((8 - np.maximum(left, 1)) * 8).astype(np.uint64)
        value = eight[np.minimum(starts[who] + depth, len(data))].astype(np.uint64)
        return np.where(left > 0, value >> drop << drop, np.uint64(0))

    first = character(np.arange(len(starts)), 0)
    order = np.argsort(first, kind="stable")
    order = order[np.argsort(group[order].astype(np.uint16 if group.max() < 1 << 16 else np.int64), kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (first[order[1:]] != first[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    depth, at, run = 8, np.arange(len(order)), np.cumsum(fresh) - 1
    while True:
        open_ = (np.bincount(run)[run] > 1) & (size[order[at]] >= depth)
        at, run = at[open_], run[open_]
        if not len(at):
            return order, fresh
        key = character(order[at], depth)
        within = np.lexsort((key, run))
        order[at], key = order[at[within]], key[within]
        new = np.ones(len(at), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        fresh[at] |= new
        run, depth = np.cumsum(new) - 1, depth + 8


def counted(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, source, term, n, docs) of the slices of the texts; one term of a group has a row for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).dictionary_encode() for k in (1, 2)]
            code = keys[0].indices.to_numpy().astype(np.int64) * max(1, len(keys[1].dictionary)) + keys[1].indices.to_numpy()
            groups, code = np.unique(code, return_inverse=True)
            for a, b, data, offsets in text_chunks(batch.column(0), slice_bytes):
                data = lower(data)
                starts, ends = terms(data, offsets)
                doc = np.searchsorted(offsets[1:], starts, "right")
                order, fresh = pointer_sort(data, starts, ends, code[a:b][doc])
                at = np.flatnonzero(fresh)
                n = np.diff(np.append(at, len(order)))
                other = fresh.copy()
                other[1:] |= doc[order[1:]] != doc[order[:-1]]
                seen = np.diff(np.append(0, np.cumsum(other))[np.append(at, len(order))])
                one = order[at]
                length = ends[one] - starts[one]
                where = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(gather(data, starts[one], length))))
                who = groups[code[a:b][doc[one]]] if len(one) else np.zeros(0, np.int64)
                lang, source = np.divmod(who, max(1, len(keys[1].dictionary)))
                yield pa.RecordBatch.from_arrays([keys[0].dictionary.take(pa.array(lang)), keys[1].dictionary.take(pa.array(source)), text, pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    return _named(docs).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT (count + 1) / total), in decimals that hold the product."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 1), wide(total))).cast("bigint")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of whole arrays, three digits at a time, so that totals of up to 9e15 do not overflow."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def kept_terms(docs: DataFrame, work: Work, least: int = 3, slice_bytes: int = SLICE_BYTES, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The kept terms' (lang, source, term, n, n_lang), and of every group (lang, source, total, sources, parts, place).

    total is N + V of the group, lang_total that of its language, place the source's number among its language's.
    """
    counts = work.save(counted(docs, slice_bytes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"seen": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source"))})
    kept = work.save(kept.filter(F.col("seen") >= least).select("lang", "source", "term", "n", "n_lang", (F.col("first") == 1).cast("bigint").alias("first")), "kept")
    work.drop("counts")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"), F.count("*").alias("rows"))
    groups = _named(docs).select("lang", "source").distinct().join(of_group, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    sums = {"all": F.sum("n").over(lang), "kinds": F.sum("v").over(lang), "sources": F.count("*").over(lang), "rows": F.sum("rows").over(lang), "place": F.row_number().over(lang.orderBy("source")) - 1}
    groups = groups.fillna(0, ["n", "v", "rows"]).withColumns(sums)
    groups = groups.select("lang", "source", (F.col("n") + F.col("kinds")).alias("total"), (F.col("all") + F.col("kinds")).alias("lang_total"), "kinds", "sources", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.greatest(F.lit(part_rows), F.col("sources") * F.col("sources")))).cast("int").alias("parts"), "place")
    return kept, work.save(groups, "groups")


def term_values(kept: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """The terms of each group that have a greater share than in their language: the first `most` by their divergence."""
    met = kept.join(few(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("n_lang"), F.col("lang_total")).alias("q"))
    met = met.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def pair_values(kept: DataFrame, groups: DataFrame, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """The divergence of each source from each other one of its language, over all kept terms."""

    def sums(terms_: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("place")
        names, total, block = sources["source"], sources["total"].to_numpy(), sources["block"][0].as_py()
        mine = np.arange(block * block_sources, min((block + 1) * block_sources, len(total)))
        out = np.zeros((len(mine), len(total)), np.int64)
        if terms_.num_rows:
            coded = terms_["term"].combine_chunks().dictionary_encode()
            term, count = coded.indices.to_numpy(), len(coded.dictionary)
            source, n = pc.index_in(terms_["source"], value_set=names.combine_chunks()).to_numpy(), terms_["n"].to_numpy()
            order = np.argsort(term, kind="stable")
            term, source, p = term[order], source[order], shares(n[order], total[source[order]])
            none, width = shares(np.zeros(len(total), np.int64), total), max(1, CELLS // len(total))
            for a in range(0, count, width):
                b = min(a + width, count)
                x, y = np.searchsorted(term, (a, b))
                cells = np.repeat(none[:, None], b - a, axis=1)
                cells[source[x:y], term[x:y] - a] = p[x:y]
                for k, i in enumerate(mine.tolist()):
                    away = cells[i] - cells
                    out[k] += (away * away // cells).sum(axis=1)
        one, two = np.divmod(np.arange(out.size), len(total))
        other = mine[one] != two
        one, two = mine[one[other]], two[other]
        return pa.table({"lang": sources["lang"].take(pa.array(one)), "source": names.take(pa.array(one)), "item": names.take(pa.array(two)), "value": pa.array(out.ravel()[other])})

    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("sources") / block_sources).cast("int") - 1)).alias("block")
    sizes = groups.filter("place = 0").select("lang", "sources", "parts")
    left = kept.join(few(sizes), "lang").select("lang", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), blocks, "source", "term", "n")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "source", "total", "place", "sources").select("lang", "part", blocks, "source", "total", "place")
    key = ["lang", "part", "block"]
    summed = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(sums, "lang string, source string, item string, value bigint")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = 3, most: int = 200, slice_bytes: int = SLICE_BYTES, part_rows: int = PART_ROWS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from the others, and its terms that stand out."""
    work = Work(docs.sparkSession, "divergence")
    kept, groups = kept_terms(docs, work, least, slice_bytes, part_rows)
    parts = [("pair", pair_values(kept, groups, block_sources)), ("term", term_values(kept, groups, most))]
    named = [p.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, p in parts]
    return named[0].unionAll(named[1])
