"""SimHash classes, near duplicates and repeated windows against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewake.llm import graph, q_duplicates, recompression, simhash
from tidewake.llm.common import Work, table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text, size=3):
    w = WORD.findall(lowered(text))
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, value = list(fps), np.array(list(fps.values()), np.uint64)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(value ^ value[k]) <= 2):
            a, b = find(d), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def test_classes_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    roots = brute_components(fps)
    got = q_duplicates.op9_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", roots[d]) for d, f in fps.items()}


def test_odd_documents_have_fingerprints(spark, odd):
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.similar_classes(odd).collect()}
    want = {r.doc_id: brute_fingerprint(r.text) for r in odd.collect()}
    assert {(d, f) for d, f, _ in got} == set(want.items())
    by = {d: c for d, _, c in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[9] == by[10] == 9
    assert simhash.similar_classes(odd.filter("false")).count() == 0


def test_links_reach_fingerprints_that_differ_by_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_ = {x for b in base for x in (b, b ^ 1 << rng.randrange(64), b ^ 1 << rng.randrange(64) ^ 1 << 63, b ^ 7)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in all_]
    work = Work(spark, "t")
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    roots = {r.node: r.root for r in graph.components(found, work).collect()}
    want = brute_components({x if x < 1 << 63 else x - (1 << 64): x for x in sorted(all_, key=lambda x: x if x < 1 << 63 else x - (1 << 64))})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {g for g in groups(want) if len(g) > 1} == groups(roots)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp bigint"), radius=3)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(59, 3), (200, 200)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Work(spark, "t")).collect()}
    assert all(roots[k] == 100 for k in range(100, 161)) and all(roots[k] == 3 for k in [3, *range(5, 60)]) and 200 not in roots


def test_near_duplicates_find_planted_copies(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows, group = [], {}
    for g in range(30):
        text = [word() for _ in range(rng.randint(60, 400))]
        for c in range(4):
            copy = list(text)
            for k in rng.sample(range(len(copy)), len(copy) // 60 * (c > 1)):
                copy[k] = word()
            rows.append((4 * g + c, " ".join(copy).upper() if c == 1 else " ".join(copy)))
            group[4 * g + c] = g
    rows += [(1000 + k, " ".join(word() for _ in range(100))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("x"))
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = {d: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for d, t in rows for w in [t.lower().split()]}
    for a in group:
        for b in range(4 * group[a], a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert roots[a] == roots[b]
    assert all(roots[d] == d for d, _ in rows if d >= 1000) and all(roots[a] // 4 == group[a] for a in group)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in roots.items() if d == r}


def roots_by_brute_force(rows):
    """The least id that links of Jaccard similarity 0.8 over five-word shingles reach, for each id."""
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_crowded_balls_lose_no_pair(spark, monkeypatch):
    """Texts of the same words in other orders share all fingerprints; only some, far apart by id, are near copies."""
    monkeypatch.setattr(simhash, "PART_ROWS", 3, raising=False)
    rng = random.Random(5)
    rows = []
    for k in range(40):
        text = [f"w{x}" for x in rng.sample(range(120), 120)]
        rows.append((k, " ".join(text)))
        text[40], text[41] = text[41], text[40]
        rows.append((100 + 7 * k % 40, " ".join(text)))
    rows += [(200 + k, " ".join([f"s{x}" for x in range(6)] + [f"u{k}-{x}" for x in range(9)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = roots_by_brute_force(rows)
    assert got == want and sum(d != r for d, r in want.items()) == 40


def test_a_third_of_all_rows_are_near_copies_of_one_text(spark, monkeypatch):
    """A crowded block is dealt into parts: the groups are those of brute force, and no key of a ball has the whole crowd."""
    monkeypatch.setattr(simhash, "PART_ROWS", 4)
    rng = random.Random(11)
    hot, rows = [f"h{x}" for x in range(200)], []
    for k in range(180):
        text = list(hot) if k % 3 == 0 else [f"t{k}-{x}" for x in range(60)]
        text[rng.randrange(len(text))] = f"own{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = roots_by_brute_force(rows)
    assert got == want and sum(d != r for d, r in want.items()) == 59
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {d for d, r in want.items() if d == r}
    least = F.min(F.struct("doc_id", "near", "blocks")).alias("least")
    same = simhash.signatures(docs, 5, simhash.TABLE_SEEDS).filter("doc_id is not null").groupBy("h1", "h2").agg(least).select(F.col("least.doc_id").alias("class"), "least.near", "least.blocks")
    pairs = simhash.ball_pairs(same, Work(spark, "crowd")).collect()
    hot_pairs = [r for r in pairs if r.a % 3 == 0 and r.b % 3 == 0]
    assert {r.b for r in hot_pairs} == {d for d, _ in rows if d % 3 == 0 and d > 0} and len(hot_pairs) < 60 * 59 / 4


def test_near_duplicates_find_appended_and_cut_blocks(spark):
    """Texts of distinct words, and copies with a block added or missing at similarities from 0.80 to 0.90."""
    rng = random.Random(9)
    rows = []
    for g in range(60):
        n = rng.randint(100, 400)
        share = (0.81, 0.85, 0.89)[g % 3]
        text = [f"g{g}-{k}" for k in range(n)]
        cut = int((n - 4) * (1 - share))
        copy = [text[:-cut], text[cut:], text + [f"more{g}-{k}" for k in range(int((n - 4) * (1 / share - 1)))]][g // 3 % 3]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = roots_by_brute_force(rows)
    assert got == want and sum(d != r for d, r in want.items()) == 60


def test_keep_one_on_odd_documents(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, d) for d in (1, 4, 5, 7, 8, 9, 11)] + [(True, 0)]
    assert simhash.keep_one(odd.filter("false")).count() == 0


def thue_morse(a, b, n):
    """Sequences that collide in every polynomial hash modulo 2**64."""
    one, two = [a], [b]
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def test_colliding_words_and_word_sequences_stay_apart(spark):
    one, two = ("".join(x) for x in thue_morse("a", "b", 2048))
    docs = spark.createDataFrame([(1, f"{one} " + " ".join(f"x{k}" for k in range(30))), (2, two), (3, " ".join(thue_morse("p", "q", 2048)[0])), (4, " ".join(thue_morse("p", "q", 2048)[1]))], "doc_id bigint, text string")
    assert {1, 2} <= {r.doc_id for r in simhash.keep_one(docs).collect()}
    words_ = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{one} {words_}"), (2, f"{two} {words_}")], "doc_id bigint, text string")
    assert all(not r.spans for r in recompression.marked(docs).collect())
    lone = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(lone).collect()} == {1: 1, 2: 2}


def brute_windows(docs, size=20):
    """[(doc_id, words, which go)]: each row is a document, in the order of ids, rows of one id by their texts' digests."""
    first, out = {}, []
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
    for at, (d, text) in enumerate(sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])))):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k : k + size]), (at, k)) != (at, k):
                gone[k : k + size] = [True] * size
        out.append((d, w, gone))
    return out


def shared_tables():
    """Rows without an id or with one id, with texts that repeat, that repeat nowhere, and that are shorter than others."""
    rng = random.Random(2)
    some = lambda n: " ".join(f"u{rng.random()}" for _ in range(n))
    a, b, short = some(60), some(60), some(30)
    yield [(1, a), (2, a), (2, b)]
    yield [(1, f"{a} {b}"), (None, f"x {a} y"), (None, some(60))]
    yield [(1, f"q {a}"), (2, f"x {a} y"), (2, "short text"), (2, None), (2, "")]
    yield [(1, a), (None, a), (None, b), (None, b), (None, f"{short} {b}"), (7, short), (7, f"{short} {a}"), (7, short)]
    pool = [some(25) for _ in range(12)]
    yield [(rng.choice([None, None, 1, 2, rng.randrange(50)]), " ".join(rng.choice(pool) for _ in range(rng.randrange(4)))) for _ in range(120)]


def test_rows_that_share_an_id_or_have_none_are_documents(spark, tmp_path):
    rows = [(d if d is None else 100 * k + d, t) for k, some in enumerate(shared_tables()) for d, t in some]  # texts differ from table to table
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS doc", "5 AS tie", "length(text) AS n_chars").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_windows(rows)
    kept = [(str(d), " ".join(x for x, g in zip(w, gone) if not g)) for d, w, gone in want]
    got = q_duplicates.op6_recompression(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.kept_sha256, r.n_removed) for r in got) == sorted((str(d), hashlib.sha256(k.encode()).hexdigest(), sum(gone)) for (d, k), (_, _, gone) in zip(kept, want))
    cut = recompression.without_repeats(docs, 20)
    assert cut.columns == docs.columns
    assert sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in cut.collect()) == sorted(kept)


def test_removed_words_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q_duplicates.op6_recompression(spark, SF).collect()}
    for d, w, gone in brute_windows(docs):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert got[d] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_small_alphabets_runs_and_overlaps(spark, letters):
    """Windows that overlap their own copy, long runs of one word, and texts that share passages at every place."""
    rng = random.Random(letters)
    rows = [(d, " ".join(chr(97 + rng.randrange(letters)) for _ in range(rng.randrange(70)))) for d in range(40)]
    passage = " ".join(chr(65 + rng.randrange(26)) + str(k) for k in range(33))
    rows += [(100 + d, f"{rows[d][1]} {passage} {rows[-d][1]}") for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.spans for r in recompression.marked(docs).collect()}
    for d, w, gone in brute_windows(rows):
        kept, n = recompression.kept_words(" ".join(w), [s.asDict() for s in got[d] or []], 20)
        assert (n, kept) == (len(w), [x.encode() for x, g in zip(w, gone) if not g]), d


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    for _ in range(20):
        letters = int(rng.integers(1, 6))
        texts = [" ".join(chr(97 + int(x)) for x in rng.integers(0, letters, rng.integers(0, 60))) for _ in range(30)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["doc_id", "text"])
        seen, covered = {}, 0
        for _, w in recompression.chunked([batch]):
            s, n, lo, hi = recompression.segments(w.names, w.ends, 7)
            for k in range(len(s)):
                for at in range(s[k], s[k] + n[k]):
                    value = (int(lo[k] - at), int(hi[k] - at))
                    assert seen.setdefault(tuple(w.names[at : at + 7].tolist()), value) == value
                    covered += 1
        assert covered == sum(max(0, len(t.split()) - 6) for t in texts)


def test_cut_texts_and_odd_documents(spark, odd):
    cut = recompression.without_repeats(odd)
    assert cut.columns == odd.columns
    rows = {r.doc_id: r for r in cut.collect()}
    before = {r.doc_id: r for r in odd.collect()}
    assert len(rows) == len(before) and rows[6].text == "" and rows[6].n_chars == 0
    for d in (1, 2, 3, 4, 7, 8, 9, 10, 11, None):
        assert rows[d].text == before[d].text
    assert len(rows[5].text.split()) < 40_000  # its own passages repeat
    passage = " ".join(f"p{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three\n{passage}  four five")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in recompression.without_repeats(docs).collect()} == {1: f"one {passage} two", 2: "three\nfour five"}
    assert recompression.marked(odd.filter("false")).count() == 0
