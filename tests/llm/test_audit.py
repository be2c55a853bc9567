"""Audits of a corpus against brute force: alignment of tokenizers, divergence of sources, secrets."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import alignment, divergence, q_audit, secrets
from tidewake.llm.bpe import byte_alphabet
from tidewake.llm.common import table

ALPHABET = secrets.CLASSES[0].alphabet
RULES = [("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute_spans(text):
    text, out = text or "", []
    for k, (name, pattern, group, least) in enumerate(RULES):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(text) if len(m[group]) >= least]
    for k, c in enumerate(secrets.CLASSES, len(RULES)):
        hits, term = [], secrets.terms(c.width)
        for m in re.finditer("[" + re.escape(c.alphabet) + "]+", text):
            if len(m[0]) < c.width or any(re.search(p, m[0]) for p in secrets.ALLOWED):
                continue
            for i in range(len(m[0]) - c.width + 1):
                window, a = m[0][i : i + c.width], m.start() + i
                if sum(term[window.count(x)] for x in set(window)) <= secrets.most(c):
                    if hits and a <= hits[-1][1]:
                        hits[-1][1] = a + c.width
                    else:
                        hits.append([a, a + c.width])
        out += [(a, k, b, c.kind) for a, b in hits]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(out))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "TOKEN", "Api_key", '"', " ", ":", "=", "'", "é", "😀", "AKIA", "abc", "0", "f", "deadbeef", "\n", "token: ab", "password: token : abcdefgh", "K", "secret="]
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    texts = [None, "", "x" * 5000, "é" + some(ALPHABET, 5000) + " " + some("ABCDEF01234567", 3000), "a1" * 1500 + some(ALPHABET, 600) + "b2" * 1500]
    texts += ["".join(rng.choice(bits) if rng.random() < 0.7 else some(ALPHABET if rng.random() < 0.5 else "abcdef0123456789", rng.choice([3, 10, 22, 30, 60])) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("secrets", F.lit(1)).withColumn("whole", F.lit(2))
    found = secrets.scan(docs)
    assert found.columns == [*docs.columns, "_secrets"]
    got = {r.doc_id: r.x for r in found.select("doc_id", secrets.written(F.col("_secrets")).alias("x")).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(texts)}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_allow_list_keeps_words_and_uuids_out(spark):
    lines = ["Internationalization-and-localization_of_Words", "123e4567-e89b-12d3-a456-426614174000", "0123456789abcdefABCDEFGH", "zX9qT2vLr8KpW4mYc7Bd", None]
    got = [[s.kind for s in r.secrets] for r in secrets.scan(spark.createDataFrame([(x,) for x in lines], "text string")).collect()]
    assert got == [[], [], [], ["entropy_base64"], []]


def test_odd_documents_have_secrets(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = q_audit.op13_secrets(spark, str(tmp_path)).collect()
    want = sorted((str(r.doc_id), brute_spans(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.spans) for r in got) == want
    assert secrets.scan(odd.filter("false")).count() == 0


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(docs, least=3, most=200):
    """(lang, source, part, item, value, rank) of (text, lang, source), by whole numbers of any size."""
    seen, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sources[lang or ""].add(source or "")
        seen[lang or ""].update(set(found))
        count[lang or "", source or ""].update(found)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        p = {s: [1 + 10**9 * (count[lang, s][t] + 1) // (sum(count[lang, s][k] for k in kept) + len(kept)) for t in kept] for s in names}
        every = sum((count[lang, s] for s in names), Counter())
        q = [1 + 10**9 * (every[t] + 1) // (sum(every[k] for k in kept) + len(kept)) for t in kept]
        for s in names:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in names if o != s]
            words = [((a - b) ** 2 // b, t) for a, b, t in zip(p[s], q, kept) if count[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", words)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < most]
    return sorted(out)


def test_divergence_equals_brute_force_in_any_blocks(spark):
    rng = random.Random(7)
    words = ["a", "B", "ab", "longerthaneight", "longerthaneighteen", "longerthaneighteens", "été", "ÉTÉ", "漢字", "x1y", "don't", "_z_", "\x00n", "w" * 70] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) if rng.random() < 0.9 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", "s5", None])) for _ in range(300)]
    rows += [("lonely", "fr", "s1"), ("only", "fr", "s2"), (None, "it", "s9")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(None).cast("bigint"))
    want = brute_audit(rows, most=10)
    for slice_bytes, part_rows, block in ((1 << 23, 50_000, 512), (64, 1, 2)):
        assert sorted(map(tuple, divergence.audit(docs, 3, 10, slice_bytes, part_rows, block).collect())) == want
    assert divergence.audit(docs.filter("false")).count() == 0


def test_pointers_sort_by_group_and_term():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)) + " " + "q" * rng.choice([7, 8, 9, 3000]) for _ in range(20)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    starts, ends = divergence.terms(data, offsets)
    group = np.array([rng.randint(0, 2) for _ in starts])
    order, fresh = divergence.pointer_sort(data, starts, ends, group)
    key = [(group[k], data[starts[k] : ends[k]].tobytes()) for k in range(len(starts))]
    assert order.tolist() == sorted(range(len(starts)), key=lambda k: (key[k], k))
    assert fresh.tolist() == [k == 0 or key[order[k]] != key[order[k - 1]] for k in range(len(order))]


def test_shares_hold_large_totals():
    count, total = np.array([0, 5, 8 * 10**15 - 1]), np.array([8 * 10**15 + 7, 3 * 10**15, 8 * 10**15])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(count.tolist(), total.tolist())]


@pytest.fixture(scope="module")
def aligned(vocabulary):
    """Slices of a text by both libraries, through dictionaries of ends."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one, two, alphabet = Tokenizer.from_file(vocabulary), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_alphabet()
    one.encode_special_tokens = True

    def slices(text):
        if not text:
            return 0, 0, []
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        parts = [[bytes(alphabet[c] for c in one.id_to_token(i)) for i in a], [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return 0, 0, []
        ends = [{n: k + 1 for k, n in enumerate(np.cumsum([len(x) for x in p]).tolist())} for p in parts]
        out, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            out.append((a[i : ends[0][end]], b[j : ends[1][end]]))
            i, j = ends[0][end], ends[1][end]
        return len(a), len(b), out

    return slices


def brute_alignment(found):
    """Rows of the slices of all documents."""
    count, highest = Counter(), Counter()
    for _, _, slices in found:
        count.update({(x, y) for a, b in slices for x in a for y in b})
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    for n_a, n_b, slices in found:
        links = [(x, y) for a, b in slices for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in slices)
        yield n_a, n_b, len(slices), len(links), sum(count[x] == highest[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if slices else ""


ODD_TEXTS = [None, "", " ", "  ", "a", "a ", "\x00x", "x▁y", "x▁ y", "<|endoftext|> <s>x</s>", "漢字 かな 😀\n\n\n" * 20, "aaaa" * 3000, "tab\tx  y   z", "naïve é", "zzzzz" * 2000, " lead", "a\r\nb", "ﬁ"]


@pytest.mark.parametrize("bounds", [{}, {"most_pairs": 500, "held": 100}, {"most_pairs": 0}])
def test_alignment_equals_brute_force(spark, vocabulary, aligned, bounds):
    import public_tokenizers

    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()][:80] + [(None, t) for t in ODD_TEXTS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("x")).repartition(3)
    want = sorted((str(d), *x) for (d, _), x in zip(rows, brute_alignment([aligned(t) for _, t in rows])))
    got = alignment.align(docs, vocabulary, public_tokenizers.path("piece_bpe_32k.model"), **bounds)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_alignment_of_no_documents(spark, vocabulary):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(docs, vocabulary, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_long_slices_count_links_once():
    a, b = np.array([5, 5, 6, 5] * 5), np.array([9, 8] * 5)  # one slice of 20 by 10 tokens
    sizes = np.ones(10, np.int64), np.full(10, 2, np.int64)
    s = alignment.Slices(a, np.array([0, 20]), b, np.array([0, 10]), *sizes)
    assert s.n_a.sum() == 20 and len(s.n_a) == 10
    whole = alignment.Slices(a, np.array([0, 20]), b[:2], np.array([0, 2]), sizes[0], np.full(10, 10, np.int64))
    whole.n_a, whole.n_b, whole.a_first, whole.b_first, whole.doc = (np.array([x]) for x in (20, 10, 0, 0, 0))
    whole.b = b
    doc, pair, n = whole.links()
    assert dict(zip(pair.tolist(), n.tolist())) == {x << 16 | y: 5 * 5 * (3 if x == 5 else 1) for x in (5, 6) for y in (8, 9)} and not doc.any()
