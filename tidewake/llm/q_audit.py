"""Queries that audit a corpus: alignment of tokenizers, divergence of sources, secrets."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import alignment, divergence, secrets
from tidewake.llm.common import table


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.RULES))
    counts = [F.size(F.filter("secrets", _of_kind(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _secrets_sql() -> str:
    """The same spans from windows that are counted anew one by one."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = "password|passwd|secret|token|api_?key"
    either = lambda p: p.removeprefix("(?i)").replace(words, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words))
    kinds = [(r.kind, either(r.pattern), r.group, r.least, 0) for r in secrets.RULES]
    kinds += [(c.kind, secrets.pattern_of(c), 0, c.width, c.width) for c in secrets.CLASSES]
    runs = " UNION ALL ".join(
        f"SELECT row, {k} AS rank, '{kind}' AS kind, unnest(m) AS v, unnest(p[:len(m)]) AS piece, generate_subscripts(m, 1) AS i, {group} AS grp, {least} AS least, {width} AS width, {quoted(pattern)} AS pattern FROM (SELECT row, regexp_extract_all(t, {quoted(pattern)}) AS m, string_split_regex(t, {quoted(pattern)}) AS p FROM d)"
        for k, (kind, pattern, group, least, width) in enumerate(kinds)
    )
    # the pattern and the group of a regular expression are constants in DuckDB
    assign = next(p for k, p, g, _, _ in kinds if g)
    allowed = " OR ".join(f"regexp_matches(v, {quoted(p)})" for p in secrets.ALLOWED)
    limits = " ".join(f"WHEN '{c.kind}' THEN {secrets.most(c)}" for c in secrets.CLASSES)
    terms = secrets.terms(max(c.width for c in secrets.CLASSES))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        runs AS ({runs}),
        placed AS (SELECT row, rank, kind, v, width, CASE WHEN grp > 0 THEN length(regexp_extract(v, {quoted(assign)}, 2)) ELSE length(v) END >= least AS long,
                          sum(length(piece) + length(v)) OVER (PARTITION BY row, rank ORDER BY i) AS stop FROM runs),
        base AS (SELECT row, rank, kind, stop - length(v) AS start, stop FROM placed WHERE width = 0 AND long),
        slid AS (SELECT row, rank, kind, width, start + j AS start, string_split(substr(v, CAST(j + 1 AS BIGINT), width), '') AS w
                 FROM (SELECT row, rank, kind, width, v, stop - length(v) AS start, unnest(range(length(v) - width + 1)) AS j FROM placed WHERE width > 0 AND NOT ({allowed}))),
        hot AS (SELECT row, rank, kind, start, start + width AS stop FROM slid
                WHERE list_sum(list_transform(list_distinct(w), lambda c: {terms}[len(list_filter(w, lambda x: x = c)) + 1])) <= CASE kind {limits} END),
        islands AS (SELECT *, sum(fresh) OVER (PARTITION BY row, rank ORDER BY start) AS island
                    FROM (SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY row, rank ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM hot)),
        every AS (SELECT row, rank, kind, start, stop FROM base UNION ALL SELECT row, rank, kind, min(start), max(stop) FROM islands GROUP BY row, rank, kind, island),
        told AS (SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
                        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < {len(secrets.RULES)}) AS b,
                        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS s FROM every GROUP BY row)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
        FROM d LEFT JOIN told USING (row)"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, most=200)


DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    langs AS (SELECT lang, count(term) AS v, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
    groups AS (SELECT lang, source, v, CAST(coalesce(m, 0) AS HUGEINT) + v AS total, langs.n + v AS lang_total
               FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS m FROM counts GROUP BY lang, source) USING (lang, source)),
    cells AS (SELECT lang, source, term, coalesce(counts.n, 0) AS c, 1 + (1000000000 * (CAST(coalesce(counts.n, 0) AS HUGEINT) + 1)) // total AS p,
                     1 + (1000000000 * (CAST(kept.n AS HUGEINT) + 1)) // lang_total AS q
              FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
              FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
              FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM cells WHERE c > 0 AND p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= 200"""

QUERIES = {"op11_alignment": op11_alignment, "op12_divergence": op12_divergence, "op13_secrets": op13_secrets}
ORACLE_SQL = {"op12_divergence": DIVERGENCE_SQL, "op13_secrets": _secrets_sql()}
