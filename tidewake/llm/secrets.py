"""Secret scans: rules for known forms, and sliding-window Shannon entropy per character class, as columns only.

Rules have names and patterns; a rule's matches are leftmost and do not overlap, and those whose value is too short are
dropped after that. A class of characters has a window: in every run of the class's characters a window slides by one
sign at a time, with the counts of the signs in it. A sign that comes in or goes out changes one count and therefore one
term of sum(c log2 c), which is kept as a whole number (LOG_UNIT a unit), so nothing drifts. Windows of at least the
class's entropy that touch become one span, unless an allow-listed pattern describes the whole run.

All of it is Spark functions over one row: no shuffle, no Python. Offsets are running sums of the lengths of matches and of
the pieces between them, made by doubling; runs are cut into blocks that carry the end of the block before, so work grows
with the text and not with its square.

Cases: a null or empty text has no spans; repeated rows are scanned each on its own; a run as long as the text is cut into
blocks and joined again; equal starts are ordered by kind; offsets are code points, ends exclusive; a rule's span is its
whole match; an empty table gives no rows; columns of any name pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import unused


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern, of which the group's value must have `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


@dataclass(frozen=True)
class CharClass:
    """Runs of an alphabet whose windows of `width` signs have an entropy of `bits` at least."""

    kind: str
    alphabet: str
    width: int
    bits: float


LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Random text of 20 signs of the long alphabet has some 4.0 bits and words of it 3.4 at most; of 24 hexadecimal digits 3.5.
CLASSES = (CharClass("entropy_base64", LETTERS + DIGITS + "+/_=-", 20, 3.75), CharClass("entropy_hex", DIGITS + "ABCDEFabcdef", 24, 3.1))
#: Runs that these patterns describe as a whole are no secrets: words with separators, numbers, UUIDs, sequences, examples.
ALLOWED = (
    "^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+))*[-_/=+]*$",
    "^[0-9+/_=-]+$",
    "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^.*(?i:0123456789|abcdefghij|qwertyuiop|example).*$",
)
#: Units in which c log2 c is kept.
LOG_UNIT = 1 << 16
#: Signs of a run that one fold takes.
BLOCK = 1024


def terms(width: int) -> list[int]:
    """c log2 c of the counts 0 .. width, in whole units."""
    return [round(c * math.log2(c) * LOG_UNIT) if c else 0 for c in range(width + 1)]


def most(kind: CharClass) -> int:
    """The greatest sum of terms with which a window still has the class's entropy."""
    return math.floor((math.log2(kind.width) - kind.bits) * kind.width * LOG_UNIT)


def pattern_of(kind: CharClass) -> str:
    """Runs of the class that have a window at least."""
    return "[" + "".join(f"\\{c}" if c in "\\]^-" else c for c in kind.alphabet) + f"]{{{kind.width},}}"


def running(values: Column) -> Column:
    """Sums up to each value of an array of bigint, by doubling the reach of each sum."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def wider(sums: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        behind = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.least(reach, F.size(sums))), F.slice(sums, F.lit(1), F.greatest(F.size(sums) - reach, F.lit(0))))
        return F.zip_with(sums, behind, lambda x, y: x + y)

    return F.aggregate(rounds, values, wider)


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pattern's matches in a text, and the pieces between them, which end with what follows the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.split(text, pattern, -1)


def placed(found: Column, pieces: Column) -> Column:
    """Matches as (start, end, value): offsets are sums of the lengths before them."""
    ends = running(F.zip_with(pieces, found, lambda p, m: (F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0))).cast("bigint")))
    both = F.zip_with(found, F.slice(ends, F.lit(1), F.size(found)), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    return F.when(F.size(found) > 0, both).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def hot(block: Column, kind: CharClass) -> Column:
    """Spans (start, end) in one block of the windows with enough entropy, by counts that a sliding window changes."""
    width, size, limit = kind.width, len(kind.alphabet), most(kind)
    term = F.array(*[F.lit(t) for t in terms(width)])
    codes = F.transform(F.regexp_extract_all(block, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(kind.alphabet), c))
    before = F.slice(F.concat(F.array_repeat(F.lit(0), F.lit(width)), codes), F.lit(1), F.size(codes))
    moves = F.zip_with(codes, before, lambda i, o: F.struct(i.alias("i"), o.alias("o")))
    span = "struct<start:bigint,end:bigint>"
    begin = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).alias("sum"), F.lit(0).cast("bigint").alias("at"),
        F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.array().cast(f"array<{span}>").alias("out"),
    )

    def counted(s: Column, m: Column) -> Column:
        out = F.when(m["o"] > 0, F.get(s["counts"], m["o"] - 1)).otherwise(F.lit(0))
        into = F.get(s["counts"], m["i"] - 1) - F.when(m["i"] == m["o"], 1).otherwise(0)
        change = F.when(out > 0, F.get(term, out - 1) - F.get(term, out)).otherwise(0) + F.get(term, into + 1) - F.get(term, into)
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k + 1 == m["i"], 1).otherwise(0) - F.when(k + 1 == m["o"], 1).otherwise(0))
        return F.struct(counts.alias("counts"), (s["sum"] + change).alias("sum"), (s["at"] + 1).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["out"].alias("out"))

    def step(s: Column, m: Column) -> Column:
        one = F.transform(F.array(counted(s, m)), lambda n: spanned(n))
        return F.get(one, F.lit(0))

    def spanned(n: Column) -> Column:
        enough = (n["at"] >= width) & (n["sum"] <= limit)
        fresh = enough & ((n["start"] < 0) | (n["at"] - width > n["end"]))
        kept = F.when(fresh & (n["start"] >= 0), F.array_append(n["out"], F.struct(n["start"].alias("start"), n["end"].alias("end")))).otherwise(n["out"])
        return F.struct(n["counts"].alias("counts"), n["sum"].alias("sum"), n["at"].alias("at"), F.when(fresh, n["at"] - width).otherwise(n["start"]).alias("start"), F.when(enough, n["at"]).otherwise(n["end"]).alias("end"), kept.alias("out"))

    last = lambda s: F.when(s["start"] >= 0, F.array_append(s["out"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["out"])
    return F.aggregate(moves, begin, step, last)


def windows(runs: Column, kind: CharClass) -> Column:
    """Spans of the windows with enough entropy in runs (start, end, value), in order; those of blocks may touch."""

    def of_run(r: Column) -> Column:
        blocks = F.regexp_extract_all(r["value"], F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
        carried = F.zip_with(blocks, F.concat(F.array(F.lit("")), F.slice(blocks, F.lit(1), F.size(blocks) - 1)), lambda b, p: F.concat(F.right(p, F.lit(kind.width - 1)), b))
        at = lambda k: r["start"] + k * BLOCK - F.when(k > 0, kind.width - 1).otherwise(0)
        return F.flatten(F.transform(carried, lambda b, k: F.transform(hot(b, kind), lambda s: F.struct((s["start"] + at(k)).alias("start"), (s["end"] + at(k)).alias("end")))))

    return F.flatten(F.transform(runs, of_run))


def joined(spans: Column) -> Column:
    """Spans in order, those that touch as one."""
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    n = F.size(spans)
    before = F.concat(F.array(none), F.slice(spans, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(spans, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(none))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    apart = lambda p, q: q.isNull() | (p["start"] > q["end"])
    starts = F.transform(F.filter(F.zip_with(spans, before, pair), lambda p: apart(p["x"], p["y"])), lambda p: p["x"]["start"])
    ends = F.transform(F.filter(F.zip_with(spans, after, pair), lambda p: p["y"].isNull() | (p["y"]["start"] > p["x"]["end"])), lambda p: p["x"]["end"])
    whole = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _kept(found: Column, rank: int, rule: Rule) -> Column:
    """The rule's matches whose value is long enough, as spans."""
    value = lambda m: F.regexp_extract(m["value"], rule.pattern, rule.group) if rule.group else m["value"]
    long = F.filter(found, lambda m: F.length(value(m)) >= rule.least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(rule.kind).alias("kind"), m["value"].alias("value")))


def _hot_spans(spans: Column, rank: int, kind: CharClass) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.kind).alias("kind"), none.alias("value")))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, name: str = "secrets") -> DataFrame:
    """The documents with a column of their spans (start, rank, end, kind, value), ordered by start and rank.

    Ranks are the places of the kinds, rules first and then classes; the value of an entropy span is null.
    """
    columns, kinds = docs.columns, [*[r.kind for r in rules], *[c.kind for c in classes]]
    made: list[str] = []

    def fresh(column: str) -> str:
        made.append(unused(column, columns + made))
        return made[-1]

    whole = fresh("whole")
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    patterns = [r.pattern for r in rules] + [pattern_of(c) for c in classes]
    found, at = [fresh(f"found_{k}") for k in range(len(kinds))], [fresh(f"at_{k}") for k in range(len(kinds))]
    out = out.withColumns({f: matches(F.col(whole), p)[0] for f, p in zip(found, patterns)})
    out = out.withColumns({a: placed(F.col(f), F.when(F.size(f) > 0, matches(F.col(whole), p)[1])) for a, f, p in zip(at, found, patterns)})
    parts = [_kept(F.col(at[k]), k, rule) for k, rule in enumerate(rules)]
    raw = {fresh(f"raw_{k}"): windows(F.filter(at[len(rules) + k], lambda m: ~allow(m["value"], allowed)), c) for k, c in enumerate(classes)}
    out = out.withColumns(raw)
    parts += [_hot_spans(joined(F.col(column)), k, c) for k, (column, c) in enumerate(zip(raw, classes), len(rules))]
    return out.withColumn(unused(name, columns + made), F.array_sort(F.concat(*parts))).drop(*made)


def allow(value: Column, allowed: tuple[str, ...]) -> Column:
    """Whether one of the patterns describes the value."""
    out = F.lit(False)
    for pattern in allowed:
        out = out | value.rlike(pattern)
    return out


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
