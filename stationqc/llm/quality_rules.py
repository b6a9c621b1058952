"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one failure bit a rule; policies are
versioned masks over those bits, so a policy can be changed, compared or ablated without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused, without, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"

#: name -> failure as a function of the measurements, all whole numbers; the position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "10 * n_bangs > n_words",
    "capitals": "10 * n_upper > 3 * word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2",  # a line or two said twice in a short text is no defect
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 20 * n_words",
    "many_words": "n_words > 100000",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs", "n_upper")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules that reject."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
#: ``many_words`` is measured but doesn't reject: long documents are wanted.
STRICT = Policy("strict", 2, tuple(r for r in RULES if r != "many_words"))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared as strings."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("g"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["g"] == F.get(s, b)["g"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | ((j > 0) & F.coalesce(same(j - 1, j), F.lit(False))))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    none = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
    found = F.aggregate(let(F.sort_array(windows), twice), none, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(w) >= 3, found).otherwise(0)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the measurements of MEASURES (long) and fail_bits (long).

    A null text measures like an empty one: no words, so ``few_words`` fails.  Lines are counted if they hold a word.
    Rows are judged alone, so repeated rows get the same bits and an empty table an empty ledger.  Texts of any length
    are measured whole.  Input columns named like a measurement or a verdict give way; all others pass through.
    """
    docs = without(docs, *MEASURES, "fail_bits", "base_failed", "kept", "policy", "policy_version")
    whole, w, lines, m = unused(docs, "__text", "__w", "__lines", "__m")
    text = F.col(whole)
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    read = docs.withColumn(whole, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).withColumn(w, words(text))
    read = read.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": less(SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(F.col(w)),
        "n_bangs": less("!"),
        "n_upper": less(UPPER),
    }
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # Exploding one struct keeps a later filter from being pushed down, which would measure anew wherever a rule reads a measurement.
    once = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])))
    measured = read.select(*cols, once.alias(m)).select(*cols, f"{m}.*")
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def fails(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger plus base_failed, kept, policy and policy_version."""
    base = fails(BASE)
    return book.withColumns({"base_failed": base, "kept": ~base & ~fails(policy), "policy": F.lit(policy.name), "policy_version": F.lit(policy.version).cast("long")})


def ablation(book: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """For each rule of ``policy``: rows that fail it, and rows that only it rejects, which come back without it.

    One aggregation over the ledger to distinct bit patterns (at most two to the number of rules), then bit arithmetic.
    """
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(F.lit(0))).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(F.lit(0))).alias("n_regained"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps; same columns."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__body"))
    return apply_policy(ledger(named, "__body"), policy).where("kept").select("__row.*")


#: DuckDB SQL for the measurements; ``ledger`` is one row per document.
LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {table}),
w AS (SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, pos, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n >= 2),
c AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT rid, pos FROM r UNION SELECT rid, pos + 1 FROM r UNION SELECT rid, pos + 2 FROM r) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(text) - length(replace(text, '!', '')) AS n_bangs,
      length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
      FROM d LEFT JOIN s USING (rid) LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)),
ledger AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
""".replace("{bits}", " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())))
