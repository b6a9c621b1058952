"""Language identification by Bayesian fusion of evidence.

For each row the posterior over the languages multiplies
* the likelihood of the text, from hashed byte trigrams (naive Bayes, trained here on a bounded sample of labelled rows),
* the likelihood of the declared markup language, from a confusion table counted over all rows,
* the likelihood of the address suffix, where it is a country's, and
* a host prior, smoothed hierarchically: host towards its domain, domain towards all rows.
A hypothesis more, 'unknown', says that the text is in none of the languages: its trigrams are uniform over the buckets.
Texts of another language or of random letters are likelier under it than under any language, and are not accepted.
The prior counts are the text posteriors of all rows, summed by grouped aggregation; a hot host is combined before any
shuffle.  Texts are read once by the scorer; everything after works on a few numbers a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_listed, stored

#: Languages that a country's suffix speaks for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
#: Probability that a country's suffix says its language, however the page reads.
SUFFIX_TRUST = 0.8
#: Prior probability that a text is in none of the labelled languages.
UNKNOWN = 0.01
#: Bytes that are scored at once.
STEP = 1 << 20
#: Tasks that count the training sample.
SAMPLE_TASKS = 8


@dataclass
class TrigramModel:
    languages: list[str]
    #: log-probability of each hashed trigram (row) in each language (column)
    table: np.ndarray

    def score(self, text: str | None) -> tuple[list[float], int]:
        """(mean log-likelihood per trigram in each language, number of trigrams with a letter)."""
        total, n = np.zeros(len(self.languages)), 0
        for h in hashed(text, len(self.table)):
            total += self.table[h].sum(axis=0)
            n += len(h)
        return ((total / n).tolist() if n else total.tolist()), n


def hashed(text: str | None, buckets: int):
    """Hashes of the byte trigrams of the lower-cased text, words set off by one space; those without a letter are left out."""
    data = " ".join(["", *(text or "").lower().split(), ""]).encode("utf-8", "replace")
    for at in range(0, max(0, len(data) - 2), STEP):
        b = np.frombuffer(data, np.uint8)[at : at + STEP + 2].astype(np.uint32)
        letter = (b >= 97) & (b <= 122) | (b >= 128)
        h = (b[:-2] * np.uint32(0x01000193) + b[1:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x85EBCA6B)) >> np.uint32(7)
        yield (h % np.uint32(buckets))[letter[:-2] | letter[1:-1] | letter[2:]]


def train(labelled: DataFrame, sample_rows: int = 8000, buckets: int = 1 << 14, most_languages: int = 64) -> TrigramModel:
    """A model from ``labelled`` (text, language): of the ``most_languages`` commonest languages, ties by name.

    ``sample_rows`` bounds the labelled rows that are read for it: rows are taken by a hash of their text, about that many
    whatever the size of the table, and a text that repeats counts once.  Without any labelled row the model knows no
    language, and nothing is identified.
    """
    rows = labelled.where("language IS NOT NULL AND text IS NOT NULL").select("text", F.col("language").cast("string").alias("language"))
    counted = rows.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(most_languages).collect()
    languages = sorted(r.language for r in counted)
    if not languages:
        return TrigramModel([], np.zeros((buckets, 0), np.float32))
    every = max(1, sum(r.n for r in counted) // sample_rows)
    chosen = rows.where(F.col("language").isin(languages) & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0)).distinct()

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(language, np.zeros(buckets, np.int64))
                for h in hashed(text, buckets):
                    own += np.bincount(h, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["language", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in parts["counts"])
        return pd.DataFrame({"language": [parts["language"].iloc[0]], "counts": [total.tobytes()]})

    # The sample is bounded, so few tasks count it; a table a language is all that the driver gets.
    parts = chosen.coalesce(SAMPLE_TASKS).mapInArrow(count, "language string, counts binary").groupBy("language").applyInPandas(add, "language string, counts binary")
    total = {r.language: np.frombuffer(r.counts, np.int64) for r in parts.collect()}
    counts = np.stack([total.get(x, np.zeros(buckets, np.int64)) for x in languages], axis=1) + 0.5
    return TrigramModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _normal(a: Column, unknown: Column) -> Column:
    """Log-weights to probabilities; what ``unknown``, the log-weight of no language, takes is missing from their sum."""
    top = F.greatest(F.array_max(a), unknown)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.exp(unknown - top), lambda s, y: s + y))


def identify(rows: DataFrame, model: TrigramModel, text_weight: float = 40.0, strength: float = 20.0, least: float = 0.6) -> DataFrame:
    """``rows`` (id, text, declared, host; others are ignored) to id, language, posterior, text_language, text_posterior, accepted.

    ``text_weight`` caps the trigrams that count as independent evidence; ``strength`` is how many rows a parent level
    weighs in a host's prior; a posterior under ``least`` is no identification.  Posteriors share one with that
    of 'unknown' (see above), so they are low where no language explains the text; the likeliest is named all the same.  A null or empty text has no likelihood,
    a null declaration or host no say.  A text without letters, or a model without languages, is not accepted, with a null
    language.  Ties go to the first language in alphabetical order.  One row comes out per row, repeated ones too.  Texts
    of any length are scored whole, in steps of ``STEP`` bytes.  An empty table gives an empty result.  A hot host is summed
    before the shuffle, and its rows meet the priors in a join that adaptive execution splits or broadcasts.
    """
    langs, spark = model.languages, rows.sparkSession
    if not langs:
        none = F.lit(None).cast
        return rows.select("id", none("string").alias("language"), none("double").alias("posterior"), none("string").alias("text_language"), none("double").alias("text_posterior"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            scores = [shared.value.score(x) for x in batch.column("text").to_pylist()]
            keep = [batch.column(c) for c in ("id", "declared", "host")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([s for s, _ in scores], pa.list_(pa.float64())), pa.array([n for _, n in scores], pa.int64())], names=["id", "declared", "host", "mean", "n"])

    given = rows.select("id", F.col("text").cast("string").alias("text"), F.lower(F.split(F.col("declared").cast("string"), "[-_]")[0]).alias("declared"), F.lower(F.col("host").cast("string")).alias("host"))
    scored = given.mapInArrow(score, f"id {given.schema['id'].dataType.simpleString()}, declared string, host string, mean array<double>, n long")
    loglik = F.transform("mean", lambda m: m * F.least(F.col("n").cast("double"), F.lit(text_weight)))
    # 'unknown' has flat evidence beside the text: the shares that it would have among even values
    nowhere = -float(np.log(len(model.table))) * F.least(F.col("n").cast("double"), F.lit(text_weight)) + float(np.log(UNKNOWN / (1 - UNKNOWN)))
    names = F.array(*map(F.lit, langs))
    said = F.when(F.col("declared").isNull() | (F.trim("declared") == ""), F.lit("-")).when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    kept = stored(
        scored.select("id", said.alias("declared"), "host", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1).alias("domain"), loglik.alias("ll"), "n").withColumn("tp", F.when(F.col("n") > 0, _normal(F.col("ll"), nowhere + float(np.log(len(langs)))))), "language"
    )

    # Confusion of declarations and the overall prior: a few cells.
    sums = [F.coalesce(F.sum(F.get("tp", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(len(langs))]
    cells = {r.declared: np.array(r[1:], float) for r in kept.groupBy("declared").agg(*sums).collect()}
    overall = sum(cells.values(), np.zeros(len(langs))) + 1.0
    prior = overall / overall.sum()
    values = [*langs, "other"]
    table = np.array([cells.get(v, np.zeros(len(langs))) for v in values]) + 0.5
    table = np.log(table / table.sum(axis=0))  # P(declared | language)
    flat = [0.0] * len(langs)
    declared = F.element_at(F.create_map(*[x for v, row in zip([*values, "-"], [*table.tolist(), flat]) for x in (F.lit(v), F.array(*map(F.lit, row)))]), F.col("declared"))
    by_suffix = {s: [np.log(SUFFIX_TRUST if x == lang else (1 - SUFFIX_TRUST) / max(1, len(langs) - 1)) for x in langs] for s, lang in SUFFIXES.items() if lang in langs}
    suffix = F.coalesce(F.element_at(F.create_map(*[x for s, row in by_suffix.items() for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in row]))]), F.regexp_extract("host", r"\.([^.]+)$", 1)), F.array(*map(F.lit, flat))) if by_suffix else F.array(*map(F.lit, flat))

    # Host priors: sums by host, sums of those by domain.
    level = lambda key, up: F.array(*[(F.col(f"s{i}") + strength * u) / (F.aggregate(F.array(*[F.col(f"s{k}") for k in range(len(langs))]), F.lit(0.0), lambda a, b: a + b) + strength) for i, u in enumerate(up)]).alias(key)
    hosts = kept.where("host IS NOT NULL").groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(langs))]).select("domain", level("dp", [F.lit(float(p)) for p in prior]))
    priors = stored(hosts.join(domains, "domain").select("host", level("hp", [F.get("dp", F.lit(i)) for i in range(len(langs))])), "priors")

    joined = kept.join(priors, "host", "left").withColumn("prior", F.coalesce("hp", F.array(*[F.lit(float(p)) for p in prior])))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    weights = add(add(add(F.transform("prior", lambda p: F.ln(p)), F.coalesce(declared, F.array(*map(F.lit, flat)))), suffix), F.when(F.col("n") > 0, F.col("ll")).otherwise(F.array(*map(F.lit, flat))))
    even = nowhere - F.when(F.col("declared") == "-", 0.0).otherwise(float(np.log(len(values))))
    if by_suffix:
        even = even - F.when(F.coalesce(F.regexp_extract("host", r"\.([^.]+)$", 1).isin(list(by_suffix)), F.lit(False)), float(np.log(len(langs)))).otherwise(0.0)
    done = joined.select("id", "n", "tp", _normal(weights, even).alias("post"))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    found = F.col("n") > 0
    return done.select(
        "id",
        F.when(found, best(F.col("post"))).alias("language"),
        F.when(found, F.array_max("post")).alias("posterior"),
        F.when(found, best(F.col("tp"))).alias("text_language"),
        F.array_max("tp").alias("text_posterior"),
        (found & (F.array_max("post") >= least)).alias("accepted"),
    )


def keep_identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", languages: list[str] | None = None, model: TrigramModel | None = None) -> DataFrame:
    """``docs`` whose language is identified (and among ``languages``, if given); same columns.

    Rows are known by two hashes of what is judged, so null or repeated ids do no harm and equal rows fare alike.
    """
    model = model or train(docs.select(F.col(text_col).alias("text"), F.col(declared_col).alias("language")))
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in (text_col, declared_col, host_col)]
    key = F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))
    found = identify(docs.select(key.alias("id"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), F.col(host_col).alias("host")), model)
    good = F.col("accepted") if languages is None else F.col("accepted") & F.col("language").isin(languages)
    gone = stored(found.where(~good).select("id.a", "id.b").distinct(), "rejected")
    return drop_listed(docs, [F.xxhash64(*parts), F.hash(*parts)], gone)
