"""Language identification by fusing evidence with Bayes' rule.

Text: likelihoods of byte trigrams of letters, hashed to a table of fixed size, from counts over all training texts; a long
text counts as `weight_of_text` trigrams at most, since neighbours depend on each other. Declared language and address suffix:
chances given the language, from grouped counts of what the text alone says. Host: a prior from the votes of the host's other
documents, smoothed towards its suffix's, and that towards all. `und`, a language whose trigrams are all alike, stands for
text in none of the languages. Every language of the
training rows has a model: trigram counts are a table (language, bucket, n), and the model takes 256 KB a language. Tables by host,
suffix and declared value are joined.

Cases: without letters the text says nothing and the other evidence decides; null declared values, suffixes and hosts say
nothing; without any evidence the overall prior decides; repeated rows stay; without training rows all is `und`; an empty
table gives no rows. Columns of the input that are named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import apart, rows_of, stored, together

BITS = 16
#: So many languages are counted and brought to the driver at a time.
_AT_ONCE = 64
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(c.lower()) if c.isalpha() else 0x20 for c in map(chr, range(128))]


def trigrams(data: bytes | None) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text, letters lower-cased, other ASCII as blanks; those within blanks are left out."""
    b = _FOLD[np.frombuffer(data or b"", np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    keep = b[1:-1] != 0x20
    packed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[keep]
    return ((packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # bucket x language, natural logs; the last language is UNKNOWN


def train_text(rows: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram counts of all rows that have text and language."""
    given = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages = tuple(sorted(r[0] for r in given.select(F.lower(lang)).distinct().collect()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for name, n in seen.items():
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["l", "bucket", "n"])
            seen.clear()

        for x, name in rows_of(batches, "data", "l"):
            if name not in seen:
                if len(seen) == _AT_ONCE:
                    yield from counted()
                seen[name] = np.zeros(1 << BITS, np.int64)
            seen[name] += np.bincount(trigrams(x), minlength=1 << BITS)
        yield from counted()

    found = given.select(F.col(text).cast("binary").alias("data"), F.lower(lang).alias("l")).mapInArrow(count, "l string, bucket long, n long")
    table = stored(found.groupBy("l", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    every = table.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    in_bucket = np.ones(1 << BITS)  # UNKNOWN has one of each
    in_bucket[every["bucket"].to_numpy()] += every["n"].to_numpy()
    least = 0.5 * (in_bucket + 1) / (in_bucket.sum() + len(in_bucket)) * len(in_bucket) * 0.01 + 0.01
    logs = np.empty((1 << BITS, len(languages) + 1), np.float32)
    logs[:, -1] = np.log((1.0 + least) / (1.0 + least).sum())
    for low in range(0, len(languages), _AT_ONCE):
        some = languages[low : low + _AT_ONCE]
        got = table.filter(F.col("l").between(some[0], some[-1])).toArrow()
        counts, place = np.zeros((1 << BITS, len(some))), {x: k for k, x in enumerate(some)}
        counts[got["bucket"].to_numpy(), [place[x] for x in got["l"].to_pylist()]] = got["n"].to_numpy()
        smooth = counts + least[:, None]
        logs[:, low : low + len(some)] = np.log(smooth / smooth.sum(0))
    return TextModel((*languages, UNKNOWN), logs)


def text_evidence(rows: DataFrame, model: TextModel, text: Column, weight_of_text: float) -> Column:
    """Log-likelihoods by language, the best at 0; null if the text has no letters."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def one(data: bytes | None) -> list[float] | None:
        at = trigrams(data)
        if not len(at):
            return None
        sums = shared.value.logs[at].sum(0, dtype=np.float64) * min(1.0, weight_of_text / len(at))
        return (sums - sums.max()).tolist()

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array((one(x.as_py()) for x in texts), pa.list_(pa.float64()))

    return evidence(text.cast("binary"))


def _by_key(votes: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """The votes of each value as a map from language to number."""
    counts = votes.filter(F.col(by).isNotNull()).groupBy(by, "vote").agg(F.sum("n").alias("n"))
    return counts.groupBy(F.col(by).alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("vote", F.col("n").cast("double")))).alias(name))


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column, weight_of_text: float = 60.0, weight_of_prior: float = 10.0) -> DataFrame:
    """The rows with language, posterior (its chance), text_language (by the text alone) and declared (as read)."""
    k = len(model.languages)
    base = apart(
        rows, __e=text_evidence(rows, model, text, weight_of_text), declared=F.lower(F.substring_index(F.trim(declared), "-", 1)), __s=F.lower(suffix), __h=F.lower(host)
    ).withColumn("__v", F.when(F.col("__e").isNotNull(), F.array_position("__e", F.array_max("__e")) - 1))
    votes = stored(base.groupBy("__h", "__s", "declared", "__v").agg(F.count("*").alias("n")), "votes").filter("__v is not null").withColumnRenamed("__v", "vote").withColumn("vote", F.col("vote").cast("int"))
    total = np.full(k, 1.0)
    total[-1] = 0.01
    for r in votes.groupBy("vote").agg(F.sum("n").alias("n")).collect():
        total[r["vote"]] += r["n"]
    prior = total / total.sum()
    priors = F.array(*map(F.lit, prior.tolist()))

    def chances(found: str) -> Column:
        """Chances of languages given the value, smoothed towards the prior; without votes the prior."""
        n = F.aggregate(F.map_values(found), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.col(found).isNull(), priors).otherwise(F.transform(priors, lambda p, j: (F.coalesce(F.element_at(found, j), F.lit(0.0)) + weight_of_prior * p) / (n + weight_of_prior)))

    joined = base
    for by, name in (("__h", "__hosts"), ("__s", "__suffixes"), ("declared", "__declareds")):
        joined = joined.join(_by_key(votes, by, f"{name}_key", name), F.col(by) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    others = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.greatest(F.coalesce(F.element_at("__hosts", j), F.lit(0.0)) - F.coalesce((j == F.col("__v")).cast("double"), F.lit(0.0)), F.lit(0.0)))  # without the row's own vote
    count = F.aggregate("__others", F.lit(0.0), lambda s, x: s + x)
    smoothed = F.zip_with("__others", "__suffix", lambda n, p: (n + weight_of_prior * p) / (F.col("__count") + weight_of_prior))
    says = F.zip_with("__declares", priors, lambda p, q: F.log(p / q))
    logs = F.zip_with(F.zip_with(F.transform("__prior", lambda p: F.log(p)), "__says", lambda a, b: a + b), F.coalesce("__e", F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)
    fused = (
        joined.withColumn("__others", others)
        .withColumns({"__count": count, "__suffix": chances("__suffixes"), "__declares": chances("__declareds")})
        .withColumn("__prior", smoothed)
        .withColumn("__says", says)
        .withColumn("__logs", logs)
        .withColumn("__top", F.array_max("__logs"))
    )
    mass = F.aggregate("__logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__top")))
    names = F.array(*map(F.lit, model.languages))
    fused = fused.withColumns(
        {"language": F.element_at(names, F.array_position("__logs", F.col("__top")).cast("int")), "posterior": 1 / mass, "text_language": F.element_at(names, (F.col("__v") + 1).cast("int"))}
    )
    return together(fused, rows.columns, "declared", "language", "posterior", "text_language")


def accepted(least: float = 0.5) -> Column:
    """Whether identified rows are in a language that is known, at such a chance at least."""
    return (F.col("language") != UNKNOWN) & (F.col("posterior") >= least)


def page_columns(pages: DataFrame) -> dict[str, Column]:
    """Text, declared language, suffix and host of raw pages."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "), r"&[#\w]{1,12};", " ")
    host = F.nullif(F.regexp_extract(F.lower(F.trim("url")), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return {
        "text": bare,
        "declared": F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3}(?:-\w+)?)", 1), F.lit("")),
        "suffix": F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1), F.lit("")),
        "host": host,
    }
