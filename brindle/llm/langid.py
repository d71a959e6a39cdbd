"""Language identification by Bayesian evidence fusion.

The text's likelihood under character trigrams is fused with the language that the markup
declares, the address suffix (top-level domain and leading path part) and a prior of the host.
Host priors are soft counts of the text evidence, summed by host, by parent domain and over
everything, each level smoothed by the one above; the reliability of declarations and suffixes
is estimated from the same soft counts.  All of these cover every row.

The trigram tables are fitted on at most ``MAX_LABELLED`` labelled texts, those with the
smallest hash of their id.

Defined results: a null or empty text leaves the decision to the other evidence; missing
evidence counts as none; ties go to the alphabetically first language; with no labelled text
every language is "und"; repeated rows give repeated results and each counts; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .html_extract import blocks, host_of

MAX_LABELLED = 4000
#: Trigrams are not independent: their joint log likelihood counts by this factor.
TEMPER = 0.25
#: Soft counts that a level of the prior borrows from the level above.
BORROW = 5.0
SLOTS = 1 << 16
LETTERS = re.compile(r"[^\W\d_]+").findall


def slots(text: str | None) -> np.ndarray:
    """Table places of all trigrams of the words of a text, each word between two spaces."""
    words = LETTERS(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    # Windows around a space would join two words.
    return ((c[:-2] * 1000003 + c[1:-1] * 8191 + c[2:] * 131) % SLOTS)[c[1:-1] != 32]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # SLOTS x languages

    def scores(self, text: str | None) -> list[float]:
        """Log likelihoods, the largest 0; long texts in parts, so that memory is bounded."""
        total, at = np.zeros(len(self.languages)), slots(text)
        for k in range(0, len(at), 1 << 16):
            total += self.logs[at[k : k + (1 << 16)]].sum(axis=0)
        return (total - total.max(initial=-np.inf)).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = MAX_LABELLED) -> Model:
    """Trigram tables of at most ``bound`` labelled rows, counted on the executors."""
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(bound)
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL").join(F.broadcast(ids), "id")

    def rows(it):
        tables: dict[str, np.ndarray] = {}
        for batch in it:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                tables.setdefault(lang, np.zeros(SLOTS, np.int64))
                tables[lang] += np.bincount(slots(text), minlength=SLOTS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": at.astype(np.int32), "n": table[at]}, schema=pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())]))

    counted = part.select("text", "lang").mapInArrow(rows, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # At most SLOTS numbers for each language of the bounded sample.
    sums: dict[str, np.ndarray] = {}
    for lang, slot, n in counted.toArrow().to_pandas().itertuples(index=False):
        sums.setdefault(lang, np.zeros(SLOTS, np.int64))[slot] = n
    names = sorted(sums)
    table = np.array([sums[n] for n in names], float).reshape(len(names), SLOTS) + 0.5
    return Model(names, np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T) if names else table.T)


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``ll``, the tempered log likelihood of each language; rows: (…, text or html)."""

    def fn(it):
        for batch in it:
            texts, pages = batch["text"].to_pylist(), batch["html"].to_pylist()
            full = [t if h is None else " ".join(b for b, main, noise in blocks(h) if main or not noise) for t, h in zip(texts, pages)]
            lls = [[TEMPER * x for x in model.scores(t)] for t in full]
            yield batch.drop_columns(["text", "html"]).append_column("ll", pa.array(lls, pa.list_(pa.float64())))

    out = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n not in ("text", "html")) + ", ll array<double>"
    return rows.mapInArrow(fn, out)


def normal(logs) -> F.Column:
    """exp of log weights, scaled to sum 1."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(F.array(raw), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))[0]


def soft_counts(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("soft")[k]) for k in range(n)]).alias("c"))


def shared(counts, above) -> F.Column:
    """Counts smoothed by the level above."""
    return F.zip_with(counts, above, lambda c, p: c + BORROW * p)


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """Adds lang and confidence; rows: (…, host, declared, suffix, text, html), of which html wins."""
    n = len(model.languages)
    if not n:
        return rows.drop("text", "html").withColumn("lang", F.lit("und")).withColumn("confidence", F.lit(0.0))
    parent = F.when(F.col("host").contains("."), F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)).otherwise(F.lit(""))
    scored = cut(evidence(rows, model).withColumn("soft", normal(F.col("ll"))).withColumn("parent", parent), "evidence")
    even = F.array(*[F.lit(1.0 / n)] * n)
    scale = lambda c: F.transform(F.array(c), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))[0]
    # One number for each language goes to the driver.
    whole = F.array(*[F.lit(x) for x in soft_counts(scored, n).select(scale(shared(F.coalesce(F.when(F.col("c")[0].isNotNull(), F.col("c")), even), even))).first()[0]])
    by_parent = soft_counts(scored, n, "parent").select("parent", scale(shared(F.col("c"), whole)).alias("pp"))
    by_host = soft_counts(scored, n, "host", "parent").join(by_parent, "parent").select("host", scale(shared(F.col("c"), F.col("pp"))).alias("prior"))
    priors = cut(by_host.groupBy("host").agg(F.first("prior").alias("prior")), "priors")

    def reliability(column: str, name: str) -> DataFrame:
        """For each value: how much likelier it is under each language than overall."""
        counts = soft_counts(scored.where(F.col(column).isNotNull()), n, column)
        return cut(counts.select(F.col(column).alias(f"{column}_v"), F.zip_with(scale(shared(F.col("c"), whole)), whole, lambda a, b: F.log(a / b)).alias(name)), name)

    out = scored.join(priors, "host").join(reliability("declared", "de"), F.col("declared") == F.col("declared_v"), "left").join(reliability("suffix", "su"), F.col("suffix") == F.col("suffix_v"), "left")
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add("ll", F.transform("prior", lambda x: F.log(x))), add(F.coalesce("de", none), F.coalesce("su", none)))
    out = out.withColumn("post", normal(fused))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_position("post", F.array_max("post")).cast("int")
    keep = [c for c in rows.columns if c not in ("text", "html")]
    return out.select(*keep, F.element_at(names, best).alias("lang"), F.array_max("post").alias("confidence"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the source stands for the host; they declare nothing."""
    null = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), null.alias("declared"), null.alias("suffix"), F.col("text").cast("string"), null.alias("html"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as evidence: host, declared language, and top-level domain with the leading path part."""
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    lead = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.concat_ws("/", F.regexp_extract(host, r"[^.]*$", 0), lead)
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), host.alias("host"), F.when(declared != "", declared).alias("declared"), suffix.alias("suffix"), F.lit(None).cast("string").alias("text"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def result(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, host, lang, confidence) of all documents and pages, one id null."""
    rows = of_documents(docs).unionByName(of_pages(pages))
    return identify(rows, train(docs)).select("doc_id", "page_id", "host", "lang", F.round("confidence", 6).alias("confidence"))
