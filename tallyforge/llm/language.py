"""Language identification of web pages by Bayesian fusion of text, markup, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text, written

_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Markup that holds no prose, and tags.
_UNSEEN = re.compile(r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def text_features(text: str, dims: int) -> np.ndarray:
    """Hashed places of the character trigrams of a text's words, with marks at both ends."""
    data = b" " + b" ".join(_WORD.findall(text.lower().encode())) + b" "
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - dims.bit_length() + 1)).astype(np.int64)


def fit_text(docs: DataFrame, dims: int = 1 << 15, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods ``(language, feature)`` from all rows with a language: add-half smoothed trigram counts.

    Tasks count what they read; the counts of a feature and language meet in one grouped sum. The driver holds ``dims`` numbers a
    language: the distinct values of ``lang_col`` must be a list of languages, not free text.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = sums.setdefault(lang, np.zeros(dims))
                own += np.bincount(text_features(text, dims), minlength=dims)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": own[at].astype(np.int64)})

    counted = rows.mapInPandas(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.full((len(langs), dims), 0.5)
    table[counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), counted["feature"].to_numpy(dtype=int)] += counted["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_language(html: Column) -> Column:
    """The main part of the language that the markup declares, in lower case; empty where it declares none."""
    return F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))


def _shares(rows: DataFrame, keys: list[str], langs: list[str], above: DataFrame | list[float], strength: float, name: str) -> DataFrame:
    """Language shares of each key from soft counts, drawn towards those of the level above by ``strength`` pages.

    ``above`` is a table ``keys[0], above`` of shares, or one list of them.
    """
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get("soft", i)).alias(f"s{i}") for i in range(len(langs))])
    base = F.array(*map(F.lit, above)) if isinstance(above, list) else F.col("above")
    if not isinstance(above, list):
        sums = sums.join(above, keys[0])
    total = sum(F.col(f"s{i}") for i in range(len(langs)))
    shares = F.array(*[(F.col(f"s{i}") + strength * F.get(base, i)) / (total + strength) for i in range(len(langs))])
    return sums.select(*keys, shares.alias(name))


def identify_languages(pages: DataFrame, docs: DataFrame, strength: float = 5.0, weight: float = 0.02, dims: int = 1 << 15, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The language of every page from four kinds of evidence.

    * text: trigram likelihoods learnt from all of ``docs``, over the whole prose of the page, each trigram at ``weight`` as
      neighbours depend on each other. Navigation (``nav``) is visible but lists other pages' titles, often in another
      language, so it is no evidence by rule, as are scripts, styles and comments;
    * markup: how often pages whose text speaks for a language declare each code, smoothed;
    * address suffix: likewise, from the last label of the host;
    * host: a prior smoothed towards its domain (the last two labels), and that towards all pages.

    The last three come from the text's own beliefs summed by grouped aggregation, so no page needs a label and a host of
    any size is one row per task before it meets. Host and domain tables grow with the number of hosts and are joined, not
    broadcast by hand.

    Returns one row per page: ``page_id, lang, confidence, text_lang, declared, suffix, host``. Null or empty pages and
    addresses give no evidence of that kind; ties go to the first language by name; ids may repeat or be null; other
    columns are ignored; an empty table of pages gives no rows. With no documents there is no language: ``lang`` is null.
    """
    spark = pages.sparkSession
    langs, logs = fit_text(docs, dims)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole_text(html_col).alias("html"))
    host = host_of(F.col("url"))
    own = own.select("page_id", "html", declared_language(F.col("html")).alias("declared"), host.alias("host"))
    own = own.withColumns({"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)})
    shared = spark.sparkContext.broadcast(logs)
    names = ["page_id", "declared", "host", "suffix", "domain"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            scores = [(weight * table[:, text_features(_UNSEEN.sub(" ", html.as_py()), dims)].sum(axis=1)).tolist() for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.list_(pa.float64()))], [*names, "text"])

    kind = own.schema["page_id"].dataType.simpleString()
    evidence = own.mapInArrow(read, f"page_id {kind}, declared string, host string, suffix string, domain string, text array<double>")
    if not langs:
        return evidence.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")

    def belief(score: Column) -> Column:
        """Log scores as chances that sum to 1."""
        parts = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
        return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))

    evidence = written(evidence.withColumn("soft", belief(F.col("text"))), "page-evidence")
    every = [x or 0.0 for x in evidence.agg(*[F.sum(F.get("soft", i)) for i in range(len(langs))]).first()]
    everywhere = [(x + strength / len(langs)) / (sum(every) + strength) for x in every]
    domains = _shares(evidence, ["domain"], langs, everywhere, strength, "above")
    hosts = written(_shares(evidence, ["domain", "host"], langs, domains, strength, "prior"), "host-priors")

    def likelihoods(key: str, name: str) -> DataFrame:
        """How likely each language shows each value of ``key``, smoothed by ``strength`` pages that show any of them alike."""
        sums = written(evidence.groupBy(key).agg(*[F.sum(F.get("soft", i)).alias(f"s{i}") for i in range(len(langs))]), f"{key}-sums")
        values = max(1, sums.count())
        return sums.select(key, F.array(*[(F.col(f"s{i}") + strength / values) / (every[i] + strength) for i in range(len(langs))]).alias(name))

    found = evidence.join(hosts.select("host", "prior"), "host").join(likelihoods("declared", "by_markup"), "declared").join(likelihoods("suffix", "by_suffix"), "suffix")
    total = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.get("text", i) + F.log(F.get("prior", i)) + F.when(F.col("declared") == "", 0.0).otherwise(F.log(F.get("by_markup", i))) + F.when(F.col("suffix") == "", 0.0).otherwise(F.log(F.get("by_suffix", i))))
    named = F.array(*[F.lit(x) for x in langs])
    found = found.withColumn("chance", belief(total))
    best = lambda scores: F.element_at(named, F.array_position(scores, F.array_max(scores)).cast("int"))
    return found.select("page_id", best(F.col("chance")).alias("lang"), F.array_max("chance").alias("confidence"), best(F.col("text")).alias("text_lang"), "declared", "suffix", "host")
