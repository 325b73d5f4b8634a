"""Language identification by Bayesian evidence fusion.

Evidence on each row: its text (hashed byte trigrams under one multinomial for each
language), the language its markup or metadata declares, the suffix of its address and
its host. The posterior is proportional to

    P(text | language) ** temper * P(declared | language) * prior(language | host)

* Text models are fitted on a bounded sample of labelled rows: about ``sample`` rows of each
  declared language, chosen by a hash of the identifier. Trigrams overlap, so the
  likelihood is tempered: its weight is that of at most ``weight`` independent trigrams.
* How far declarations can be trusted is counted over all rows (declared language against
  text posterior), with ``trust`` pseudo-rows that agree.
* Host priors are shrunk hierarchically: global counts -> address suffix -> host, each
  level worth ``shrink`` rows of the next. All counts are sums of text posteriors over all
  rows, by grouped aggregation; the host with a third of the rows is summed map-side.

One more class, ``und``, has uniform trigrams: a text that fits it better than any
language is rejected, as is one without a letter or with a posterior below ``sure``.

Languages are the declared values of at least ``least`` rows, whatever their share (or of
half a percent of the declared rows, where that is less); each takes 32 KB of the table of
trigrams. A declared value of fewer rows has no text model: on its rows it is one more class,
whose text fits as well as the best other class, so declaration and host decide. Defined cases: null or blank texts and texts without letters are rejected;
null declarations, hosts and suffixes give no evidence of their own; repeated rows are
judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textfn import free_name
from .worker import claim

UND = "und"
BUCKETS = 1 << 13
#: ASCII letters lower-cased, bytes of other scripts kept, all else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each byte trigram that has a letter in the middle."""
    data = b"  " + (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS) + b"  "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    middle = b[1:-1]
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (middle * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13))[middle != 32]


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_in(html: Column) -> Column:
    """The language that a page's html element declares."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Rows (page_id, text, declared, host, suffix) of raw pages, for ``identify``."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^<>]*>", " ")
    return pages.select("page_id", plain.alias("text"), declared_in(F.col("html")).alias("declared"),
                        host_of(F.col("url")).alias("host")).withColumn("suffix", suffix_of(F.col("host")))


def fit(rows: DataFrame, sample: int, least: int) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities (BUCKETS x languages and und)."""
    sizes = rows.where("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    sizes = {r.declared: r.n for r in sizes.where((F.col("n") >= least) | (F.col("n") * 200 >= total)).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, sample / sizes[name])) for name in languages], "name string, share double")
    chosen = rows.join(F.broadcast(shares), F.col("declared") == F.col("name")).where(
        F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("declared", "text")
    at = {name: i for i, name in enumerate(languages)}

    def counted(batches):
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(bucket, pa.int64()), pa.array(sums[lang, bucket], pa.int64())],
                                         names=["lang", "bucket", "n"])

    counts = (chosen.mapInArrow(counted, "lang long, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # at most BUCKETS rows a language
    table = np.full((len(languages), BUCKETS), 0.5)
    lang, bucket, n = (c.to_numpy() for c in counts.columns)
    table[lang, bucket] += n
    log = np.log(table / table.sum(axis=1, keepdims=True))
    return languages, np.vstack([log, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray, weight: float) -> DataFrame:
    """Adds ``n_grams`` and ``ll``: the tempered log-likelihood of each class."""
    shared = rows.sparkSession.sparkContext.broadcast(table)  # BUCKETS floats for each class: 32 KB
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_grams long, ll array<double>"

    def scored(batches):
        claim("language ID")
        log = shared.value
        for batch in batches:
            n, ll = [], []
            for text in batch.column("text").to_pylist():
                grams = trigrams(text)
                sums = np.zeros(log.shape[1])
                for at in range(0, len(grams), 1 << 16):
                    sums += log[grams[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                n.append(len(grams))
                ll.append(sums * (min(len(grams) / 3, weight) / max(len(grams), 1)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))],
                                             names=[*kept, "n_grams", "ll"])

    return rows.mapInArrow(scored, schema)


def _softmax(logs: Column) -> Column:
    """Probabilities from logarithms, rounded so that reruns agree."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: F.round(x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y), 9))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             host_col: str | None = "source", suffix_col: str | None = None, sample: int = 2000, weight: float = 100.0,
             trust: float = 20.0, shrink: float = 50.0, sure: float = 0.5, least: int = 20) -> DataFrame:
    """One row per input row: ``id_col, declared, text_language, language, confidence, kept``."""
    scratch = Scratch(df.sparkSession, "language-id")
    text_or_null = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_or_null(declared_col).alias("declared"),
                     text_or_null(host_col).alias("host"), text_or_null(suffix_col).alias("suffix"))
    if host_col and not suffix_col:
        rows = rows.withColumn("suffix", suffix_of(F.col("host")))
    languages, table = fit(rows, sample, least)
    classes = [*languages, UND, None]  # the last is a declared language without a text model, on rows that declare one
    modelless = F.col("declared").isNotNull() & ~F.col("declared").isin(languages)
    scores = scratch.keep(text_evidence(rows, table, weight), "scores").withColumn("ll", F.concat("ll", F.array(
        F.when(modelless, F.array_max("ll")).otherwise(F.lit(-1e9))))).withColumn("p", _softmax(F.col("ll")))
    p = [F.sum(F.get("p", F.lit(i))) for i in range(len(classes))]

    # trust in declarations: P(declared | class), counted over all rows with letters
    told = (scores.where("n_grams > 0").where(F.col("declared").isin(languages)).groupBy("declared")
            .agg(F.array(*p).alias("n")).collect() if languages else [])  # one row for each language
    agree = {r.declared: r.n for r in told}
    def told_log(i):  # noqa: E306
        told_by = agree.get(classes[i], [0.0] * len(classes))
        return [float(np.log((told_by[j] + (trust if i == j else 0.1) + 0.1)
                             / (sum(a[j] for a in agree.values()) + trust + 0.1 * len(classes) + 0.1))) for j in range(len(classes))]
    tellers = df.sparkSession.createDataFrame([(name, told_log(i)) for i, name in enumerate(languages)], "d string, told array<double>")
    untold = F.when(modelless, F.array(*[F.lit(x) for x in told_log(len(classes) - 1)])).otherwise(F.array(*[F.lit(0.0) for _ in classes]))

    # priors: all rows -> suffix -> host
    hosts = scratch.keep(scores.where("n_grams > 0").groupBy("host", "suffix").agg(F.array(*p).alias("n")), "hosts")
    per = lambda frame, *keys: frame.groupBy(*keys).agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(classes))]).alias("n"))
    everything = per(hosts).first()["n"] or [0.0] * len(classes)
    start = [((x or 0.0) + 1) / (sum(y or 0.0 for y in everything) + len(classes)) for x in everything]
    def shrunk(counts, above):  # noqa: E306
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.zip_with(counts, above, lambda n, q: n + q * shrink), lambda x: x / (size + shrink))
    flat = F.array(*[F.lit(float(x)) for x in start])
    suffixes = per(hosts.where("suffix is not null"), "suffix").select(F.col("suffix").alias("s"), shrunk(F.col("n"), flat).alias("above"))
    priors = (hosts.where("host is not null").join(suffixes, F.col("suffix") == F.col("s"), "left")
              .groupBy("host").agg(F.first("above").alias("above"), F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(classes))]).alias("n"))
              .select(F.col("host").alias("h"), shrunk(F.col("n"), F.coalesce("above", flat)).alias("prior")))
    fused = scores.join(priors, F.col("host") == F.col("h"), "left").join(
        F.broadcast(tellers), F.col("declared") == F.col("d"), "left").withColumn("logs", F.zip_with(
            F.zip_with("ll", F.coalesce("told", untold), lambda a, b: a + b), F.coalesce("prior", flat), lambda a, q: a + F.log(q + 1e-9)))
    named = F.array(*[F.lit(c) for c in classes[:-1]], F.col("declared"))
    best = lambda probs: F.get(named, (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    return (fused.withColumn("post", _softmax(F.col("logs")))
            .select(F.col("id").alias(id_col), "declared", F.when(F.col("n_grams") > 0, best(F.col("p"))).alias("text_language"),
                    F.when(F.col("n_grams") > 0, best(F.col("post"))).otherwise(F.lit(UND)).alias("language"),
                    F.when(F.col("n_grams") > 0, F.round(F.array_max("post"), 6)).otherwise(F.lit(0.0)).alias("confidence"))
            .withColumn("kept", (F.col("language") != UND) & (F.col("confidence") >= sure)))


def drop_unidentified(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose language is certain enough, all columns unchanged."""
    key = free_name(df.columns, "_sure_id")
    kept = identify(df, id_col, **options).where("kept").select(F.col(id_col).alias(key)).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
