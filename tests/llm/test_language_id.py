"""Language identification: held-out accuracy, and what each kind of evidence does."""

import duckdb
import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm.language_id import declared_in, drop_unidentified, host_of, identify, page_evidence, suffix_of, trigrams

SF = SF_SMALL.replace("0.001", "0.01")


def test_documents_with_hidden_declarations(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = df.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang")))
    got = {r.doc_id: r for r in identify(hidden).collect()}
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    held = [i for i in truth if i % 4 == 0]
    assert sum(got[i].language == truth[i] for i in held) >= 0.99 * len(held)
    labels = duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1 and toxic = 0").fetchall()
    assert all(got[i].kept for i, in labels)


def test_junk_is_rejected_and_declaration_decides_short_texts(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, "en", "src1"), (-2, "", "en", "src1"), (-3, "12 + 34 = ?! ### |", "en", None), (-4, "xqzj wvkq zzxx qqjx kwvz jxqz " * 20, None, None),
           (-5, "Er", "de", "src0"), (-6, "Er", "en", "src0")]
    rows = df.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in identify(rows).where("doc_id < 0").collect()}
    assert [got[i].kept for i in (-1, -2, -3, -4)] == [False] * 4
    assert got[-5].language == "de" and got[-6].language == "en"
    kept = drop_unidentified(rows.withColumn("_sure_id", F.lit(1)))
    assert kept.columns[-1] == "_sure_id" and kept.where("doc_id between -4 and -1").count() == 0


def test_pages_use_markup_address_and_host(spark):
    pages = page_evidence(spark.read.parquet(f"{SF}/pages.parquet"))
    truth = {r.page_id: r.declared for r in pages.select("page_id", "declared").collect()}
    hidden = pages.withColumn("declared", F.when(F.col("page_id") % 5 > 0, F.col("declared")))
    got = {r.page_id: r.language for r in identify(hidden, "page_id", "text", "declared", "host", "suffix").collect()}
    held = [i for i in truth if i % 5 == 0]
    assert sum(got[i] == truth[i] for i in held) >= 0.97 * len(held)
    row = spark.createDataFrame([("https://u@WWW.Ex.co.fr:80/x?y", "<!doctype html>\n<HTML class=a lang='FR-ca'>")], "url string, html string").select(
        host_of(F.col("url")).alias("h"), declared_in(F.col("html")).alias("l")).withColumn("s", suffix_of(F.col("h"))).first()
    assert tuple(row) == ("www.ex.co.fr", "fr", "fr")


def test_host_prior_moves_an_ambiguous_text(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hosted = base.withColumn("host", F.concat(F.lit("h."), F.col("lang")))
    odd = spark.createDataFrame([(-1, "on", None, "h.fr"), (-2, "on", None, "h.en")], "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r.language for r in identify(hosted.unionByName(odd), host_col="host").where("doc_id < 0").collect()}
    assert got == {-1: "fr", -2: "en"}


def test_empty_table_and_trigrams(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert identify(df).count() == 0
    lone = identify(spark.createDataFrame([(None, "abc", None, None)], df.schema)).first()
    assert lone.kept is False
    assert len(trigrams("ab 1c")) == 3 and len(trigrams(None)) == 0 and (trigrams("AB") == trigrams("ab")).all()
    assert trigrams("é" * 10).max() < 1 << 13 and isinstance(trigrams("x"), np.ndarray)


def test_text_alone(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(df).join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("text_language = truth").count() >= 0.985 * got.count()
    assert got.where("not kept").count() <= 0.01 * got.count()


def test_rare_languages_are_kept(spark):
    rng = np.random.default_rng(3)
    def text(first, size):  # noqa: E306
        vocabulary = ["".join(chr(first + c) for c in rng.integers(0, 24, 6)) for _ in range(40)]
        return lambda: " ".join(rng.choice(vocabulary, size))
    latin, greek, georgian, other = text(97, 12), text(0x3B1, 30), text(0x10D0, 30), text(97, 12)
    rows = [(i, latin(), "en", f"src{i % 3}") for i in range(6000)]
    rows += [(10000 + i, greek(), "el" if i else None, "src1") for i in range(26)]  # under half a percent, one undeclared
    rows += [(20000 + i, georgian(), "ka", "src2") for i in range(3)] + [(30000 + i, other(), "mt", "src2") for i in range(3)]
    rows += [(40000, "xqzj wvkq zzxx qqjx kwvz jxqz " * 20, None, "src1")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where(
        "doc_id >= 10000 or doc_id < 100").collect()}
    want = lambda i: "en" if i < 10000 else "el" if i < 20000 else "ka" if i < 30000 else "mt"
    assert all(got[i].language == want(i) and got[i].kept for i in got if i < 40000), [got[i] for i in got if got[i].language != want(i)][:5]
    assert not got[40000].kept


def test_pages_are_a_registered_query(spark):
    from tessera.llm.registry import QUERIES
    got = QUERIES["op3_language_id_pages"](spark, SF)
    pages = duckdb.sql(f"select count(*) from '{SF}/pages.parquet'").fetchall()[0][0]
    assert got.count() == pages and got.where("declared is not null and language = declared").count() >= 0.97 * pages
