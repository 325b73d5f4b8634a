"""Registered query of the Merkle manifest."""

from pyspark.sql import functions as F

from .manifest import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(docs):
    """What a receiver holds: one more in n_chars of every seventh document by checksum."""
    hit = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0
    size = F.col("n_chars").cast("decimal(20,0)")
    return {"n_chars": F.when(hit, size + 1).otherwise(size)}


def proofs(docs):
    siblings = F.regexp_replace("path", "(^|;)[0-9]+:", "")
    return manifest(docs, COLUMNS, received=tampered(docs)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir):
    return proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _leaf(size="n_chars"):
    parts = [size if c == "n_chars" else c for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in parts) + ")"


def _tree(name, nodes, key):
    """Levels of the trees of ``nodes`` (key, pos, h); n is the number of nodes of a level."""
    return f"""{name}({key}, level, pos, h, n) AS (
  SELECT {key}, 0, pos, h, count(*) OVER (PARTITION BY {key}) FROM {nodes}
  UNION ALL
  SELECT {key}, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY {key}, level, pos // 2)"""


def _fold(name, start, tree, key):
    """Rows of ``start`` (rid, key, pos, cur) folded up ``tree``; sib has the siblings so far."""
    return f"""{name}(rid, {key}, pos, level, cur, sib, over) AS (
  SELECT rid, {key}, pos, 0, cur, sib, false FROM {start}
  UNION ALL
  SELECT f.rid, f.{key}, f.pos // 2, f.level + 1,
         CASE WHEN t.n = 1 THEN f.cur ELSE sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.cur ELSE f.cur || coalesce(s.h, '') END) END,
         CASE WHEN t.n = 1 THEN f.sib ELSE f.sib || coalesce(s.h, '') END, t.n = 1
  FROM {name} f JOIN {tree} t ON t.{key} IS NOT DISTINCT FROM f.{key} AND t.level = f.level AND t.pos = f.pos
  LEFT JOIN {tree} s ON s.{key} IS NOT DISTINCT FROM f.{key} AND s.level = f.level AND s.pos = xor(f.pos, 1)
  WHERE NOT f.over)"""


#: Reversed polynomial of CRC-32.
POLYNOMIAL = 3988292384
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)),
hit AS (
  SELECT documents.*, coalesce(xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 7 = 0, false) AS bad
  FROM documents, crc),
leaves AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT doc_id, lang, {_leaf()} AS h, {_leaf("CASE WHEN bad THEN n_chars::HUGEINT + 1 ELSE n_chars::HUGEINT END")} AS cur,
         '' AS sib, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf()}) - 1 AS pos
  FROM hit)),
{_tree("tree", "leaves", "lang")},
subroots AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
{_tree("top", "subroots", "one")},
{_fold("low", "leaves", "tree", "lang")},
lifted AS (SELECT rid, 0 AS one, s.pos, cur, sib FROM low JOIN subroots s ON s.lang IS NOT DISTINCT FROM low.lang WHERE over),
{_fold("high", "lifted", "top", "one")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.sib) AS proof_sha256, f.cur AS folded_root,
       f.cur = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN high f ON f.rid = l.rid AND f.over
JOIN top r ON r.n = 1
"""
