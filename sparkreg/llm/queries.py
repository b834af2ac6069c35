"""The registered queries of this subpackage, with oracle SQL where SQL can
express the result.  Each is a thin wrapper: read the table, call the
operator, derive the digest columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op4_mix_sources", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sized GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((nr - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM per),
lvl AS (
  SELECT *, cap / w AS r, sum(source_size) OVER () * 1.5::DOUBLE AS goal,
         coalesce(sum(cap) OVER (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fill,
         sum(w) OVER (ORDER BY cap / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
pick AS (SELECT (goal - fill) / open AS level FROM lvl WHERE (goal - fill) / open <= r ORDER BY r, nr LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target
  FROM lvl LEFT JOIN pick ON true),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate FROM t),
hashed AS (
  SELECT doc_id, size, source_size, target, rate, rates.source AS source, ('0x' || substr(h, 1, 6))::UBIGINT::BIGINT AS a,
         ('0x' || substr(h, 7, 6))::UBIGINT::BIGINT AS b
  FROM (SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM sized) s
  JOIN rates ON s.source IS NOT DISTINCT FROM rates.source),
drawn AS (
  SELECT *, floor(rate) + CASE WHEN (a + k * b) % 16777216 < (rate - floor(rate)) * 16777216 THEN 1 ELSE 0 END AS copies
  FROM hashed, (SELECT unnest(range(64)) AS k)),
seeds AS (
  SELECT source, k FROM drawn GROUP BY source, k
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(copies * size) - any_value(target)), k) = 1)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (copies * size)::BIGINT AS taken
FROM drawn JOIN seeds ON drawn.k = seeds.k AND drawn.source IS NOT DISTINCT FROM seeds.source
""")
def op4(spark, sf_dir):
    from sparkreg.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM n)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g
""")
def op5(spark, sf_dir):
    from sparkreg.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    from sparkreg.llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    from sparkreg.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")) \
        .select("doc_id", "held_out", "score", "predicted")


@query("op8_license_scan")
def op8(spark, sf_dir):
    from sparkreg.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    from sparkreg.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op2_html_extract")
def op2(spark, sf_dir):
    from sparkreg.llm.html_extract import extract
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", "n_chars")


#: The vocabulary that op6 and the pipeline encode with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    import public_tokenizers

    from sparkreg.llm.bpe import digests, encode_decode
    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                 public_tokenizers.PATTERN))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    from sparkreg.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op10_line_dedup")
def op10(spark, sf_dir):
    from sparkreg.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents"))


#: The vocabulary that op11 encodes with.
WORD_VOCABULARY = "word_bpe_49k.json"


@query("op11_word_bpe")
def op11(spark, sf_dir):
    import public_tokenizers

    from sparkreg.llm.word_bpe import digests, encode_decode
    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)))


#: CRC-32 of a string in SQL: its table, and a fold over the UTF-8 bytes.
CRC_TABLE = """tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab)"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string expression, beside ``tab``."""
    one = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT"
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode({text}))), "
            f"lambda i: {one})), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::INT])), 4294967295::UBIGINT)")


@query("op12_spelling_variants", rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''),
         '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
c AS (SELECT id, w, count(*) AS k FROM r WHERE length(w) >= 5 GROUP BY id, w),
h AS (SELECT w, k, {crc32_sql("id || ':' || w")} AS h FROM c, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2)
             ELSE w END AS w, k FROM h),
v AS (SELECT w AS word, sum(k)::BIGINT AS n FROM d WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
m AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM m a JOIN m b ON a.cut = b.cut AND a.i = b.i
             AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM m a JOIN v b ON a.cut = b.word
      UNION SELECT b.word, a.word, a.n FROM m a JOIN v b ON a.cut = b.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
      FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
             CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
      FROM v LEFT JOIN b USING (word)),
up AS (SELECT word, word AS at FROM f
       UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
last AS (SELECT up.word, up.at FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
SELECT f.word, f.form, last.at AS root, f.n, f.n_near, f.form_n FROM f JOIN last USING (word)
""")
def op12(spark, sf_dir):
    from sparkreg.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))


def _field_sql(col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN '-' ELSE octet_length(encode({col}::VARCHAR)) || ':' || {col}::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes (tree, lvl, pos, n, digest) above the leaves of that table."""
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, any_value(lvl) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, pos // 2)"""


@query("op13_merkle_manifest", f"""
WITH RECURSIVE {CRC_TABLE},
l AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 7 = 0
         THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS claimed FROM documents, tab),
a AS (SELECT coalesce('+' || lang, '') AS tree, doc_id, leaf AS digest, claimed, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
{_tree_sql("t", "a")},
b AS (SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
      FROM t WHERE n = 1),
{_tree_sql("u", "b")},
whole AS (SELECT digest AS root FROM u WHERE n = 1),
fold AS (
  SELECT a.tree, a.pos AS leaf_pos, 0 AS phase, a.tree AS at_tree, 0 AS lvl, a.pos, a.n, claimed AS digest, '' AS proof FROM a
  UNION ALL
  SELECT f.tree, leaf_pos, CASE WHEN f.n = 1 THEN 1 ELSE phase END, CASE WHEN f.n = 1 THEN '' ELSE at_tree END,
         CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN f.n = 1 THEN b.pos ELSE f.pos // 2 END,
         CASE WHEN f.n = 1 THEN b.n ELSE (f.n + 1) // 2 END,
         CASE WHEN f.n = 1 THEN f.digest WHEN s.digest IS NULL THEN sha256(f.digest)
              WHEN f.pos % 2 = 1 THEN sha256(s.digest || f.digest) ELSE sha256(f.digest || s.digest) END,
         CASE WHEN f.n = 1 THEN proof ELSE proof || coalesce(s.digest, '') END
  FROM fold f JOIN b ON b.of = f.tree
  LEFT JOIN (SELECT tree, lvl, pos, digest FROM t UNION ALL SELECT 'all', lvl, pos, digest FROM u) s
    ON s.tree = CASE WHEN phase = 0 THEN at_tree ELSE 'all' END AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) AND f.n > 1
  WHERE f.n > 1 OR phase = 0)
SELECT a.doc_id, a.digest AS leaf, b.digest AS subroot, root, sha256(proof) AS proof_sha256, fold.digest AS folded_root,
       fold.digest = root AS verified
FROM a JOIN b ON b.of = a.tree JOIN fold ON fold.tree = a.tree AND fold.leaf_pos = a.pos AND phase = 1 AND fold.n = 1, whole
""")
def op13(spark, sf_dir):
    from sparkreg.llm.merkle import checked
    return checked(table(spark, sf_dir, "documents"))
