"""Queries of the operators in this subpackage over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm import quality

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=fold != 1)
    return quality.scored(docs, model, ["doc_id"]).select("doc_id", (fold == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.suffix_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.licenses import license_notices

    return license_notices(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from kolumna.llm.token_counts import token_counts

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), model)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.secrets import secret_spans

    # A base span of the contract is its pattern's whole match; the operator's own spans are the secrets, of an assignment its value.
    found, match = secret_spans(table(spark, sf_dir, "documents")), F.col("base_match_sha256")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", match.alias("base_sha256"), F.col("match_spans").alias("spans"), match,
        F.col("base_sha256").alias("base_value_sha256"), F.col("spans").alias("value_spans"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kolumna.llm.lm_score import scores

    return scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dup": op3_near_dup,
    "op4_mixing": op4_mixing,
    "op5_top_k": op5_top_k,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_lm_score": op10_lm_score,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def license_sql() -> str:
    """The licence scan for DuckDB, with its templates."""
    from kolumna.llm import licenses

    t = licenses.THRESHOLD
    known = sorted({(name, tuple(licenses.grams(x))) for name, x in licenses.TEMPLATES})
    limits = [licenses.bounds(len(g), t) for _, g in known]
    quoted = lambda g: ", ".join(f"'{x}'" for x in g)
    values = ", ".join(f"({k}, '{name}', [{quoted(g)}], {a}, {b})" for k, ((name, g), (a, b)) in enumerate(zip(known, limits)))
    return f"""
WITH t(k, license, g, lo, hi) AS (VALUES {values}),
r AS (SELECT row_number() OVER () AS row, doc_id, regexp_replace(regexp_replace({_AZ}, '[.!?]+[ \\t\\r]+', chr(1), 'g'), '[^a-z0-9\\n\\x01]+', ' ', 'g') AS r FROM documents),
d AS (SELECT row, doc_id, replace(r, chr(1), ' ') AS p, flatten(list_transform(list_filter(string_split(r, chr(10)), lambda x: contains(x, chr(1))), lambda x: string_split(x, chr(1)))) AS sentences FROM r),
u AS (SELECT row, unnest(list_concat(string_split(p, chr(10)), sentences, list_transform(list_filter(string_split_regex(p, '\\n *\\n[ \\n]*'), lambda x: regexp_matches(x, '[a-z0-9] *\\n *[a-z0-9]')), lambda x: replace(x, chr(10), ' ')))) AS u FROM d),
w AS (SELECT row, list_filter(string_split(u, ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT row, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
s AS (SELECT row_number() OVER () AS unit, row, g FROM g WHERE len(g) > 0),
m AS (SELECT unit, row, k, license, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice FROM s JOIN t ON len(s.g) BETWEEN lo AND hi),
b AS (SELECT unit, row, max(dice) AS dice, arg_min(license, k) AS license, min(k) AS k FROM (SELECT *, max(dice) OVER (PARTITION BY unit) AS top FROM m) WHERE dice = top AND dice >= {t} GROUP BY unit, row),
n AS (SELECT row, count(*) AS n_units, max(dice) AS dice FROM b GROUP BY row),
f AS (SELECT b.row, arg_min(b.license, b.k) AS license FROM b JOIN n ON b.row = n.row AND b.dice = n.dice GROUP BY b.row)
SELECT doc_id, coalesce(n_units, 0) AS n_units, license, coalesce(dice, 0.0::DOUBLE) AS dice FROM d LEFT JOIN n USING (row) LEFT JOIN f USING (row)"""


ORACLE_SQL: dict[str, str] = {
    "op3_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, '{_SPACED}') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, sh, len(sh) AS n FROM g),
c AS (SELECT min(doc_id) AS rep, any_value(sh) AS sh, any_value(n) AS n, list_sort(sh) AS k FROM n WHERE n > 0 GROUP BY list_sort(sh)),
u AS (SELECT rep, n, unnest(sh) AS s FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM u a JOIN u b ON a.s = b.s AND a.rep < b.rep
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, z) AS (SELECT rep, rep FROM c UNION SELECT r.x, y.b FROM r JOIN y ON r.z = y.a),
l AS (SELECT x, min(z) AS comp FROM r GROUP BY x),
m AS (SELECT c.k, l.comp FROM c JOIN l ON l.x = c.rep)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.comp, n.doc_id) AS component_id, n.doc_id = coalesce(m.comp, n.doc_id) AS kept
FROM n LEFT JOIN m ON n.n > 0 AND m.k = list_sort(n.sh)""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size FROM documents),
a AS (SELECT source, length(bin(greatest(size, 1))) AS lk, sum(size)::BIGINT AS cs FROM d GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS ss, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT source, ss, [5, 2, 1][k] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * ss / w, source) AS n, sum(3 * ss) OVER u AS caps, sum(w) OVER u AS ws, (SELECT sum(ss) FROM w) AS t, (SELECT sum(w) FROM w) AS wt
      FROM w WINDOW u AS (ORDER BY 3.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT CAST(t - coalesce(caps, 0) AS DOUBLE) / CAST(wt - coalesce(ws, 0) AS DOUBLE) AS share, n FROM o
      WHERE w * (CAST(t - coalesce(caps, 0) AS DOUBLE) / CAST(wt - coalesce(ws, 0) AS DOUBLE)) <= 3 * ss ORDER BY n LIMIT 1),
g AS (SELECT source, ss, least(w * share, CAST(3 * ss AS DOUBLE)) AS target FROM w, r),
b AS (SELECT a.source, lk, target, 3 * coalesce(sum(cs) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(cs * lk) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
      FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source WINDOW v AS (PARTITION BY a.source ORDER BY lk DESC)),
h AS (SELECT source, arg_max((target - CAST(held AS DOUBLE)) / CAST(mass AS DOUBLE), lk) AS rate FROM b WHERE mass > 0 AND (target - CAST(held AS DOUBLE)) / CAST(mass AS DOUBLE) * lk <= 3 GROUP BY source),
e AS (SELECT doc_id, d.source, size, ss, target, CASE WHEN ss > 0 THEN least(coalesce(rate * length(bin(greatest(size, 1))), 3.0::DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS x,
      (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, floor(x) AS whole, x - floor(x) AS p FROM e),
f AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u * (1 - p)) / ((1 - u) * p) END AS odds FROM q),
l AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS lack,
      coalesce(sum(size) FILTER (odds IS NOT NULL) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, size, ss AS source_size, target,
  CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN odds IS NOT NULL AND before + size / 2.0 <= lack THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM l""",
    "op5_top_k": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_license_scan": license_sql(),
    "op7_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_AZ}, '{_ALNUM}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_AZ}, '{_ALNUM}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS l, array_to_string(ws[k : k + least(len(ws), 13) - 1], ' ') AS t
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS k FROM i WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT row, l, k, array_to_string(ws[k : k + l - 1], ' ') AS t
       FROM (SELECT row, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, ls WHERE len(ws) >= l)),
m AS (SELECT row, dw.l, k, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.l = iw.l),
h AS (SELECT row, count(DISTINCT w) AS n_hit FROM (SELECT row, unnest(range(k, k + l)) AS w FROM (SELECT DISTINCT row, l, k FROM m)) GROUP BY row),
n AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)""",
}
