"""The thin queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm, merkle, mix, pieces, pii, quality, simhash, topk, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


ORACLE["op4_exact_top_k"] = """
WITH flat AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), bad AS (
  SELECT DISTINCT vec_id FROM flat WHERE x IS NULL OR NOT isfinite(x)
), ints AS (
  SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


_PARAGRAPHS = "list_transform(range(1, len(string_split(s, chr(10))) + 1), lambda i: string_split(s, chr(10))[i] || CASE WHEN i < len(string_split(s, chr(10))) THEN chr(10) ELSE '' END)"
_SECTIONS = r"list_concat(regexp_extract_all({t}, '(?s)(?:.*?\n\n+)|(?:.+)'), CASE WHEN {t} = '' OR {t} LIKE '%' || chr(10) || chr(10) THEN [''] ELSE [] END)"
_LEAVES = r"list_transform(regexp_extract_all(p, '(?:\S{1,64}\s*){1,8}|\s+'), lambda x: sha256(x))"


def _tree_sql(t: str, name: str) -> str:
    """Root and distinct nodes of the tree of column ``t``."""
    sections = f"list_transform({_SECTIONS.format(t=t)}, lambda s: list_transform({_PARAGRAPHS}, lambda p: {_LEAVES}))"
    return f"{sections} AS {name}_tree"


def _hashes_sql(name: str) -> str:
    paragraphs = f"list_transform({name}_tree, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ''))))"
    sections = f"list_transform({paragraphs}, lambda s: sha256(array_to_string(s, '')))"
    return (
        f"sha256(array_to_string({sections}, '')) AS {name}_root, flatten({paragraphs}) AS {name}_paragraphs, "
        f"list_distinct(list_concat({sections}, flatten({paragraphs}), flatten(flatten({name}_tree)))) AS {name}_nodes"
    )


def _near_sql(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}_nodes, {b}_nodes)) + CAST({a}_root = {b}_root AS INTEGER)"
    return f"2.0::DOUBLE * ({shared}) / (len({a}_nodes) + len({b}_nodes) + 2.0::DOUBLE)"


ORACLE["op5_document_fingerprints"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), paired AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS o FROM texts WINDOW w AS (ORDER BY doc_id DESC)
), edits AS (
  SELECT doc_id, n, t, o, substr(t, 1, n - n // 2) || substr(o, 1, n // 2) AS e FROM paired
), trees AS (
  SELECT doc_id, n, e, {_tree_sql("t", "own")}, {_tree_sql("o", "next")}, {_tree_sql("e", "edit")} FROM edits
), hashed AS (
  SELECT doc_id, n, e, {_hashes_sql("own")}, {_hashes_sql("next")}, {_hashes_sql("edit")} FROM trees
)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, own_root AS fingerprint, edit_root AS edited_fingerprint,
  {_near_sql("own", "edit")} AS near_edited, {_near_sql("own", "next")} AS near_next,
  CAST(coalesce(list_min(list_filter(range(1, greatest(len(own_paragraphs), len(edit_paragraphs)) + 1),
    lambda i: own_paragraphs[i] IS DISTINCT FROM edit_paragraphs[i])), 0) AS INTEGER) AS first_edit
FROM hashed
"""


@query
def op3_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mixed(table(spark, sf_dir, "documents"), share=(1, 2), epochs=2)
    return out.select("doc_id", "domain", F.col("lang_group").alias("lang"), F.col("source_group").alias("source"), "tokens", "epoch")


def _deal_sql(name: str, parent: list[str], own: str, feed: str) -> str:
    """One level of the water-filling: ``feed`` has parent..., own, cap, weight, budget."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, own])
    order = f"{by} ORDER BY CAST(cap AS DOUBLE) / weight, {own}"
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ({feed})
), {name}_b AS (
  SELECT *, CAST(cap AS HUGEINT) * rest <= CAST(weight AS HUGEINT) * (budget - before) AS filled FROM {name}_a
), {name}_c AS (
  SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0) AS remain,
    sum(CASE WHEN NOT filled THEN weight END) OVER ({by}) AS open
  FROM {name}_b
), {name} AS (
  SELECT {keys}, CASE WHEN filled THEN cap ELSE CAST(weight * remain // open AS BIGINT) END AS got FROM {name}_c
)"""


def _weight_sql(level: str, column: str) -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in mix.WEIGHTS[level].items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


ORACLE["op3_mix_to_target_weights"] = f"""
WITH meta AS (
  SELECT doc_id, 'domain' || coalesce(CAST(CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 3 AS VARCHAR), '_none') AS domain,
    coalesce(lang, '_none') AS lang, coalesce(source, '_none') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D ]+')) AS BIGINT) AS tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 2 AS BIGINT) AS cap,
    {_weight_sql("domain", "domain")} AS w1, {_weight_sql("lang_group", "lang")} AS w2, 1 AS w3
  FROM meta GROUP BY domain, lang, source
), {_deal_sql("d1", [], "domain", "SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, max(w1) AS weight, (SELECT CAST(floor(sum(tokens) / 2) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain").strip()},
{_deal_sql("d2", ["domain"], "lang", "SELECT x.*, got AS budget FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, max(w2) AS weight FROM leaf GROUP BY domain, lang) x JOIN d1 USING (domain)").strip()},
{_deal_sql("d3", ["domain", "lang"], "source", "SELECT domain, lang, source, cap, w3 AS weight, got AS budget FROM leaf JOIN d2 USING (domain, lang)").strip()},
part AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS whole,
    got - CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END * tokens AS part
  FROM leaf JOIN d3 USING (domain, lang, source)
), hashed AS (
  SELECT *, md5('{mix.SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM meta JOIN part USING (domain, lang, source)
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM hashed
), counted AS (
  SELECT *, whole + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END AS n FROM summed
)
SELECT doc_id, domain, lang, source, tokens, unnest(range(n)) AS epoch FROM counted WHERE n > 0
"""


@query
def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(lm.labelled_target(docs, table(spark, sf_dir, "labels")))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.load())
