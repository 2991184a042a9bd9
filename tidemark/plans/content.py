"""Queries on texts, urls and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, urls
from ..operators import evaluation, events, tiles
from .registry import query, read

_DROP = ", ".join(f"'{name}'" for name in urls.TRACKING)


@query(f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS h,
  regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_DROP})) AS q FROM pages)
SELECT page_id, s || '://' || h || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")
def canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("""
SELECT u.page_id, CASE WHEN u.page_id % 5 = 0 THEN 'twitter' WHEN u.page_id % 5 = 1 THEN 'youtube' ELSE 'manual' END AS platform,
  CASE WHEN u.page_id % 5 = 0 THEN u.page_id::VARCHAR WHEN u.page_id % 5 = 1 THEN 'yt_' || lpad(u.page_id::VARCHAR, 11, 'a') ELSE md5(url) END AS item_id FROM pages u""")
def url_identity(spark, sf_dir):
    page = F.col("page_id")
    url = (
        F.when(page % 5 == 0, F.concat(F.lit("https://twitter.com/u/status/"), page.cast("string"), F.lit("?s=20")))
        .when(page % 5 == 1, F.concat(F.lit("https://m.youtube.com/watch?t=1&v="), F.lpad(page.cast("string"), 11, "a"))).otherwise(F.col("url")))
    found = urls.url_identity(url)
    return read(spark, sf_dir, "pages").select("page_id", found["platform"].alias("platform"), found["item_id"].alias("item_id"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
  '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<header\b.*?</header>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_body_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", texts.html_body(F.col("html")).alias("body"))


@query(r"""
WITH t AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.]{2,15}'))) AS word FROM documents)
SELECT word, count(*) AS n FROM t WHERE word NOT IN ('the', 'and', 'for') GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 20""")
def trend_keywords(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(texts.trend_tokens(F.col("text"))).alias("word")).where(~F.col("word").isin("the", "and", "for"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "word").limit(20)


@query(r"""SELECT doc_id, ceil(length(regexp_replace(text, '\s', '', 'g')) * 0.25)::BIGINT AS tokens FROM documents WHERE NOT regexp_matches(text, '[一-鿿]')""")
def token_estimate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(~F.col("text").rlike("[一-鿿]"))
    return docs.select("doc_id", texts.token_estimate(F.col("text")).alias("tokens"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(translate(text, 'eé', '中文'), '\s', '', 'g') AS solid FROM documents)
SELECT doc_id, ceil((length(solid) - length(regexp_replace(solid, '[中文]', '', 'g'))) * 0.625 + length(regexp_replace(solid, '[中文]', '', 'g')) * 0.25)::BIGINT AS tokens FROM t""")
def token_estimate_whole(spark, sf_dir):
    """All documents, with two letters made CJK signs, so that both rates count."""
    text = F.translate("text", "eé", "中文")
    return read(spark, sf_dir, "documents").select("doc_id", texts.token_estimate(text).alias("tokens"))


@query(r"""
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(rtrim(substr(text, 1, 136), ' ') || chr(10) || '...' || chr(10) || ltrim(right(text, 59), ' '), 1, 200) END AS short FROM documents""")
def head_tail_budget(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.head_tail(F.col("text"), 200).alias("short"))


#: Bounds of a histogram's bins.
TENTHS = [n / 10 for n in range(2, 11)]
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"""
SELECT a.vec_id AS q, b.vec_id AS s, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < 50 AND b.vec_id >= 50
WHERE {_COS} >= 0.2 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) <= 5""")
def topk_recall(spark, sf_dir):
    vec = read(spark, sf_dir, "embeddings")
    q = vec.where("vec_id < 50").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    s = vec.where("vec_id >= 50").select(F.col("vec_id").alias("s"), F.col("embedding").alias("sv"))
    return events.top_k(q, s, 5, 0.2).select("q", "s", F.round("cosine", 6).alias("cosine"))


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.5""")
def allpairs_cosine(spark, sf_dir):
    return events.cosine_pairs(read(spark, sf_dir, "embeddings"), 0.5).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(f"""
SELECT CASE WHEN c >= 0.75 THEN 'strong' WHEN c >= 0.70 THEN 'gray' ELSE 'shadow' END AS band, count(*) AS n, count(*) FILTER (same) AS same_label
FROM (SELECT {_COS} AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE c >= 0.65 GROUP BY 1""")
def recall_bands(spark, sf_dir):
    found = tiles.counts(read(spark, sf_dir, "embeddings"), [events.SHADOW, events.GRAY, events.STRONG], "vec_id", "embedding", mark="label")
    band = F.element_at(F.array(F.lit("shadow"), F.lit("gray"), F.lit("strong")), F.col("bin") + 1)
    return found.select(band.alias("band"), "n", F.col("same").alias("same_label"))


@query("""
SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, round(sum(w * x) / sum(w), 6) AS m FROM (
  SELECT label, exp(-(vec_id % 96) / 24.0) AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY label""")
def decayed_centroid(spark, sf_dir):
    weight = F.exp(-(F.col("vec_id") % 96) / events.TAU_HOURS)
    return events.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding", weight, 6)


@query("""
SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(x), 6) AS m FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY label""")
def centroid_by_label(spark, sf_dir):
    return events.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding", digits=6)


def _components(spark, sf_dir):
    vec = read(spark, sf_dir, "embeddings")
    return events.connected(tiles.links(vec, 0.6, "vec_id", "embedding"), vec, "vec_id")


@query(f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= 0.6),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.seen FROM r JOIN e ON r.id = e.a WHERE e.b > r.seen)
SELECT id, min(seen) AS label FROM r GROUP BY id""")
def components_by_threshold(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= 0.6),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.seen FROM r JOIN e ON r.id = e.a WHERE e.b > r.seen),
x AS (SELECT label AS t, (SELECT min(seen) FROM r WHERE r.id = vec_id) AS p FROM embeddings),
c AS (SELECT t, p, count(*) AS n FROM x GROUP BY ALL),
z AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) AS tp, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM c GROUP BY t)) AS st,
  (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS sp, (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY p)) AS top, (SELECT sum(n) FROM c) AS items)
SELECT tp::BIGINT AS tp, (sp - tp)::BIGINT AS fp, (st - tp)::BIGINT AS fn, round(coalesce(tp / nullif(sp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(st, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(sp + st, 0), 0), 6) AS f1, round(top / items, 6) AS purity FROM z""")
def pairwise_cluster_metrics(spark, sf_dir):
    truth = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    return evaluation.pair_metrics(_components(spark, sf_dir).join(truth, "id"), "truth", "label")


@query()
def agglomerative_clusters(spark, sf_dir):
    """Order dependent: items of each window of days, newest first."""
    vec = read(spark, sf_dir, "embeddings").withColumn("window", F.floor(F.col("vec_id") / 500)).withColumn("newest", -F.col("vec_id"))
    return events.agglomerate(vec, "window", "vec_id", ["newest"], "embedding")


@query(f"""
SELECT floor(c * 10) / 10 AS bin, count(*) AS n FROM (SELECT {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label) WHERE c >= 0.2 GROUP BY 1""")
def cosine_histogram(spark, sf_dir):
    """Pairs of one label, of all labels together."""
    found = tiles.counts(read(spark, sf_dir, "embeddings"), TENTHS, "vec_id", "embedding", group="label")
    return found.groupBy(((F.col("bin") + 2) / 10).alias("bin")).agg(F.sum("n").alias("n"))
