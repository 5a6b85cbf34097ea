"""The registered queries: each runs its operator, with production parameters, over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekrank.llm import block_search, bpe, common, decontaminate, exact_dedup, filter_audit, graph, licenses, maxent, minhash, phrase_dedup, quality, suffix_dedup, url_filters

QUERIES: dict = {}
SQL: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def hex_of(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of `documents` inside a 10-word window of a `benchmark` item, and the items found."""
    docs, items = common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark")
    found = decontaminate.decontaminate(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        hex_of(F.concat_ws(",", "items")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


# The rules every page is judged by.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page."""
    pages = common.table(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(spark, URL_RULES)).drop("url")


_FITS = "(host = {h!r} OR ends_with(host, {dot!r})) AND starts_with(path, {p!r})"
_LONGEST = sorted(((r[:r.index("/")], r[r.index("/"):], r, v) for r, v in URL_RULES), key=lambda x: -len(x[2]))
SQL["op1_url_filters"] = (
    "WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
    "parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest) "
    "SELECT page_id, host, path, CASE "
    + " ".join(f"WHEN {_FITS.format(h=h, dot='.' + h, p=p)} THEN '{r}'" for h, p, r, _ in _LONGEST) + " END AS rule, CASE "
    + " ".join(f"WHEN {_FITS.format(h=h, dot='.' + h, p=p)} THEN '{v}'" for h, p, _, v in _LONGEST)
    + " ELSE 'allow' END AS verdict FROM parts")


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of good quality of every document, learned outside the held-out fold."""
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat a 100-byte string from earlier in the corpus."""
    found = suffix_dedup.dedup(common.table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", hex_of(F.col("kept")).alias("kept_sha256"))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in a 50-word window of an earlier document."""
    found = phrase_dedup.dedup(common.table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_of(F.col("kept")).alias("kept_sha256"))


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query
def op3_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole document, and the text they decode to."""
    found = bpe.encode(common.table(spark, folder, "documents"), WORD_BPE, table=bpe.pieces(spark, WORD_BPE))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        hex_of(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hex_of(F.col("decoded")).alias("decoded_sha256"))


@query
def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near-duplicates (five-word shingles, similarity from 0.8) of every document."""
    return minhash.groups(common.table(spark, folder, "documents")).select("doc_id", "class_id")


@query
def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the base phrases and labels of all signature rules in every whole document."""
    found = licenses.scan(common.table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every whole document, learned outside the held-out fold."""
    found = maxent.score(common.table(spark, folder, "documents"), ~maxent.held_out())
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose id is divisible by 20."""
    vectors = graph.usable(common.table(spark, folder, "embeddings"))
    return graph.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays of every group of equal documents, and the digest of every normalised text."""
    return exact_dedup.dedup(common.table(spark, folder, "documents"), digests=True)


SQL["op13_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)"""


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes, misses and hides, for every source and order of the filters."""
    return filter_audit.audit(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))


_LETTERS = "ABCDE"
_STEP_OF = {c: f"CASE WHEN {c.lower()} THEN instr(o, '{c}') ELSE 9 END" for c in _LETTERS}
_FAILS = "CASE letter " + " ".join(f"WHEN '{c}' THEN {c.lower()}" for c in _LETTERS) + " END"
SQL["op11_filter_audit"] = f"""
WITH l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(ws) < {filter_audit.LEAST_WORDS} AS a,
  100 * len(list_distinct(ws)) < {filter_audit.LEAST_DISTINCT} * len(ws) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), y AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t),
orders AS (SELECT o FROM y WHERE {' AND '.join(f"instr(o, '{c}') > 0" for c in _LETTERS)}),
steps AS (SELECT o, CAST(step AS INT) AS step, substr(o, step, 1) AS letter FROM orders, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, o, step, letter, least({', '.join(_STEP_OF.values())}) AS gone, {_FAILS} AS fails,
  {' + '.join(f'CAST({c.lower()} AS INT)' for c in _LETTERS)} AS many, n, good, bad FROM g, steps),
s AS (SELECT part, o, step, letter, coalesce(sum(n) FILTER (WHERE gone > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE fails AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND many = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE gone = step), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE gone = step), 0) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, o AS filter_order, step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in filter_audit.COUNTS[:-1])},
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s"""


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 documents of the highest lexical score for every benchmark item."""
    return block_search.rank(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, '" + CAPITALS + "', '" + CAPITALS.lower() + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op12_lexical_search"] = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS N1, CAST(sum(n) AS BIGINT) AS L1 FROM d),
m AS (SELECT doc_id, 75 + (25 * n * N1) // L1 AS m FROM d, c), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N1 + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c GROUP BY term, N1),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM f JOIN w USING (term) JOIN m USING (doc_id)),
s AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL) JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
