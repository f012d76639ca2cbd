"""The registered queries over the driver's tables and their SQL oracles.

The tables hold invented prose, so several queries build the text that an operator reads from columns (a value and its range, a row of
cells, a question, a citation) for every row of a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docevidence.functions import labs, routing, text
from docevidence.operators import assess, evidence, grounding, quality, reports, retrieval, structure
from docevidence.plans import ingest, store
from docevidence.plans.scratch import saved
from docevidence.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


NORMALIZED = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\f\x0B\x{00A0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@query(f"SELECT doc_id, sha256({NORMALIZED}) AS digest, length({NORMALIZED}) AS n FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("n"))


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"

BLANKS = " || ".join(f"chr({ord(c)})" for c in structure.BLANK)
CUT = " ".join(  # the end of the best separator past 600 characters of the window, by kind
    f"WHEN strpos(reverse(w), reverse({m})) > 0 AND length(w) - strpos(reverse(w), reverse({m})) + 1 - length({m}) >= 600 THEN s + length(w) - strpos(reverse(w), reverse({m})) + 1"
    for m in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
)


#: Chunks of all documents as (doc_id, text, i, n).
CHUNKS = rf"""d AS (SELECT doc_id, {NORMALIZED} AS t, length({NORMALIZED}) AS n FROM documents),
p AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS s, CASE WHEN n <= 1000 THEN n ELSE e END AS e FROM (SELECT *, CASE {CUT} ELSE s + 1000 END AS e FROM (SELECT *, 0 AS s, substr(t, 1, 1000) AS w FROM d WHERE n > 0))
  UNION ALL
  SELECT doc_id, s, CASE WHEN s + 1000 >= n THEN n ELSE CASE {CUT} ELSE s + 1000 END END FROM (
    SELECT *, substr(t, CAST(s + 1 AS BIGINT), 1000) AS w FROM (
      SELECT p.doc_id, d.t, d.n, greatest(p.e - 150 + strpos(substr(d.t, CAST(p.e - 149 AS BIGINT), 150), ' '), p.s + 1) AS s FROM p JOIN d ON d.doc_id = p.doc_id WHERE p.e < d.n)
  )
),
c AS (SELECT p.doc_id, p.s, trim(substr(d.t, CAST(p.s + 1 AS BIGINT), CAST(p.e - p.s AS BIGINT)), {BLANKS}) AS text FROM p JOIN d ON d.doc_id = p.doc_id),
k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE text <> '')"""


@query(f"""
WITH RECURSIVE {CHUNKS}
SELECT doc_id, doc_id || '#' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index, length(text) AS n, left(sha256(text), 16) AS digest, n > 200 AS truncated FROM k WHERE i < 200
""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("seg_idx", F.lit(0))
    out = structure.prepare_chunks(docs, "doc_id", type_col=None)
    return out.select("doc_id", "chunk_id", "chunk_index", F.length("text").alias("n"), text.content_hash(F.col("text"), 16).alias("digest"), "truncated")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to hashed vectors; per benchmark question the best chunks of each source, with a floor and a budget."""
    docs = table(spark, sf_dir, "documents").withColumn("seg_idx", F.lit(0)).withColumn("d", F.struct("doc_id", "source"))
    chunks = structure.prepare_chunks(docs, "d", type_col=None)
    chunks = chunks.select(F.concat_ws("#", F.col("d.doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "d.source", "text", F.length("text").alias("chars"))
    vectors = saved(retrieval.embed_rows(chunks, "chunk_id", "text", 64, ["source", "chars"]), "chunk-vectors")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), "text")
    questions = retrieval.embed_rows(questions, "query_id", "text", 64, ["source"])
    hits = retrieval.vector_topk(questions, vectors, ["source"], 6, vector_id="chunk_id", floor=0.5)
    hits = hits.join(vectors.select("chunk_id", "chars"), "chunk_id")
    return retrieval.prefix_budget(hits, "query_id", ["rank"], F.col("chars"), 8000).select("query_id", "source", "chunk_id", "rank", "score")


@query(f"""
WITH RECURSIVE {CHUNKS},
ch AS (SELECT k.doc_id || '#' || k.i AS id, o.source, k.text, length(k.text) AS chars FROM k JOIN documents o USING (doc_id) WHERE i < 200),
tok AS (SELECT id, CAST(NULL AS BIGINT) AS q, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM ch UNION ALL SELECT CAST(NULL AS VARCHAR), item_id, 'src' || (item_id % 20), unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
o AS (SELECT id, q, source, t, count(*) AS c FROM tok WHERE length(t) > 1 GROUP BY ALL),
w AS (SELECT t, {FNV} AS h FROM (SELECT DISTINCT t FROM o)),
b AS (SELECT id, q, source, h % 64 AS b, sum(CASE WHEN h % 2 = 1 THEN c ELSE -c END) AS v FROM o JOIN w USING (t) GROUP BY ALL),
x AS (SELECT id, q, source, b, CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY id, q) AS DOUBLE)) AS x FROM b WHERE v <> 0),
z AS (SELECT id, q, sqrt(sum(x * x ORDER BY b)) AS n FROM x GROUP BY ALL),
s AS (SELECT q.q, c.id, any_value(q.source) AS source, sum(q.x * c.x ORDER BY q.b) / (any_value(nq.n) * any_value(nc.n)) AS exact FROM x q JOIN x c ON q.b = c.b AND q.source = c.source AND q.q IS NOT NULL AND c.id IS NOT NULL JOIN z nq ON nq.q = q.q JOIN z nc ON nc.id = c.id GROUP BY q.q, c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact DESC, id) AS rank FROM s),
u AS (SELECT r.*, ch.chars, sum(ch.chars) OVER (PARTITION BY q ORDER BY rank) AS total, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM r JOIN ch USING (id) WHERE rank <= 6 AND exact >= 0.5)
SELECT q AS query_id, source, id AS chunk_id, CAST(rank AS INTEGER) AS rank, round(exact, 6) AS score FROM u WHERE n = 1 OR total <= 8000
""")
def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(f"""
WITH tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
h AS (SELECT item_id, {FNV} AS h FROM tok WHERE length(t) > 1),
b AS (SELECT item_id, h % 64 AS bucket, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL)
SELECT item_id, CAST(bucket AS BIGINT) AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS weight FROM b WHERE v <> 0
""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(retrieval.hash_embed(F.col("text"), 64)).alias("bucket", "w"))
    return v.filter("w <> 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("weight"))


TOPK = """
WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, q.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS exact
  FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id % 10 = 0
), r AS (SELECT *, round(exact, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS rank FROM s)
"""


def _hits(spark: SparkSession, sf_dir: str, k: int, floor: float | None = None) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("values"))
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    return retrieval.vector_topk(q, v, ["label"], k, floor=floor)


@query(TOPK + "SELECT query_id, label, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND exact >= 0.1")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5, 0.1)


@query(TOPK + ", b AS (SELECT query_id // 40 AS request, id, max(score) AS score FROM r WHERE rank <= 5 GROUP BY ALL) SELECT request, id, score FROM b")
def best_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _requests(_hits(spark, sf_dir, 5))
    return retrieval.best_per_item(hits, "request", "id", "score")


def _requests(hits: DataFrame) -> DataFrame:
    """Four neighbouring queries make a request of at most 20 hits."""
    return hits.withColumn("request", F.floor(F.col("query_id") / 40))


GREEDY = """
, b AS (SELECT query_id // 40 AS request, id, max(score) AS score, CAST(id % 900 + 100 AS INTEGER) AS chars FROM r WHERE rank <= 5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS k FROM b),
g AS (
  SELECT request, k, id, score, chars, 1 AS n, chars AS used, TRUE AS taken FROM o WHERE k = 1
  UNION ALL
  SELECT o.request, o.k, o.id, o.score, o.chars, g.n + CASE WHEN g.n < 6 AND g.used + o.chars <= 3000 THEN 1 ELSE 0 END,
    g.used + CASE WHEN g.n < 6 AND g.used + o.chars <= 3000 THEN o.chars ELSE 0 END, g.n < 6 AND g.used + o.chars <= 3000
  FROM g JOIN o ON o.request = g.request AND o.k = g.k + 1
)
"""


@query(TOPK.replace("WITH s", "WITH RECURSIVE s") + GREEDY + "SELECT request, CAST(n AS INTEGER) AS n, id, score, chars FROM g WHERE taken")
def greedy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _requests(_hits(spark, sf_dir, 5)).withColumn("chars", (F.col("id") % 900 + 100).cast("int"))
    return retrieval.greedy_budget(hits, "request", "id", "score", "chars", 6, 3000)


@query("""
WITH r AS (SELECT doc_id // 50 AS request, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS rn,
  sum(n_chars) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents)
SELECT request, doc_id, n_chars FROM r WHERE rn = 1 OR s <= 8000
""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 50 ids are the ranked items of a request."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("request"), "doc_id", "n_chars")
    return retrieval.prefix_budget(docs, "request", ["doc_id"], F.col("n_chars"), 8000)


@query(r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM l),
n AS (SELECT source, key, count(DISTINCT doc_id) AS pages FROM k WHERE length(key) BETWEEN 1 AND 199 GROUP BY ALL),
t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY ALL)
SELECT n.source, sha256(key) AS key, pages FROM n JOIN t USING (source) WHERE total >= 6 AND pages / total >= 0.03
""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.running_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", share=0.03)
    return out.select("source", F.sha2("key", 256).alias("key"), "pages")


def _decoded(x: str) -> str:
    """SQL for the named entities, the ampersand last so that an escaped entity is decoded once; the pages have no numeric ones."""
    for name, char in {"lt": "<", "gt": ">", "quot": '"', "apos": "\'\'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "deg": "°", "micro": "µ", "amp": "&"}.items():
        x = f"replace({x}, '&{name};', '{char}')"
    return x


SHOWN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<\s*script[^>]*>.*?<\s*/\s*script\s*>|<\s*style[^>]*>.*?<\s*/\s*style\s*>', ' ', 'gis'), '<\s*/\s*(?:p|div|ul|ol|h[1-6]|li|tr)\s*>|<\s*br\s*/?>', chr(10), 'gi'), '<\s*li[^>]*>', chr(10) || '- ', 'gi'), '<[^>]*>', '', 'g')"
ENDS = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{FEFF}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x{{00A0}}\x{{FEFF}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"

ONE_BLANK, WHOLE_WORDS = r"regexp_replace(y, '[ \t\x{00A0}]+', ' ', 'g')", r"regexp_replace(h, '\s+\S*$', '')"


@query(rf"""
WITH a AS (SELECT page_id, {_decoded(SHOWN.format(_decoded("html")))} AS x FROM pages),
l AS (SELECT page_id, list_transform(string_split(x, chr(10)), lambda y: {ENDS.format(ONE_BLANK)}) AS l FROM a),
t AS (SELECT page_id, {ENDS.format("array_to_string(list_filter(l, lambda y, i: y <> '' OR (i > 1 AND l[i - 1] <> '')), chr(10))")} AS t FROM l),
h AS (SELECT *, left(t, 200) AS h, reverse(left(t, 200)) AS b FROM t),
p AS (SELECT *, greatest(CASE WHEN strpos(b, ' .') > 0 THEN 199 - strpos(b, ' .') ELSE -1 END, CASE WHEN strpos(b, chr(10) || '.') > 0 THEN 199 - strpos(b, chr(10) || '.') ELSE -1 END, CASE WHEN strpos(b, chr(10)) > 0 THEN 200 - strpos(b, chr(10)) ELSE -1 END) AS stop FROM h)
SELECT page_id, sha256(t) AS digest, length(t) AS n, CASE WHEN length(t) <= 200 THEN t WHEN stop > 100 THEN {ENDS.format("left(h, CAST(stop + 1 AS BIGINT))")} ELSE {ENDS.format(WHOLE_WORDS)} END AS head FROM p
""")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("digest"), F.length(t).alias("n"), text.truncate_sentence(t, 200).alias("head"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS value, p_size AS low,
  CASE WHEN l_quantity < p_size THEN 'Low' WHEN l_quantity > p_size + 10 THEN 'High' ELSE 'Normal' END AS flag,
  NOT (l_quantity >= p_size AND l_quantity <= p_size + 10) AS out
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def lab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    value, span = F.concat(F.col("l_quantity").cast("string"), F.lit(" g/dL")), F.concat_ws(" - ", F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"))
    flag = labs.normalize_flag(F.left(labs.flag_from_range(value, span), F.lit(1)))
    return rows.select("l_orderkey", "l_linenumber", labs.result_number(value).alias("value"), labs.parse_range(span)["low"].cast("int").alias("low"), flag.alias("flag")).withColumn("out", labs.lab_is_out(F.col("flag"), F.lit(False)))


@query("""
WITH r AS (SELECT p_partkey // 40 AS doc, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS row_index FROM part)
SELECT doc, 0 AS table_no, CAST(row_index AS INTEGER) AS row_index, p_name AS test, CAST(p_size AS VARCHAR) AS result, CAST(p_size AS DOUBLE) AS numeric_result,
  'mm' AS unit, '1 - 25' AS reference_range, CASE WHEN p_size > 25 THEN 'High' ELSE 'Normal' END AS flag FROM r
""")
def delimited_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(" | ", "p_name", F.col("p_size").cast("string"), F.lit("mm"), F.lit("1 - 25"), F.when(F.col("p_size") > 25, "h").otherwise("wnl"))
    rows = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("r"))
    doc = F.concat_ws("\n", F.lit("Summary"), F.lit("| Test | Result | Unit | Reference range | Flag |"), F.lit("|---|---|---|---|---|"), F.array_join(F.transform("r", lambda s: s["row"]), "\n"), F.lit("End"))
    return structure.delimited_tables(rows.select("doc", doc.alias("text")), "doc", "text").drop("date")


LEVEL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' END"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN NULL ELSE 'failed' END"


def _consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderdate", f"{STATUS} AS status", f"{LEVEL} AS level", "floor(o_totalprice) % 100 AS score")


@query(f"""
SELECT o_custkey, level, count(*) AS n, round_even(avg(floor(o_totalprice) % 100), 1) AS mean_score
FROM (SELECT *, {LEVEL} AS level, {STATUS} AS status FROM orders)
WHERE (status IS NULL OR status NOT IN ('processing', 'failed')) AND level IN ('low', 'medium', 'high') GROUP BY ALL
""")
def risk_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.risk_dashboard(_consultations(spark, sf_dir), "o_custkey", "status", "level", "score")


@query(f"""
SELECT o_custkey, count(*) FILTER ((status IS NULL OR status NOT IN ('processing', 'failed')) AND level IS NOT NULL) AS total,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (coalesce(status, 'completed') = 'completed' AND level IS NULL) AS inconclusive
FROM (SELECT *, {LEVEL} AS level, {STATUS} AS status FROM orders) GROUP BY ALL
""")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard_totals(_consultations(spark, sf_dir), "o_custkey", "status", "level")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '1'))
SELECT o_custkey, o_orderkey, CAST(position AS INTEGER) AS position FROM r WHERE position BETWEEN 4 AND 6
""")
def consultation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return reports.page_of(rows, "o_custkey", "o_orderdate", "o_orderkey", 2, 3, F.col("c_name"), "1").select("o_custkey", "o_orderkey", "position")


@query("""
SELECT event_type, user_id % 5 AS model, count(*) AS calls, count(*) FILTER (value > 90) AS errors, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY ALL
""")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("model", F.col("user_id") % 5)
    return reports.call_stats(rows, ["event_type", "model"], "value", F.col("value") > 90)


@query("""
SELECT CASE WHEN event_id % 5 = 0 THEN 'provider_timeout' WHEN event_id % 5 = 1 THEN 'schema_validation_failure' WHEN event_id % 5 = 2 THEN 'provider_rate_limited'
  WHEN event_id % 5 = 3 THEN 'model_unavailable' ELSE 'provider_failure' END AS category, count(*) AS n FROM events GROUP BY ALL
""")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    name, status = F.when(k == 0, "TimeoutError").when(k == 1, "ZodError").otherwise("Error"), F.when(k == 2, 429).when(k == 3, 404).otherwise(500)
    return reports.failure_counts(table(spark, sf_dir, "events"), reports.classify_error(name, status))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT user_id, event_id, rn, t, t + 7200000000 AS reset, 1 AS n, FALSE AS bad FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, e.t, CASE WHEN e.t > w.reset THEN e.t + 7200000000 ELSE w.reset END,
    CASE WHEN e.t > w.reset THEN 1 WHEN w.n >= 2 THEN w.n ELSE w.n + 1 END, e.t <= w.reset AND w.n >= 2
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
)
SELECT user_id, event_id, CAST(ceil((reset - t) / 1000000.0) AS BIGINT) AS retry_after FROM w WHERE bad
""")
def rate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rate_violations(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 7200, 2)


RANKED = TOPK.replace("ON q.label = v.label AND q.vec_id % 10 = 0", "ON q.vec_id % 10 = 0 AND q.vec_id % 2 = v.vec_id % 2 AND q.vec_id <> v.vec_id").replace("q.label,", "q.label AS ql, v.label AS vl,")


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("space"), F.col("embedding").alias("values"), "label")
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    hits = retrieval.vector_topk(q, v, ["space"], 5, skip_own=True)
    hits = hits.join(q.select("query_id", F.col("label").alias("ql")), "query_id").join(v.select("id", F.col("label").alias("vl")), "id")
    return q, hits.select("query_id", "rank", (F.col("ql") == F.col("vl")).alias("relevant"), "score")


@query(RANKED + """
, f AS (SELECT query_id, min(rank) FILTER (ql = vl) AS first FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, CAST(coalesce(first <= 1, FALSE) AS INTEGER) AS hit_1, CAST(coalesce(first <= 3, FALSE) AS INTEGER) AS hit_3, CAST(coalesce(first <= 5, FALSE) AS INTEGER) AS hit_5,
  coalesce(1.0 / first, 0.0)::DOUBLE AS rr FROM f
""")
def retrieval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, hits = _retrieved(spark, sf_dir)
    return quality.ranking(q, hits, "query_id")


@query("""
WITH s AS (SELECT user_id, max(value) AS top, user_id % 3 <> 0 AS a FROM events GROUP BY ALL), t AS (SELECT unnest([50.0, 90.0, 99.0]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (a) AS answerable, count(*) FILTER (a AND top >= threshold) AS found, count(*) FILTER (NOT a) AS unanswerable,
  count(*) FILTER (NOT a AND top < threshold) AS refused FROM s CROSS JOIN t GROUP BY ALL
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top")).withColumn("a", F.col("user_id") % 3 != 0)
    return quality.threshold_sweep(s, [50.0, 90.0, 99.0], "top", "a").select("threshold", "answerable", "found", "unanswerable", "refused")


@query("""
SELECT event_type, count(value) AS n, min(value) AS least, quantile_disc(value, 0.25) AS p25, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS p75, max(value) AS largest
FROM events GROUP BY ALL
""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
WITH l AS (SELECT quality + toxic AS expected, doc_id % 3 AS predicted FROM labels), c AS (SELECT unnest([0, 1, 2]) AS class)
SELECT class, count(*) FILTER (expected = class) AS support, count(*) FILTER (expected = class AND predicted = class) / nullif(count(*) FILTER (predicted = class), 0)::DOUBLE AS precision,
  count(*) FILTER (expected = class AND predicted = class) / nullif(count(*) FILTER (expected = class), 0)::DOUBLE AS recall FROM l CROSS JOIN c GROUP BY ALL
""")
def classification_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") + F.col("toxic")).alias("e"), (F.col("doc_id") % 3).cast("int").alias("p"))
    return quality.classification(rows, "e", "p", [0, 1, 2])


@query(r"""
WITH p AS (SELECT doc_id AS c, unnest(string_split(lower(text), ' ')) AS t FROM documents), e AS (SELECT item_id AS c, unnest(string_split(lower(text), ' ')) AS t FROM benchmark),
pn AS (SELECT c, t, count(*) AS p FROM p GROUP BY ALL), en AS (SELECT c, t, count(*) AS e FROM e GROUP BY ALL),
b AS (SELECT coalesce(p, 0) AS p, coalesce(e, 0) AS e FROM pn FULL JOIN en USING (c, t)),
s AS (SELECT sum(least(p, e)) AS tp, sum(p - least(p, e)) AS fp, sum(e - least(p, e)) AS fn FROM b)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s
""")
def set_prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents against those of the item with their id; a document without an item is all false positives."""
    words = lambda t, i: table(spark, sf_dir, t).select(F.col(i).alias("c"), F.explode(F.split(F.lower("text"), " ")).alias("t"))
    got = quality.micro_prf(quality.set_counts(words("documents", "doc_id"), words("benchmark", "item_id"), "c", "t"))
    return got.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _question() -> Column:
    word = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    k = F.col("turn") % 5
    return F.when(k == 0, F.concat(F.lit("What is a "), word, F.lit(" test?"))).when(k == 1, F.concat(F.lit("What was the "), word, F.lit("?"))).when(k == 2, F.concat(F.lit("What does "), word, F.lit(" mean?"))).when(k == 3, F.concat(F.lit("Should I treat "), word, F.lit("?"))).otherwise(F.concat(F.lit("Show my "), word))


def _stripped(column: str) -> str:
    """SQL of routing.definition_term's chain on a column."""
    for pattern in (routing.LEADING + routing.TRAILING) * 3:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '')"
    return f"trim({column})"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(rf"""
WITH w AS (SELECT conv_id, turn, turn % 5 AS k, regexp_extract(lower(text), '[a-z]+') AS word FROM conversations),
q AS (SELECT conv_id, turn, lower(CASE k WHEN 0 THEN 'What is a ' || word || ' test?' WHEN 1 THEN 'What was the ' || word || '?' WHEN 2 THEN 'What does ' || word || ' mean?' WHEN 3 THEN 'Should I treat ' || word || '?' ELSE 'Show my ' || word END) AS q FROM w),
t AS (SELECT *, trim(regexp_replace(regexp_replace(trim(q), '(?:[?!.]|\s)+\z', ''), '\s+', ' ', 'g')) AS t FROM q),
d AS (SELECT *, {_stripped("t")} AS term, regexp_matches(t, '{_sql(routing.DEFINITIONAL)}') AND NOT (regexp_matches(t, '^what\s+(?:does|do)\b') AND NOT regexp_matches(t, '\s(?:mean|means|stand|stands)(?:\s+for)?\z')) AS asks,
  regexp_matches(trim(q), '^\s*(?:what|whats|what''s)\s+(?:was|were)\b') OR (regexp_matches(trim(q), '^\s*(?:what|whats|what''s)\s+(?:is|are)\s+the\s') AND NOT regexp_matches(trim(q), '^\s*(?:what|whats|what''s)\s+(?:is|are)\s+the\s+(?:meaning|definition)\b')) AS lookup FROM t),
f AS (SELECT *, asks AND NOT lookup AND term <> '' AND len(list_filter(string_split(term, ' '), lambda x: x <> '')) BETWEEN 1 AND 8 AND length(term) <= 100 AND NOT regexp_matches(term, '^(?:it|that|this|these|those|there|here|more)\z')
  AND NOT regexp_matches(term, '{_sql(routing.PATIENT)}') AND NOT regexp_matches(term, '{_sql(routing.CLINICAL)}') AS defines FROM d)
SELECT conv_id, turn, CASE WHEN defines THEN 'terminology' WHEN regexp_matches(trim(q), '{_sql(routing.CLINICAL)}') THEN 'clinical' ELSE 'report' END AS kind, CASE WHEN defines THEN term END AS term FROM f
""")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routing.classify_question(_question())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r["kind"].alias("kind"), r["term"].alias("term"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "conv_id", "turn", "text")
    k = F.col("conv_id") % 4
    cited = F.when(k == 0, " [R1]").when(k == 1, " [P2, r9]").when(k == 2, " [X1]").otherwise("")
    answers = rows.select("request_id", F.when(F.col("turn") % 2 == 0, "clinical").otherwise("report").alias("kind"), F.concat("text", cited).alias("answer"), F.when(F.col("conv_id") % 8 == 7, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("patient_citations"), F.array().cast("array<string>").alias("reference_citations"), (F.col("turn") == 5).alias("insufficient"))
    have = rows.filter("turn <> 7").select("request_id", F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(i).alias("evidence_id")) for d, i in (("patient", "P1"), ("patient", "P2"), ("reference", "R1"))))).alias("e"), "conv_id")
    return answers, have.select("request_id", "e.*", "conv_id").filter("domain = 'patient' OR conv_id % 3 <> 0").drop("conv_id")


@query(r"""
WITH a AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, text, turn % 2 = 0 AS clinical, turn <> 7 AS ev, turn <> 7 AND conv_id % 3 <> 0 AS r FROM conversations),
v AS (SELECT *, CASE WHEN ev AND conv_id % 4 = 1 THEN 'P2' WHEN r AND conv_id % 4 = 0 THEN 'R1' WHEN ev AND conv_id % 8 = 7 THEN 'P1' END AS valid FROM a),
d AS (SELECT *, CASE WHEN NOT ev THEN 'no_evidence' WHEN clinical AND NOT r THEN 'no_verified_reference' WHEN turn = 5 THEN 'model_reported' WHEN valid IS NULL THEN 'uncited_answer'
  WHEN clinical AND valid <> 'R1' THEN 'clinical_without_reference' END AS reason FROM v)
SELECT request_id, CASE WHEN clinical THEN 'clinical' ELSE 'report' END AS kind, CASE WHEN reason IS NULL THEN 'answered' ELSE 'insufficient_context' END AS status, reason, coalesce(valid, '') AS valid,
  CASE WHEN reason IS NULL THEN sha256(trim(regexp_replace(regexp_replace(text || CASE WHEN conv_id % 4 < 2 THEN ' [' || valid || ']' WHEN conv_id % 4 = 2 THEN ' ' ELSE '' END, '[ \t]{2,}', ' ', 'g'), '\s+([.,;:])', '\1', 'g'))) END AS answer FROM d
""")
def verify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.verify_answers(*_answers(spark, sf_dir))
    return out.select("request_id", "kind", "status", "reason", F.array_join("valid", ",").alias("valid"), F.sha2("answer", 256).alias("answer"))


@query("""
WITH a AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, unnest(CASE conv_id % 4 WHEN 0 THEN ['R1'] WHEN 1 THEN ['P2', 'R9'] ELSE [] END) AS id FROM conversations)
SELECT request_id, CASE WHEN id LIKE 'P%' THEN 'patient' ELSE 'reference' END AS domain, id,
  (id = 'P2' AND turn <> 7) OR (id = 'R1' AND turn <> 7 AND conv_id % 3 <> 0) AS valid FROM a
""")
def match_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, have = _answers(spark, sf_dir)
    ids = answers.select("request_id", F.explode(evidence.inline_citations(F.col("answer"))).alias("id")).filter("id rlike '^[PR]'")
    cited = ids.groupBy("request_id", F.when(F.col("id").startswith("P"), "patient").otherwise("reference").alias("domain")).agg(F.collect_list("id").alias("ids"))
    return evidence.match_citations(cited, have)


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS existing FROM d WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT doc_id, existing FROM d LEFT JOIN f ON d.source = f.source AND d.h = f.h WHERE doc_id % 2 = 1
""")
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd ids are uploads, the even ones are there already."""
    d = table(spark, sf_dir, "documents").select(F.lit("u").alias("user_id"), F.col("doc_id").alias("document_id"), text.content_hash(F.col("text")).alias("sha256"), "source", F.lit("indexed").alias("status"), F.lit("s").alias("embedding_space"))
    new, old = store.split_new(d.filter("document_id % 2 = 1").drop("status", "embedding_space"), d.filter("document_id % 2 = 0"), "s")
    return new.select(F.col("document_id").alias("doc_id"), F.lit(None).cast("bigint").alias("existing")).unionByName(old.select(F.col("document_id").alias("doc_id"), F.col("existing_id").alias("existing")))


@query("""
SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def stale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stale_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM documents
""")
def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.term_key(F.col("text")).alias("key"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9.%<>/ ]+', ' ', 'g'), ' +', ' ', 'g'))) AS digest, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents
""")
def eval_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.eval_normalize(t), 256).alias("digest"), F.sha2(text.escape_markup(t), 256).alias("escaped"))


STOPS = ", ".join(f"'{w}'" for w in grounding.STOP_WORDS)
FOLD = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9.%]+', ' ', 'g'), '\.+( |$)', '\1', 'g'), ' +', ' ', 'g'))"


@query(rf"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS fact
  FROM documents),
f AS (SELECT doc_id, page, {FOLD.format("line")} AS folded, {FOLD.format("fact")} AS needle FROM d),
w AS (SELECT *, list_distinct(list_filter(string_split(folded, ' '), lambda x: x <> '')) AS words,
  list_filter(string_split(needle, ' '), lambda x: length(x) >= 2 AND x NOT IN ({STOPS})) AS toks FROM f WHERE needle <> ''),
h AS (SELECT doc_id, page FROM w WHERE contains(' ' || folded || ' ', ' ' || needle || ' ') OR (len(toks) > 0 AND len(list_filter(toks, lambda t:
  NOT (list_contains(words, t) OR (length(t) >= 4 AND len(list_filter(words, lambda x: length(x) >= 4 AND (starts_with(x, t) OR starts_with(t, x)))) > 0)))) = 0))
SELECT doc_id, count(DISTINCT page) AS pages, CAST(min(page) AS BIGINT) AS first_page FROM h GROUP BY ALL
""")
def ground_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first three words in its lines, one page each."""
    docs = table(spark, sf_dir, "documents")
    pages = grounding.fold_pages(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line")), "doc_id", "page", "line")
    facts = docs.select("doc_id", F.lit(1).alias("fact"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("value"))
    out = grounding.text_pages(facts, pages, "doc_id", "fact", "value", "page")
    return out.select("doc_id", F.size("pages").cast("long").alias("pages"), F.col("pages")[0].cast("long").alias("first_page"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'unsupported_type' WHEN 2 THEN 'extension_mismatch' WHEN 3 THEN 'empty' WHEN 4 THEN 'content_mismatch' ELSE
  CASE WHEN coalesce(text, '') = '' THEN 'empty' END END AS reason, 'src' || '_' || doc_id || CASE doc_id % 6 WHEN 2 THEN '.pdf' ELSE '.txt' END AS safe_name FROM documents
""")
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2-S4 on the documents as uploaded files, with faults by doc_id."""
    k = F.col("doc_id") % 6
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("up\\..src#"), F.col("doc_id").cast("string"), F.when(k == 2, ".pdf").otherwise(".txt")).alias("name"),
        F.when(k == 1, "video/mp4").otherwise("Text/Plain; charset=utf-8").alias("mime"),
        F.when(k == 3, F.lit("").cast("binary")).when(k == 4, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF00")))).otherwise(F.col("text").cast("binary")).alias("content"),
    )
    return files.audit(rows, "name", "mime", "content").select("doc_id", "reason", "safe_name")


@query("""
WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS lvl, value AS v, event_id % 7 AS k, event_id % 5 AS m FROM events),
r AS (SELECT *, CASE WHEN k = 0 THEN 'model_reported' WHEN k = 1 THEN 'no_valid_citation' WHEN m = 0 THEN 'no_reference_evidence'
  WHEN k = 2 THEN 'reference_not_cited' END AS reason FROM e)
SELECT event_id AS request_id, CASE WHEN reason IS NULL THEN 'assessed' ELSE 'insufficient_evidence' END AS status, reason, CASE WHEN reason IS NULL THEN lvl END AS risk_level,
  CASE WHEN reason IS NULL THEN CAST(greatest(CASE lvl WHEN 'low' THEN 0 WHEN 'medium' THEN 40 ELSE 70 END, least(CASE lvl WHEN 'low' THEN 39 WHEN 'medium' THEN 69 ELSE 100 END, floor(v + 0.5))) AS INTEGER) END AS risk_score,
  CASE WHEN k IN (1, 2) THEN 0 ELSE CAST(m = 0 AS INTEGER) + CAST(k = 3 AS INTEGER) END AS dropped FROM r
""")
def verify_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 on recorded outputs made of the events: what is cited and what was there go by event_id."""
    k, m = F.col("event_id") % 7, F.col("event_id") % 5
    cited = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("p1"))).when(k == 3, F.array(F.lit("R1"), F.lit("R9"))).otherwise(F.array(F.lit(" r1")))
    rows = table(spark, sf_dir, "events")
    outputs = rows.select(F.col("event_id").alias("request_id"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("event_id") % 3 + 1).cast("int")).alias("risk_level"), F.col("value").alias("risk_score"), F.lit("A summary of the case [P1].").alias("summary"), cited.alias("cited"), (k == 0).alias("insufficient"))
    outputs = outputs.withColumn("summary", F.when(F.col("request_id") % 7 == 1, "A summary of the case.").otherwise(F.col("summary")))
    there = rows.select(F.col("event_id").alias("request_id"), F.explode(F.when(m == 0, F.array(F.lit("P1"))).otherwise(F.array(F.lit("P1"), F.lit("R1")))).alias("evidence_id"))
    there = there.withColumn("domain", F.when(F.col("evidence_id").startswith("P"), "patient").otherwise("reference"))
    return assess.verify_assessments(outputs, there).select("request_id", "status", "reason", "risk_level", "risk_score", "dropped")


from docevidence.plans import registry_jobs  # noqa: E402, F401  registers its queries here


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
