"""Registered queries of the composite jobs and of the smaller functions, with their SQL oracles.

As in registry, the rows an operator reads (a finding, a page's text, a recorded answer) are built from columns, for whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.functions import labs, text
from docevidence.operators import assess, evidence, layout, prompting, quality, reports, retrieval, structure
from docevidence.plans import evaluate, extraction, ingest, questions, store
from docevidence.plans.registry import FNV, TOPK, _hits, _requests, query, table
from docevidence.plans.scratch import saved, shared_dir
from docevidence.sources import vocabulary


@query(TOPK.replace("WITH s", "WITH RECURSIVE s") + """
, b AS (SELECT query_id // 40 AS request, id, max(score) AS score FROM r WHERE rank <= 5 GROUP BY ALL),
i AS (SELECT 'patient' AS domain, 6 AS items, 2000 AS budget, *, -score AS o FROM b UNION ALL SELECT 'reference', 8, 2500, *, -score FROM b WHERE id % 2 = 1 UNION ALL SELECT 'terminology', 4, 1500, *, CAST(id % 7 AS DOUBLE) FROM b WHERE id % 3 = 0),
o AS (SELECT *, id % 900 + 100 AS chars, row_number() OVER (PARTITION BY domain, request ORDER BY o, id) AS k FROM i),
g AS (
  SELECT domain, request, items, budget, k, id, score, 1 AS n, chars AS used, TRUE AS taken FROM o WHERE k = 1
  UNION ALL
  SELECT o.domain, o.request, o.items, o.budget, o.k, o.id, o.score, g.n + CASE WHEN g.n < o.items AND g.used + o.chars <= o.budget THEN 1 ELSE 0 END,
    g.used + CASE WHEN g.n < o.items AND g.used + o.chars <= o.budget THEN o.chars ELSE 0 END, g.n < o.items AND g.used + o.chars <= o.budget
  FROM g JOIN o ON o.domain = g.domain AND o.request = g.request AND o.k = g.k + 1
)
SELECT request, upper(left(domain, 1)) || n AS evidence_id, id, score, id % 900 + 100 AS chars FROM g WHERE taken
""")
def assembled_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.best_per_item(_requests(_hits(spark, sf_dir, 5)), "request", "id", "score")
    items = best.select(F.col("request").alias("request_id"), F.col("id").alias("chunk_id"), F.col("score").alias("similarity"), F.repeat(F.lit("x"), (F.col("id") % 900 + 100).cast("int")).alias("content"))
    terms = items.filter("chunk_id % 3 = 0").withColumn("position", (F.col("chunk_id") % 7).cast("double"))
    out = questions.assemble_evidence(items, items.filter("chunk_id % 2 = 1"), terms, {"patient": (6, 2000), "reference": (8, 2500), "terminology": (4, 1500)})
    return out.select(F.col("request_id").alias("request"), "evidence_id", F.col("chunk_id").alias("id"), F.col("similarity").alias("score"), F.length("content").cast("long").alias("chars"))


@query(r"""
WITH a AS (SELECT conv_id || '-' || turn AS request_id, text, conv_id % 4 AS k, turn % 3 AS m, conv_id % 5 = 0 AS told FROM conversations),
v AS (SELECT *, CASE WHEN m = 0 THEN [] WHEN k = 0 THEN ['T1'] WHEN k = 1 THEN ['T2'] ELSE [] END AS valid, CASE k WHEN 1 THEN ['T9'] WHEN 2 THEN ['P1'] ELSE [] END AS other FROM a),
d AS (SELECT *, CASE WHEN m = 0 THEN 'no_evidence' WHEN told THEN 'model_reported' WHEN len(valid) = 0 THEN 'uncited_answer' END AS reason FROM v)
SELECT request_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'insufficient_context' END AS status, reason, array_to_string(valid, ',') AS valid,
  array_to_string(list_sort(list_concat(other, CASE WHEN m = 0 AND k = 0 THEN ['T1'] WHEN m = 0 AND k = 1 THEN ['T2'] ELSE [] END)), ',') AS invalid,
  CASE WHEN reason IS NULL THEN sha256(trim(regexp_replace(regexp_replace(text || ' [' || valid[1] || '].', '[ \t]{2,}', ' ', 'g'), '\s+([.,;:])', '\1', 'g'))) END AS answer FROM d
""")
def term_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("request_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    k = F.col("conv_id") % 4
    cited = F.when(k == 0, " [t1].").when(k == 1, " [T2, T9].").when(k == 2, " [P1].").otherwise("")
    answers = rows.select("request_id", F.concat("text", cited).alias("answer"), F.when(k == 0, F.array(F.lit(" t1"))).otherwise(F.lit(None)).cast("array<string>").alias("citations"), (F.col("conv_id") % 5 == 0).alias("insufficient"))
    have = rows.filter("turn % 3 <> 0").select("request_id", F.lit("terminology").alias("domain"), F.explode(F.array(F.lit("T1"), F.lit("T2"))).alias("evidence_id"))
    out = questions.verify_term_answers(answers, have)
    return out.select("request_id", "status", "reason", F.array_join("valid", ",").alias("valid"), F.array_join(F.array_sort("invalid"), ",").alias("invalid"), F.sha2("answer", 256).alias("answer"))


@query(r"""
WITH l AS (SELECT l_orderkey, l_suppkey, l_linenumber, 'n' || l_linenumber AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, CASE WHEN l_returnflag = 'N' THEN 'High' WHEN l_returnflag = 'A' THEN 'Normal' END AS flag, l_quantity > 40 AS mark, l_linestatus = 'O' AS spanned, l_partkey FROM lineitem),
f AS (SELECT *, CASE WHEN flag IS NOT NULL THEN flag <> 'Normal' ELSE mark END AS outside FROM l),
a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (outside) AS n_out,
  string_agg('- ' || name || ': ' || value || ' g/L' || CASE WHEN spanned THEN ' (printed range 1 - 40)' ELSE '' END || ' - ' || coalesce(flag, 'abnormal') || ' [p.' || l_linenumber || ']', chr(10) ORDER BY l_linenumber, value, l_partkey, l_suppkey) FILTER (outside) AS o,
  string_agg(name || ' ' || value || ' g/L', '; ' ORDER BY l_linenumber, value, l_partkey, l_suppkey) FILTER (NOT outside) AS i FROM f GROUP BY ALL),
t AS (SELECT o_orderkey, 'STRUCTURED REPORT extracted from the uploaded document' || chr(10) || array_to_string(list_filter([
  CASE WHEN o_custkey % 2 = 0 THEN 'Patient: ' || (o_custkey % 90 + 1) || ' years, Female' END,
  CASE WHEN n > 0 THEN 'Lab values outside the range printed in the report (' || n_out || ' of ' || n || '):' END, o, 'Lab values within range: ' || i, CASE WHEN o_orderkey % 3 = 0 THEN 'Symptoms: cough; fever' END,
  CASE WHEN o_orderstatus = 'F' THEN 'Own assessment (for clinician review, not part of the report): high (score 80). Key findings: one; two' END], lambda x: x IS NOT NULL), chr(10)) AS t, n, o_custkey, o_orderstatus FROM orders LEFT JOIN a ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN n > 0 OR o_custkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderstatus = 'F' THEN sha256(left(t, 6000)) END AS digest FROM t
""")
def structured_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    lab = F.struct(
        F.col("l_linenumber").alias("o"), F.col("l_quantity").cast("int").cast("string").alias("value"), "l_partkey", "l_suppkey", F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("g/L").alias("unit"), F.when(F.col("l_linestatus") == "O", "1 - 40").alias("normal_range"),
        F.when(F.col("l_returnflag") == "N", "High").when(F.col("l_returnflag") == "A", "Normal").alias("flag"), (F.col("l_quantity") > 40).alias("is_abnormal"), F.col("l_linenumber").alias("page"), none.cast("array<int>").alias("pages"),
    )
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(lab)).alias("labs"))
    rows = table(spark, sf_dir, "orders").join(lists, "o_orderkey", "left")
    even, done = F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F"
    details = F.when(even, F.struct((F.col("o_custkey") % 90 + 1).alias("age"), F.lit("Female").alias("gender")))
    report = none.cast("struct<diagnoses:array<string>,scores:array<struct<name:string,result:string>>,measurements:array<struct<name:string,value:string,unit:string>>,dates:array<string>>")
    out = questions.structured_report_text(F.col("labs"), details, report, F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("cough"), F.lit("fever"))), none.cast("array<string>"), F.when(done, "high"), F.lit(80), F.array(F.lit("one"), F.lit("two")))
    return rows.select("o_orderkey", F.sha2(out, 256).alias("digest"))


@query("""
WITH c AS (SELECT *, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, CASE WHEN k <> 4 THEN c_name END AS name, CASE k WHEN 0 THEN 50 WHEN 1 THEN 45 WHEN 2 THEN 61 END::INTEGER AS age,
  CASE k WHEN 0 THEN NULL WHEN 1 THEN 'Male' WHEN 2 THEN 'Other' WHEN 3 THEN 'Female' END AS gender,
  CASE k WHEN 2 THEN 'Somebody Else (2)' WHEN 4 THEN c_mktsegment || ' Person (2)' ELSE '' END AS others FROM c
""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a customer: an age before a combined field, a gender before one, a combined field alone, an age that is none, no fields."""
    k, name = F.col("c_custkey") % 5, F.concat(F.lit("Patient Name (yours) : "), "c_name", F.lit(" |x\n"))
    first = F.when(k == 0, F.concat(name, F.lit("Age: 50"))).when(k == 1, F.concat(name, F.lit("Sex: F"))).when(k == 2, name).when(k == 3, F.concat(name, F.lit("Age: 200\nGender : female"))).otherwise("no fields")
    dear = F.concat(F.lit("\nDear "), "c_mktsegment", F.lit(" Person, hello"))
    second = F.when(k == 0, "Age/Sex: 51/M").when(k == 1, "Age/Sex: 45/M").when(k == 2, "Age/Gender (both): 61 years/Other\nDear Somebody Else (hi)").when(k == 3, "Sex: M").otherwise(dear)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(first, second)).alias("n", "text")).withColumn("page", F.col("n") + 1)
    out = structure.extract_identity(rows, "c_custkey", "page", "text")
    return out.select("c_custkey", "name", "age", "gender", F.array_join(F.transform("other_names", lambda o: F.concat(o["name"], F.lit(" ("), o["page"].cast("string"), F.lit(")"))), ",").alias("others"))


@query("SELECT conv_id, count(DISTINCT turn) AS pages, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY ALL")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_counts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey * 10 - 20 AS age, CASE c_custkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE '' END AS gender, c_custkey % 3 = 0 AS anything FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT age BETWEEN 0 AND 150 THEN 'age' END, CASE WHEN gender = 'x' THEN 'gender' END, CASE WHEN NOT anything THEN 'something' END], lambda x: x IS NOT NULL), ',') AS violations FROM c
""")
def quarantined_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 10 - 20).alias("age"), F.when(k == 0, "Female").when(k == 1, "x").when(k == 3, "").alias("gender"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment")).otherwise(none).alias("symptoms"), none.alias("medicines"), F.lit(None).cast("array<string>").alias("labs"), F.lit(" ").alias("text"), F.lit(None).cast("string").alias("voice"))
    fine, broken = ingest.quarantine(rows, ingest.case_rules())
    return fine.select("c_custkey", F.lit("").alias("violations")).unionByName(broken.select("c_custkey", F.array_join("violations", ",").alias("violations")))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1' AND (doc_id % 3 = 1 OR doc_id % 4 = 2)")
def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("topics", F.array((F.col("doc_id") % 3).cast("string"), F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string"))))
    return retrieval.metadata_filter(rows, {"lang": {"$in": ["en", "fr"]}, "source": {"$eq": "src1"}, "topics": {"$in": ["1", "t2"]}}).select("doc_id")


@query("""
SELECT event_id, CASE WHEN value * 4 = floor(value * 4) THEN floor(value * 10 + 0.5) / 10 ELSE CAST(printf('%.1f', value) AS DOUBLE) END AS one,
  CAST(printf('%.4f', value / 7) AS DOUBLE) AS four, CAST(printf('%.2f', 1 + value / 1000) AS DOUBLE) AS two FROM events
""")
def fixed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.fixed_round(F.col("value"), 1).alias("one"), text.fixed_round(F.col("value") / 7, 4).alias("four"), text.fixed_round(1 + F.col("value") / 1000, 2).alias("two"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS us, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS ymd, CASE o_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Other' END AS gender,
  lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS name, left(o_orderpriority, 6) AS clipped, length(o_orderpriority) > 6 AS truncated, 'seen ' || CASE WHEN o_custkey % 2 = 0 THEN '[patient]' ELSE 'Maryland' END || ' today' AS scrubbed,
  CASE WHEN o_custkey % 2 = 0 THEN 'a|b' ELSE 'a' END AS strings, 'x' || chr(10) || 'a | b' AS lines FROM orders
""")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    part = lambda f: F.date_format("o_orderdate", f)
    k, even = F.col("o_custkey") % 4, F.col("o_custkey") % 2 == 0
    clip = text.clip(F.col("o_orderpriority"), 6)
    return rows.select(
        "o_orderkey", text.us_date_to_iso(F.concat(part("M/d/yyyy"), F.lit(" 10:00"))).alias("us"), text.ymd_date(part("yyyy"), F.when(F.col("o_orderkey") % 3 < 2, part("M")), F.when(F.col("o_orderkey") % 3 == 0, part("d"))).alias("ymd"),
        text.normalize_gender(F.when(k == 0, " M").when(k == 1, "female").when(k == 2, "OTHER").otherwise("unknown")).alias("gender"), text.normalize_name(F.col("o_orderpriority")).alias("name"), clip["text"].alias("clipped"), clip["truncated"].alias("truncated"),
        text.scrub_name(F.concat(F.lit("seen "), F.when(even, "MARY").otherwise("Maryland"), F.lit(" today")), F.lit("Mary Jo")).alias("scrubbed"), F.array_join(text.clean_strings(F.array(F.lit(" a "), F.lit(None).cast("string"), F.when(even, "b").otherwise("  "))), "|").alias("strings"), text.strip_table_lines(F.lit("x\na | b\na | b | c")).alias("lines"),
    )


@query("""
WITH p AS (SELECT p_partkey, p_name, p_type, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN '' ELSE p_type END AS other FROM part),
n AS (SELECT p_partkey, p_name AS a, trim(lower(replace(other, '!', ' '))) AS b, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(other), '[^a-z0-9]', '', 'g') AS y FROM p)
SELECT p_partkey, CASE WHEN b = '' THEN FALSE ELSE a = b OR (length(b) >= 3 AND length(b) <= length(a) AND contains(a, b)) OR (length(a) >= 3 AND length(a) <= length(b) AND contains(b, a)) END AS alike, x <> '' AND y <> '' AND (x = y OR (least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x)))) AS same, p_partkey % 4 = 0 AS aliased FROM n
""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k == 1, F.split("p_name", " ")[1]).when(k == 2, "").otherwise(F.col("p_type"))
    aliases = text.unique_aliases(F.col("p_name"), F.array(F.col("p_name"), F.lit(" "), F.when(k == 0, "Own  name").otherwise(F.upper("p_name"))))
    return table(spark, sf_dir, "part").select("p_partkey", text.fuzzy_match(F.col("p_name"), other).alias("alike"), F.coalesce(labs.same_test(F.col("p_name"), other), F.lit(False)).alias("same"), (F.array_join(aliases, "|") == "Own name").alias("aliased"))


@query("""
SELECT event_id, CAST(printf('%.4f', value / 700) AS DOUBLE) AS similarity, CASE WHEN event_id % 2 = 0 THEN repeat('y', 600) || '…' ELSE 'short' END AS excerpt FROM events
""")
def citation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 700).alias("similarity"), F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("y"), F.lit(601))).otherwise("short").alias("content"))
    return evidence.citation_record(rows)


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT user_id, string_agg('<evidence id="P' || n || '" kind="' || event_type || '">' || chr(10) || 'a&lt;' || event_id || chr(10) || '</evidence>', chr(10) ORDER BY n) AS block FROM e WHERE n <= 5 GROUP BY ALL)
SELECT user_id, sha256(left('Q ' || user_id || ': ' || block, 300)) AS prompt, length('Q ' || user_id || ': ' || block) > 300 AS truncated FROM b
""")
def evidence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), 1, 5).alias("e"))
    rows = rows.select("user_id", F.posexplode("e").alias("n", "e")).select("user_id", F.concat(F.lit("P"), (F.col("n") + 1).cast("string")).alias("evidence_id"), F.col("e.event_type").alias("kind"), F.concat(F.lit("a<"), F.col("e.event_id").cast("string")).alias("content"))
    out = prompting.prompt_table(rows.select("user_id").distinct(), prompting.evidence_block(rows, "user_id", ["kind"]), "user_id", "Q {user_id}: {block}", most_chars=300)
    return out.select("user_id", F.sha2("prompt", 256).alias("prompt"), "truncated")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'malformed' WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) > 50 THEN 'k' ELSE '' END AS violations, CASE WHEN event_id % 4 <> 0 AND CAST(regexp_extract(props, '[0-9]+') AS INTEGER) <= 50 THEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS k FROM events
""")
def parsed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "not json").otherwise(F.col("props")).alias("raw"))
    return prompting.parse_output(rows, "raw", "k int", {"k": F.col("parsed.k") <= 50}).select("event_id", F.array_join("violations", ",").alias("violations"), "parsed.k")


@query("SELECT event_id AS request_id, CASE event_id % 5 WHEN 1 THEN 'F1' ELSE 'F2' END AS finding_id, CASE event_id % 5 WHEN 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS share FROM events WHERE event_id % 5 IN (1, 2)")
def traced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("request_id", F.col("event_id"))
    claims = rows.select("request_id", F.concat(F.lit("Märker 1"), (F.col("event_id") % 5).cast("string"), F.lit(" is high today")).alias("claim"))
    cases = rows.select("request_id", F.array(F.lit("Marker 11 is high"), F.lit(" "), F.lit("marker 12 is HIGH today"), F.lit("marker 13")).alias("parts"))
    return assess.trace_findings(claims, assess.numbered_findings(cases, "request_id", [F.col("parts")]), "request_id", "claim").drop("claim")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS summary, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 END AS risk_score,
  o_orderkey % 4 = 0 AS marked, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' END AS legacy, CASE WHEN o_orderkey % 5 = 1 THEN 'retired' ELSE 'indexed' END AS source_status FROM orders
""")
def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P17 and P18 on the orders as consultations."""
    o = table(spark, sf_dir, "orders")
    results = o.filter("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_orderpriority").alias("summary"), F.lit("low").alias("risk_level"), (F.col("o_orderkey") % 100).alias("risk_score"), F.when(F.col("o_orderstatus") != "F", "provider_timeout").alias("failure_category"))
    state = assess.lifecycle(o.select("o_orderkey"), results, "o_orderkey").select("o_orderkey", "status", "summary", "risk_score")
    old = o.select("o_orderkey", F.lit(None).cast("string").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "none").otherwise("text").alias("summary"), F.lit("low").alias("risk_level"), (F.col("o_orderkey") % 4).alias("risk_score"))
    marked = assess.mark_legacy_failures(old, "none").select("o_orderkey", "marked", F.col("status").alias("legacy"))
    sources = store.retire_source(o.select("o_orderkey", (F.col("o_orderkey") % 5).cast("string").alias("source_id"), F.lit("indexed").alias("status")), "1").select("o_orderkey", F.col("status").alias("source_status"))
    return state.join(marked, "o_orderkey").join(sources, "o_orderkey")


@query("""
WITH e AS (SELECT user_id, CASE WHEN event_id % 11 < 9 THEN 'provider_failure' ELSE 'provider_timeout' END AS c, value FROM events),
g AS (SELECT user_id, count(DISTINCT c) AS n, min(c) AS c, max(value) AS top FROM e GROUP BY ALL)
SELECT user_id, CASE WHEN n = 1 THEN c ELSE 'fallback_exhausted' END AS outcome, coalesce(CASE WHEN user_id % 3 = 0 THEN top END, 0.0) AS top_score, CASE user_id % 4 WHEN 0 THEN 'no_documents' WHEN 1 THEN 'no_matches' WHEN 2 THEN 'below_threshold' ELSE 'ok' END AS status FROM g
""")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = reports.attempt_outcome(e.withColumn("c", F.when(F.col("event_id") % 11 < 9, "provider_failure").otherwise("provider_timeout")), "user_id", "c")
    users = e.select("user_id").distinct()
    top = retrieval.top_score(users, e.filter("user_id % 3 = 0"), "user_id", "value")
    k = F.col("user_id") % 4
    status = retrieval.retrieval_status(users, k, F.greatest(k - 1, F.lit(0)), F.greatest(k - 2, F.lit(0)))
    return outcome.join(top, "user_id").join(status, "user_id")


@query("""
WITH q AS (SELECT doc_id AS q, quality = 1 AS answerable, toxic = 1 AS relevant, doc_id % 10 / 10.0 AS score FROM labels)
SELECT count(*) FILTER (answerable) AS answerable, avg(CASE WHEN answerable THEN CAST(relevant AS INTEGER) END) AS hit_1, avg(CASE WHEN answerable THEN CAST(relevant AS INTEGER) END) AS mrr,
  avg(CASE WHEN answerable THEN CAST(score >= 0.5 AS INTEGER) END) AS success, avg(CASE WHEN NOT answerable THEN CAST(score < 0.5 AS INTEGER) END) AS rejection FROM q
""")
def retrieval_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("q"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("relevant"), (F.col("doc_id") % 10 / 10.0).alias("score"), F.lit(1).alias("rank"))
    return quality.retrieval_report(rows.select("q", "answerable"), rows.select("q", "rank", "relevant", "score"), "q", 0.5, (1,)).select("answerable", "hit_1", "mrr", "success", "rejection")


@query("""
WITH a AS (SELECT conv_id, turn, text, turn % 2 = 0 AS answerable, conv_id % 3 <> 0 AS answered FROM conversations)
SELECT avg(CASE WHEN answerable THEN CAST(conv_id % 2 = 0 AS INTEGER) END) AS source_cited, avg(CASE WHEN answerable THEN CAST(answered AND contains(lower(text), 'th') AS INTEGER) END) AS contains_expected,
  avg(CASE WHEN NOT answerable THEN CAST(NOT answered AS INTEGER) END) AS unanswerable_handled, avg(CASE WHEN answered THEN CAST(conv_id % 2 = 0 AS INTEGER) END) AS answered_with_citation FROM a
""")
def answer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("turn") % 2 == 0).alias("answerable"), F.when(F.col("conv_id") % 3 != 0, "answered").otherwise("insufficient_context").alias("status"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("cited"), F.lit("s").alias("expected_source"), F.col("text").alias("answer"), F.array(F.lit("TH")).alias("contains"))
    return quality.answer_report(rows)


@query("""
WITH e AS (SELECT event_id, event_type AS c, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE 'other' END AS o FROM events)
SELECT c AS category, count(*) AS n, avg(CAST(coalesce(c = o, FALSE) AS INTEGER)) AS accuracy FROM e GROUP BY ALL
""")
def failure_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    observed = e.filter("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("other").alias("category"))
    return quality.failure_report(e.select("event_id", F.col("event_type").alias("category")), observed, "event_id", "category")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, count(f.l_suppkey) / count(*)::DOUBLE AS recall, count(f.l_suppkey) = count(*) AS "full" FROM e LEFT JOIN f USING (l_orderkey, l_suppkey) GROUP BY ALL
""")
def source_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return quality.source_recall(rows, rows.filter("l_returnflag <> 'N'"), "l_orderkey", "l_suppkey")


@query("""
SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'c1' END AS consultation_id, FALSE AS missing FROM orders
UNION ALL SELECT o_orderkey, NULL, TRUE FROM orders WHERE o_custkey % 2 <> 0 AND o_orderkey % 3 = 0
""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 2).cast("string").alias("user_id"))
    linked, missing = ingest.link_documents(docs.filter("document_id % 3 = 0").select("document_id"), docs, "0", "c1")
    return linked.select("document_id", "consultation_id", F.lit(False).alias("missing")).unionByName(missing.select("document_id", F.lit(None).cast("string").alias("consultation_id"), F.lit(True).alias("missing")))


@query("""
WITH k AS (SELECT p_partkey, p_name AS key, 0 AS pos FROM part UNION ALL SELECT p_partkey, lower(replace(p_brand, '#', ' ')), 1 FROM part),
h AS (SELECT s_suppkey AS q, p_partkey AS record_id, min(pos) AS pos FROM supplier JOIN k ON key = CASE s_suppkey % 2 WHEN 0 THEN 'cold widget' ELSE 'brand ' || (s_suppkey % 25 + 1) END GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos, record_id) AS rank FROM h)
SELECT q, record_id, CAST(rank AS INTEGER) AS rank, CASE pos WHEN 0 THEN 'exact_term' ELSE 'exact_alias' END AS match FROM r WHERE rank <= 6
""")
def exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vocabulary.alias_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("term"), F.array("p_brand").alias("aliases")))
    key = F.when(F.col("s_suppkey") % 2 == 0, "cold widget").otherwise(F.concat(F.lit("brand "), (F.col("s_suppkey") % 25 + 1).cast("string")))
    return vocabulary.exact_lookup(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("q"), F.array(key).alias("keys")), terms, "q", "keys")


@query("""
WITH c AS (SELECT conv_id, turn, turn % 4 AS k FROM conversations),
n AS (SELECT conv_id, string_agg('f page ' || turn || ': ' || CASE k WHEN 1 THEN 'no text layer (scanned).' WHEN 2 THEN 'contains 3 embedded image(s).' ELSE 'no extractable content.' END, '|' ORDER BY turn) FILTER (k > 0) AS notes, bool_or(k IN (1, 2)) OR bool_and(k = 3) AS needs_model FROM c GROUP BY ALL)
SELECT conv_id, coalesce(notes, '') AS notes, needs_model FROM n
""")
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit("f").alias("name"), F.col("turn").alias("page"), F.when(k == 0, "text").when(k == 1, "scanned").when(k == 2, "mixed").otherwise("empty").alias("status"), F.when(k == 2, 3).otherwise(0).alias("images"))
    return extraction.page_notes(pages).select(F.col("doc").alias("conv_id"), F.array_join("notes", "|").alias("notes"), "needs_model")


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'See 2001;12: 3 and 1999; 4(2) and 2010;5:1' ELSE 'text' END AS t FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index, turn FROM c WHERE turn % 3 <> 1 OR turn % 2 = 0
""")
def without_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("int").alias("chunk_index"), F.when(F.col("turn") % 3 == 1, "See 2001;12: 3 and 1999; 4(2) and 2010;5:1").otherwise("text").alias("text"), F.when(F.col("turn") % 2 == 0, "table").otherwise("text").alias("kind"))
    return structure.drop_bibliography(rows, "conv_id", "chunk_index", "text", "kind").select("conv_id", "chunk_index", "turn")


@query("""
WITH c AS (SELECT conv_id, turn, max(CASE WHEN turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN s IS NOT NULL THEN 'Part ' || s END AS section, 'body ' || turn || CASE WHEN turn % 3 = 1 THEN '' ELSE '' END AS text FROM c
""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading on every third page; a heading at a page's end is lost."""
    body = F.concat(F.lit("body "), F.col("turn").cast("string"))
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# Part "), F.col("turn").cast("string"), F.lit("\n"), body)).when(F.col("turn") % 3 == 1, F.concat(body, F.lit("\nLAST AND LOST"))).otherwise(body)
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("text"))
    return structure.split_sections(pages, "conv_id", "text", "turn").select("conv_id", "turn", "section", "text")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'unknown_document' ELSE 'invalid_page' END AS violation FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 <> 3 AND (o_orderkey % 2 = 1 OR o_custkey % 5 > 3))
""")
def gold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("d1", "text", ["a"]), ("d2", "pdf_text", ["a", "b", "c"])], "id string, source string, pages array<string>")
    k = F.col("o_orderkey") % 4
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "d0").when(k == 1, "d1").when(k == 2, "d2").alias("expectedDocumentId"), F.greatest(F.col("o_custkey") % 5, F.lit(1)).cast("int").alias("expectedPage"))
    return evaluate.gold_violations(docs, asked).select(F.col("id").alias("o_orderkey"), "violation")


@query("""
WITH h AS (SELECT c_custkey, c_custkey % 3 > 0 AS must, c_mktsegment AS t, c_acctbal / 10000 AS score FROM customer)
SELECT must AS must_hit, count(*) AS probes, count(*) FILTER (must AND t = 'FURNITURE') AS hits, min(score) AS least, max(score) AS largest FROM h GROUP BY ALL
""")
def term_probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    probes = c.select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 3 > 0, "furnit").alias("expected"))
    hits = c.select(F.col("c_custkey").alias("query_id"), F.lower("c_mktsegment").alias("term"), F.lit(None).cast("array<string>").alias("aliases"), (F.col("c_acctbal") / 10000).alias("score"), F.lit(1).alias("position"))
    return evaluate.term_probes(probes, hits)[1]


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS v, l_quantity, l_returnflag AS f FROM lineitem),
a AS (SELECT l_orderkey, string_agg('analyte' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INTEGER) || CASE f WHEN 'N' THEN ' High' ELSE ' Low' END, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, v) FILTER (f <> 'A') AS o, string_agg('analyte' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INTEGER), '|' ORDER BY l_linenumber, l_partkey, l_suppkey, v) FILTER (f = 'A') AS i FROM l GROUP BY ALL)
SELECT l_orderkey, array_to_string(list_slice(list_concat(list_concat(coalesce(x.o, []), ['written']), coalesce(x.i, [])), 1, 6), '|') AS queries
FROM (SELECT l_orderkey, CASE WHEN o IS NOT NULL THEN string_split(o, '|') END AS o, CASE WHEN i IS NOT NULL THEN string_split(i, '|') END AS i FROM a) x
""")
def case_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 on an order's lines as labs, each under a name of its own."""
    name = F.concat(F.lit("analyte"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.col("l_quantity").cast("int").cast("string")))
    flag = F.when(F.col("l_returnflag") == "N", "High").when(F.col("l_returnflag") == "R", "Low").otherwise("Normal")
    lab = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), name.alias("name"), flag.alias("flag"), F.lit(False).alias("is_abnormal"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(lab)).alias("labs"))
    return rows.select("l_orderkey", F.array_join(assess.finding_queries(F.col("labs"), F.array(F.lit(" written ")), F.array(F.lit(""))), "|").alias("queries"))


@query("""
SELECT 'user-' || (doc_id % 7) AS namespace, doc_id || '#' || (doc_id % 3) AS id, doc_id % 7 || '' AS user_id, CAST(doc_id % 3 AS INTEGER) AS chunk_index, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0
""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    owners = d.filter("doc_id % 2 = 0").select("document_id", (F.col("doc_id") % 7).cast("string").alias("user_id"), F.lit("f").alias("filename"))
    chunks = d.select("document_id", (F.col("doc_id") % 3).cast("int").alias("chunk_index"), "text")
    return ingest.chunk_metadata(chunks, owners, "s").select("namespace", "id", "user_id", "chunk_index", F.sha2("text", 256).alias("digest"))


@query(f"""
WITH v AS (SELECT 'mesh:' || p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS nk, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS bk, p_name || ' (also called ' || p_brand || '): ' || p_name || ' ' || p_type || ' of size ' || p_size AS text FROM part),
q AS (SELECT DISTINCT 'What is a ' || t || '?' AS q, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS k, lower(t) AS text FROM (SELECT p_name AS t FROM part UNION SELECT p_brand FROM part)),
tok AS (SELECT id, NULL AS q, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM v UNION ALL SELECT NULL, q, unnest(regexp_extract_all(text, '[a-z0-9]+')) FROM q),
h AS (SELECT id, q, {FNV} AS h FROM tok WHERE length(t) > 1),
b AS (SELECT id, q, h % 64 AS b, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL),
x AS (SELECT id, q, b, CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY id, q) AS DOUBLE)) AS x FROM b WHERE v <> 0),
n AS (SELECT id, q, sqrt(sum(x * x ORDER BY b)) AS n FROM x GROUP BY ALL),
s AS (SELECT q.q, c.id, sum(q.x * c.x ORDER BY q.b) / (any_value(nq.n) * any_value(nc.n)) AS exact FROM x q JOIN x c ON q.b = c.b AND q.q IS NOT NULL AND c.id IS NOT NULL JOIN n nq ON nq.q = q.q JOIN n nc ON nc.id = c.id GROUP BY q.q, c.id),
e AS (SELECT q.q, v.id, coalesce(s.exact, 0) AS exact, row_number() OVER (PARTITION BY q.q ORDER BY coalesce(s.exact, 0) DESC, v.id) AS n FROM q JOIN v ON q.k = v.nk OR q.k = v.bk LEFT JOIN s ON s.q = q.q AND s.id = v.id),
m AS (SELECT q, id, exact, row_number() OVER (PARTITION BY q ORDER BY exact DESC, id) AS n FROM s),
a AS (SELECT q, id, round(exact, 6) AS score, TRUE AS by_key FROM e WHERE n <= 6 UNION ALL SELECT q, id, round(exact, 6), FALSE FROM m WHERE n <= 4),
k AS (SELECT a.*, CASE WHEN q.k = v.nk THEN 0 WHEN q.k = v.bk THEN 1 ELSE 2 END AS kind FROM a JOIN q USING (q) JOIN v USING (id)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY kind, score DESC) AS n FROM k WHERE kind < 2 OR (NOT by_key AND score >= 0.7)) WHERE n = 1)
SELECT q AS query_id, id, ['exact_term', 'exact_alias', 'semantic'][kind + 1] AS match, score, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, score DESC, id) AS INTEGER) AS position FROM o
""")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as a vocabulary, a definition question for each of their kinds and brands."""
    parts = table(spark, sf_dir, "part")
    records = parts.select(F.concat(F.lit("mesh:"), F.col("p_partkey").cast("string")).alias("record_id"), F.col("p_name").alias("term"), F.array("p_brand").alias("aliases"), F.concat_ws(" ", "p_name", "p_type", F.lit("of size"), F.col("p_size").cast("string")).alias("definition"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("published"), F.lit(None).cast("string").alias("mesh_id"))
    terms = saved(ingest.term_vectors(records, "mesh", "Parts", "Shop", "1", "hash@64", 64), "terms")
    asked = parts.select(F.explode(F.array("p_name", "p_brand")).alias("t")).distinct().select(F.concat(F.lit("What is a "), "t", F.lit("?")).alias("question"))
    return questions.retrieve_terms(asked.withColumn("query_id", F.col("question")), terms, "hash@64", 64)[0].select("query_id", "id", "match", "score", "position")


LAB_LINES = """
l AS (SELECT l_orderkey AS doc, l_linenumber, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item, 'analyte ' || chr(64 + l_linenumber) AS name, CAST(l_quantity AS INTEGER) AS v, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value,
  CASE WHEN CAST(l_quantity AS INTEGER) < 10 THEN 'Low' WHEN CAST(l_quantity AS INTEGER) > 40 THEN 'High' ELSE 'Normal' END AS flag, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS no FROM lineitem),
t AS (SELECT * FROM l WHERE l_returnflag = 'R')"""


def _lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a lab of a document."""
    item = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), item.alias("item"), F.concat(F.lit("analyte "), F.chr(F.col("l_linenumber") + 64)).alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("g/L").alias("unit"), F.lit("10 - 40").alias("normal_range"), F.lit(False).alias("is_abnormal"), "l_linenumber", "l_returnflag")


def _lab_page(line: DataFrame) -> DataFrame:
    """An order's odd lines as a page's text."""
    shown = F.concat_ws(" ", "name", "value", F.lit("10 - 40"))
    return line.filter("l_linenumber % 2 = 1").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(shown)), "\n").alias("text"))


def _lab_table(line: DataFrame) -> DataFrame:
    """An order's returned lines as a table on page 2."""
    return line.filter("l_returnflag = 'R'").select("doc", "item", F.col("name").alias("test"), F.col("value").alias("result"), "unit", F.col("normal_range").alias("reference_range"), F.lit(None).cast("string").alias("flag"), F.lit(2).alias("page"))


@query(f"""
WITH {LAB_LINES},
p AS (SELECT doc, list_concat(list(value), ['10', '40']) AS words FROM l WHERE l_linenumber % 2 = 1 GROUP BY doc),
m AS (SELECT l.*, p.words IS NOT NULL AS readable, coalesce(list_contains(p.words, l.value), FALSE) AS hit FROM l LEFT JOIN p USING (doc) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = l.doc AND t.name = l.name))
SELECT doc, item, name, value, '10 - 40' AS normal_range, flag, 'printed_range' AS flag_source, 2 AS page, 'table' AS source, 'kept' AS outcome FROM t
UNION ALL
SELECT doc, item, name, value, CASE WHEN hit OR NOT readable THEN '10 - 40' END, CASE WHEN hit OR NOT readable THEN flag END, CASE WHEN hit OR NOT readable THEN 'printed_range' ELSE 'model' END, CASE WHEN hit THEN 1 END,
  CASE WHEN hit THEN 'text_match' ELSE 'model' END, CASE WHEN hit OR NOT readable THEN 'kept' WHEN doc % 2 = 0 THEN 'unverified' ELSE 'dropped' END FROM m
""")
def verified_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a document whose page 1 prints its odd lines and whose table has its returned ones; all lines are claimed."""
    line = _lab_lines(spark, sf_dir)
    documents = line.select("doc").distinct().withColumn("model_only", F.col("doc") % 2 == 0)
    out = extraction.verify_labs(line.drop("l_linenumber", "l_returnflag"), _lab_page(line).withColumn("page", F.lit(1)), _lab_table(line), documents)
    return out.select("doc", "item", "name", "value", "normal_range", "flag", "flag_source", "page", "source", "outcome")


@query(f"""
WITH {LAB_LINES},
o AS (SELECT o_orderkey AS doc, o_orderpriority AS priority, left(o_orderpriority, 1) AS digit, 'Clerk#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS clerk, CAST(o_custkey % 50 AS VARCHAR) AS v, 'drug ' || (o_custkey % 10) AS drug, o_orderkey % 2 = 0 AS model_only FROM orders),
p AS (SELECT o.doc, list_concat(list(l.value) FILTER (l.value IS NOT NULL), CASE WHEN count(l.value) > 0 THEN ['10', '40'] ELSE [] END, [o.digit]) AS words, string_agg(l.name || ' ' || l.value || ' 10 - 40', chr(10) ORDER BY l.name || ' ' || l.value || ' 10 - 40') AS lines
  FROM o LEFT JOIN l ON l.doc = o.doc AND l.l_linenumber % 2 = 1 GROUP BY o.doc, o.digit),
d AS (SELECT o.*, p.words, p.lines, concat_ws(chr(10), 'Priority ' || priority || ' status', CASE WHEN o.doc % 3 = 0 THEN clerk END, p.lines) AS text FROM o JOIN p USING (doc)),
m AS (SELECT l.*, list_contains(d.words, l.value) AND d.lines IS NOT NULL AS hit, d.model_only FROM l JOIN d USING (doc) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = l.doc AND t.name = l.name)),
i AS (
  SELECT doc, 1 AS k, no, 'Lab: ' || name || ' ' || value || ' g/L' AS said FROM m WHERE NOT hit
  UNION ALL SELECT doc, 2, 1, 'Symptom: ' || clerk FROM d WHERE doc % 3 <> 0
  UNION ALL SELECT doc, 3, 0, 'Medicine: ' || drug FROM d
  UNION ALL SELECT doc, 6, 0, 'Measurement: status ' || v FROM d WHERE NOT list_contains(words, v)
), u AS (SELECT doc, count(*) AS n, list(said ORDER BY k, no) AS said FROM i GROUP BY doc),
b AS (
  SELECT doc, 0 AS k, 't' || item AS place, name || '=' || value || ' ' || flag || ' table 2' AS lab FROM t
  UNION ALL SELECT doc, 1, lpad(CAST(no AS VARCHAR), 8, '0'), name || '=' || value || ' ' || flag || ' text_match 1' FROM m WHERE hit
), labs AS (SELECT doc, string_agg(lab, '|' ORDER BY k, place) AS labs FROM b GROUP BY doc)
SELECT d.doc, coalesce(labs.labs, '') AS labs, priority || CASE WHEN d.doc % 3 = 0 THEN '|' || clerk ELSE '' END AS symptoms, CASE WHEN list_contains(words, v) THEN 'status=' || v ELSE '' END AS measurements,
  CASE WHEN model_only THEN array_to_string(u.said, '|') ELSE '' END AS unverified,
  CASE WHEN NOT model_only THEN u.n || ' item(s) proposed by the AI were not found in the document text and were discarded (' || array_to_string(u.said[1:5], '; ') || CASE WHEN u.n > 5 THEN '; …' ELSE '' END || ').' ELSE '' END AS limitations,
  length('--- o · page 1 ---' || chr(10) || text) + CASE WHEN model_only THEN length(chr(10) || chr(10) || '--- Read by AI from images/scans (not verified against the text layer) ---' || chr(10) || 'seen ' || d.doc) ELSE 0 END AS raw_chars
FROM d LEFT JOIN u USING (doc) LEFT JOIN labs USING (doc)
""")
def verified_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 as one job: each order is a document of one page with its priority, its odd lines and for every third its clerk; a model claims all of it, and
    more."""
    line, orders = _lab_lines(spark, sf_dir), table(spark, sf_dir, "orders").withColumn("doc", F.col("o_orderkey")).withColumn("clerk", F.format_string("Clerk#%09d", "o_custkey"))
    pages = orders.join(_lab_page(line), "doc", "left").select("doc", F.lit(1).alias("page"), F.lit("o").alias("filename"), F.concat_ws("\n", F.concat(F.lit("Priority "), "o_orderpriority", F.lit(" status")), F.when(F.col("doc") % 3 == 0, F.col("clerk")), "text").alias("text"))
    lab = F.struct("l_linenumber", F.struct("name", "value", "unit", "normal_range", "is_abnormal").alias("lab"))
    labs = line.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(lab)), lambda x: x["lab"]).alias("labs"))
    status = F.array(F.struct(F.lit("status").alias("name"), (F.col("o_custkey") % 50).cast("string").alias("value"), F.lit("").alias("unit")))
    outputs = orders.join(labs, "doc", "left").select("doc", "labs", F.array("o_orderpriority", "clerk").alias("symptoms"), F.array(F.concat(F.lit("drug "), (F.col("o_custkey") % 10).cast("string"))).alias("medicines"), status.alias("measurements"), F.concat(F.lit("seen "), F.col("doc").cast("string")).alias("narrative"))
    out = extraction.verify_extractions(outputs, pages, _lab_table(line), orders.select("doc", (F.col("doc") % 2 == 0).alias("model_only")))
    shown = F.transform("labs", lambda x: F.concat(x["name"], F.lit("="), x["value"], F.lit(" "), x["flag"], F.lit(" "), x["source"], F.lit(" "), x["page"].cast("string")))
    measured = F.transform("measurements", lambda x: F.concat(x["name"], F.lit("="), x["value"]))
    return out.select("doc", F.array_join(shown, "|").alias("labs"), F.array_join("symptoms", "|").alias("symptoms"), F.array_join(measured, "|").alias("measurements"), F.array_join("unverified", "|").alias("unverified"), F.array_join("limitations", "|").alias("limitations"), F.length("raw_text").cast("long").alias("raw_chars"))


@query(f"""
WITH c AS (
  SELECT 'p' || p_partkey AS doc, p_partkey, unnest([1, 2]) AS page, unnest([p_name || ' ' || p_brand || ' item ' || p_partkey, p_type || ' size ' || p_size || ' item ' || p_partkey]) AS text FROM part
), g AS (
  SELECT p_partkey AS q, 'which ' || text AS text, TRUE AS answerable, doc, page FROM c WHERE (p_partkey % 10 = 0 AND page = 1) OR (p_partkey % 10 = 5 AND page = 2)
  UNION ALL SELECT p_partkey, 'zebra quagga ' || (p_partkey * 7), FALSE, NULL, NULL FROM part WHERE p_partkey % 10 = 7
), tok AS (
  SELECT doc || '#' || (page - 1) AS id, NULL AS q, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM c UNION ALL SELECT NULL, q, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM g
), h AS (SELECT id, q, {FNV} AS h FROM tok WHERE length(t) > 1),
b AS (SELECT id, q, h % 64 AS b, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL),
x AS (SELECT id, q, b, CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY id, q) AS DOUBLE)) AS x FROM b WHERE v <> 0),
n AS (SELECT id, q, sqrt(sum(x * x ORDER BY b)) AS n FROM x GROUP BY ALL),
s AS (SELECT q.q, c.id, sum(q.x * c.x ORDER BY q.b) / (any_value(nq.n) * any_value(nc.n)) AS exact FROM x q JOIN x c ON q.b = c.b AND q.q IS NOT NULL AND c.id IS NOT NULL JOIN n nq ON nq.q = q.q JOIN n nc ON nc.id = c.id GROUP BY q.q, c.id),
r AS (SELECT s.*, round(exact, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY exact DESC, id) AS rank FROM s),
k AS (SELECT r.*, string_split(id, '#')[1] = g.doc AS own, string_split(id, '#')[1] = g.doc AND CAST(string_split(id, '#')[2] AS INTEGER) + 1 = g.page AS own_page FROM r JOIN g USING (q) WHERE rank <= 6),
m AS (SELECT g.q, g.answerable, min(rank) FILTER (own) AS first, max(score) AS top, max(score) FILTER (own) AS best, coalesce(bool_or(own_page), FALSE) AS page_hit FROM g LEFT JOIN k ON k.q = g.q GROUP BY ALL),
w AS (
  SELECT 'retrieval' AS part, unnest(['answerable', 'unanswerable', 'hit_1', 'hit_3', 'hit_6', 'mrr', 'page_hit', 'success', 'rejection']) AS name,
    unnest([CAST(count(*) FILTER (answerable) AS DOUBLE), CAST(count(*) FILTER (NOT answerable) AS DOUBLE), avg(CAST(coalesce(first <= 1, FALSE) AS INTEGER)) FILTER (answerable), avg(CAST(coalesce(first <= 3, FALSE) AS INTEGER)) FILTER (answerable),
      avg(CAST(coalesce(first <= 6, FALSE) AS INTEGER)) FILTER (answerable), avg(coalesce(1.0 / first, 0)) FILTER (answerable), avg(CAST(page_hit AS INTEGER)) FILTER (answerable), avg(CAST(coalesce(best >= 0.5, FALSE) AS INTEGER)) FILTER (answerable), avg(CAST(NOT coalesce(top >= 0.5, FALSE) AS INTEGER)) FILTER (NOT answerable)]) AS value FROM m
  UNION ALL SELECT 'sweep', 'success@' || t, avg(CAST(coalesce(best >= t, FALSE) AS INTEGER)) FROM m, (SELECT unnest([0.4, 0.6, 0.8]) AS t) WHERE answerable GROUP BY t
  UNION ALL SELECT 'sweep', 'rejection@' || t, avg(CAST(NOT coalesce(top >= t, FALSE) AS INTEGER)) FROM m, (SELECT unnest([0.4, 0.6, 0.8]) AS t) WHERE NOT answerable GROUP BY t
  UNION ALL SELECT 'similarity', unnest([k || 'least', k || 'p25', k || 'median', k || 'p75', k || 'largest']), unnest([min(top), quantile_disc(top, 0.25), quantile_disc(top, 0.5), quantile_disc(top, 0.75), max(top)]) FROM (SELECT coalesce(top, 0) AS top, CASE WHEN answerable THEN 'answerable_' ELSE 'unanswerable_' END AS k FROM m) GROUP BY k
) SELECT part, name, round(value, 6) AS value FROM w
""")
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as a gold set of two pages each; questions for a fifth of them, and others that none answers."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    first, second = F.concat_ws(" ", "p_name", "p_brand", F.lit("item"), key), F.concat_ws(" ", "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("item"), key)
    documents = parts.select(F.concat(F.lit("p"), key).alias("id"), F.lit("pdf_text").alias("source"), F.array(first, second).alias("pages"))
    kind = F.col("p_partkey") % 10
    text = F.when(kind == 0, F.concat(F.lit("which "), first)).when(kind == 5, F.concat(F.lit("which "), second)).when(kind == 7, F.concat(F.lit("zebra quagga "), (F.col("p_partkey") * 7).cast("string")))
    gold = parts.select(F.col("p_partkey").alias("query_id"), text.alias("question"), (kind != 7).alias("answerable"), F.when(kind != 7, F.concat(F.lit("p"), key)).alias("expected_document"), F.when(kind == 0, 1).when(kind == 5, 2).alias("expected_page")).filter("question is not null")
    report, _, _ = evaluate.run_evaluation(documents, gold, f"{shared_dir(spark)}/evaluation-{uuid.uuid4().hex}", dims=64, sweep=[0.4, 0.6, 0.8])
    return report.select("part", "name", F.round("value", 6).alias("value"))


@query("""
WITH l AS (SELECT l_partkey AS doc, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS k, 'analyte ' || l_linenumber || ':' || chr(10) || 'Result = ' || CAST(l_quantity AS INTEGER) || ' mmol' || chr(10) || 'Page = 1' AS t FROM lineitem),
g AS (SELECT doc, 1 + k // 8 AS i, 'Lab results table (p1-t0)' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY k) AS text FROM l GROUP BY ALL),
a AS (SELECT doc, i, 'table' AS content_type, 'p1-t0' AS table_id, text FROM g UNION ALL SELECT p_partkey, 0, 'text', NULL, p_name || ' of ' || p_brand FROM part)
SELECT 'user-' || (doc % 5) AS namespace, doc || '#' || i AS id, CAST(i AS INTEGER) AS chunk_index, content_type, 1 AS page, table_id, sha256(text) AS digest FROM a
""")
def indexed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a document of one page, where its order lines stand as words with positions below a header."""
    order = Window.partitionBy("document_id").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    line = table(spark, sf_dir, "lineitem").withColumn("document_id", F.col("l_partkey").cast("string")).withColumn("n", F.row_number().over(order))
    word = lambda text, x, width, y: F.struct(y.alias("y"), text.alias("str"), F.lit(float(x)).alias("x"), F.lit(float(width)).alias("width"))
    y, top = 5000.0 - 12 * F.col("n"), F.lit(5000.0)
    cells = F.array(word(F.lit("analyte"), 0, 40, y), word(F.col("l_linenumber").cast("string"), 43, 8, y), word(F.col("l_quantity").cast("int").cast("string"), 90, 10, y), word(F.lit("mmol"), 150, 30, y))
    head = F.array(word(F.lit("Test"), 0, 30, top), word(F.lit("Result"), 90, 40, top), word(F.lit("Unit"), 150, 30, top))
    words = F.when(F.col("n") == 1, F.concat(head, cells)).otherwise(cells)  # a page's header comes with its first line
    items = line.select("document_id", F.lit(1).alias("page"), F.inline(words))
    rows = layout.line_tables(layout.line_cells(items))
    segments = layout.table_segments(rows, "document_id", "table_id", "row_index", "page").select("document_id", (F.col("part") + 1).cast("int").alias("seg_idx"), F.lit("table").alias("content_type"), "page", "table_id", "text")
    parts = table(spark, sf_dir, "part").withColumn("document_id", F.col("p_partkey").cast("string"))
    text = parts.select("document_id", F.lit(0).alias("seg_idx"), F.lit("text").alias("content_type"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("table_id"), F.concat_ws(" ", "p_name", F.lit("of"), "p_brand").alias("text"))
    uploads = parts.select(F.concat((F.col("p_partkey") % 5).cast("string")).alias("user_id"), "document_id", F.lit("f").alias("filename"), F.lit("pdf_text").alias("source"), F.sha2("document_id", 256).alias("sha256"))
    path = f"{shared_dir(spark)}/indexed-{uuid.uuid4().hex}"
    documents, vectors = store.Table(spark, f"{path}/documents", store.DOCUMENTS), store.Table(spark, f"{path}/vectors", store.VECTORS)
    store.index_documents(uploads, documents, vectors, dims=64, segments=text.unionByName(segments))
    return vectors.read().select("namespace", "id", "chunk_index", "content_type", "page", "table_id", F.sha2("text", 256).alias("digest"))
