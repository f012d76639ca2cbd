from pyspark.sql import functions as F

from docevidence.functions import routing, sql


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT normalize_text(' a\\r\\n\\n\\nb  c ') AS t, normalize_flag('wnl') AS f, result_number('35.9 %') AS n, eval_normalize('A, b!') AS e, decode_entities('&amp;lt;') AS d").first()
    assert tuple(r) == ("a\n\nb c", "Normal", 35.9, "a b", "&lt;")


def test_sql_rules(spark):
    sql.register(spark)
    r = spark.sql("SELECT fold_text('Ärzte 5. Ü') AS a, term_key('Crème-B') AS b, parse_range('1,000 - 2 g').high AS c, parse_range('< 5').low AS d, flag_from_range('7', '1 - 5') AS e, strip_citations('x [R1, R2].', array('R1')) AS f").first()
    assert tuple(r) == ("arzte 5 u", "creme b", None, None, "High", "x [R1].")
    asked = ["What is iron?", "Should I treat it?", "What was the iron?", "what does anemia mean", "show my labs"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    rows.createOrReplaceTempView("asked")
    got = [x[0] for x in spark.sql("SELECT question_kind(q) FROM asked ORDER BY i").collect()]
    assert got == [x[0] for x in rows.select(routing.classify_question(F.col("q"))["kind"], "i").orderBy("i").collect()] == ["terminology", "clinical", "report", "terminology", "report"]


def test_chunk_table_function(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "word " * 500), (2, None)], "i int, body string").createOrReplaceTempView("bodies")
    out = spark.sql("SELECT i, c.* FROM (SELECT i, normalize_text(body) AS t FROM bodies) b, LATERAL chunk_text(b.t) c ORDER BY idx").collect()
    arrays = spark.sql("SELECT i, inline(chunk_array(t)) FROM (SELECT i, normalize_text(body) AS t FROM bodies)").orderBy("idx").collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in arrays] and len(out) == 3 and out[0]["end"] == 1000
