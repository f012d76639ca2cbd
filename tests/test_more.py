from pyspark.sql import functions as F

from docevidence.functions.text import fuzzy_match
from docevidence.operators import prompting, quality, retrieval
from docevidence.plans import registry


def test_greedy_counts(spark):
    df = spark.createDataFrame([("a", ["serum glucose", "iron", "glucose"], ["glucose", "sodium"]), ("b", [], []), ("c", ["x"], [])], "c string, p array<string>, e array<string>")
    out = {r["c"]: (r["tp"], r["fp"], r["fn"]) for r in quality.greedy_counts(df, "c", "p", "e", fuzzy_match).collect()}
    assert out == {"a": (1, 2, 1), "b": (0, 0, 0), "c": (0, 1, 0)}


def test_budgets(spark):
    rows = [("q", "a", 0.9, 50), ("q", "b", 0.8, 80), ("q", "c", 0.7, 40), ("q", "a", 0.5, 50), ("r", "z", 0.1, 500)]
    df = spark.createDataFrame(rows, "q string, i string, s double, l int")
    kept = lambda d: sorted((r["q"], r["n"], r["i"]) for r in d.collect())
    assert kept(retrieval.greedy_budget(df, "q", "i", "s", "l", 6, 100)) == [("q", 1, "a"), ("q", 2, "c"), ("r", 1, "z")]
    assert kept(retrieval.ordered_budget(df, "q", "i", [F.desc("l"), "i"], "l", 6, 100)) == [("q", 1, "b"), ("r", 1, "z")]


def test_term_hits(spark):
    s = "question string, record_id string, dataset string, match string, score double"
    exact = spark.createDataFrame([("q", "mesh:1", "mesh", "exact_term", 1.0), ("q", "mplus:1", "medlineplus", "exact_alias", 1.0)], s)
    near = spark.createDataFrame([("q", "mesh:1", "mesh", "semantic", 0.9), ("q", "mplus:2", "medlineplus", "semantic", 0.8), ("q", "mplus:3", "medlineplus", "semantic", 0.6)], s)
    out = retrieval.merge_term_hits(exact, near, "question").orderBy("position").collect()
    assert [(r["record_id"], r["match"]) for r in out] == [("mesh:1", "exact_term"), ("mplus:1", "exact_alias"), ("mplus:2", "semantic")]


def test_reports(spark):
    q = spark.createDataFrame([(1, True), (2, True), (3, False)], "q int, answerable boolean")
    r = spark.createDataFrame([(1, 1, False, 0.9), (1, 2, True, 0.8), (3, 1, False, 0.2)], "q int, rank int, relevant boolean, score double")
    got = quality.retrieval_report(q, r, "q", 0.5).first()
    assert (got["hit_1"], got["hit_3"], got["mrr"], got["success"], got["rejection"]) == (0.0, 0.5, 0.25, 0.5, 1.0)
    gold = spark.createDataFrame([("c", "Na", "1", None), ("c", "K", "2", "u")], "c string, test string, result string, unit string")
    found = spark.createDataFrame([("c", "na", "1", "x"), ("c", "Fe", "9", None)], gold.schema)
    t = quality.table_report(gold, found, "c", "test", ["result", "unit"]).first()
    assert (t["tp"], t["fp"], t["fn"], t["field_accuracy"]) == (1, 1, 1, 1.0)


def test_prompts(spark):
    e = spark.createDataFrame([("r", "P2", "b<c", 1), ("r", "P1", "a", None)], "r string, evidence_id string, content string, page int")
    blocks = prompting.evidence_block(e, "r", ["page"])
    assert blocks.first()["block"] == '<evidence id="P1">\na\n</evidence>\n<evidence id="P2" page="1">\nb&lt;c\n</evidence>'
    req = spark.createDataFrame([("r", "why?"), ("s", "how?")], "r string, question string")
    out = {x["r"]: x["prompt"] for x in prompting.prompt_table(req, blocks, "r", "Q: {question}\n{block}").collect()}
    assert out["s"] == "Q: how?\n(no evidence)" and out["r"].startswith("Q: why?\n<evidence")
    raw = spark.createDataFrame([(1, '{"level":"low","n":3}'), (2, '{"level":"odd","n":3}'), (3, "no json")], "i int, raw string")
    got = {x["i"]: (x["failure"], list(x["violations"])) for x in prompting.parse_output(raw, "raw", "level string, n int", {"level": F.col("parsed.level").isin("low", "high")}).collect()}
    assert got == {1: (None, []), 2: ("schema_validation_failure", ["level"]), 3: ("schema_validation_failure", ["malformed"])}


def test_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "Sodium sodium results a 12"), (2, ""), (3, "é ü x")], "i int, t string")
    one = {r["i"]: r["v"] for r in df.select("i", retrieval.hash_embed(F.col("t"), 16).alias("v")).collect()}
    many = {r["i"]: r["values"] for r in retrieval.embed_rows(df, "i", "t", 16).collect()}
    assert {i: [round(x, 9) for x in v] for i, v in one.items()} == {i: [round(x, 9) for x in v] for i, v in many.items()}


def test_own_row_is_not_ranked(spark, tmp_path):
    # Vectors 2 to 10 are copies, 20 is a zero vector: the own row comes behind others of a smaller id.
    values = {i: [1.0, 0.0] for i in range(2, 11)} | {12: [0.0, 1.0], 20: [0.0, 0.0]}
    spark.createDataFrame([(i, v, i % 4) for i, v in values.items()], "vec_id bigint, embedding array<double>, label bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    _, hits = registry._retrieved(spark, str(tmp_path))
    got = {q: [(r["rank"], r["relevant"]) for r in sorted(hits.filter(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (10, 20)}
    assert got[10] == [(1, True), (2, False), (3, True), (4, False), (5, False)]  # 2, 4, 6, 8 and 12 (score 0)
    assert got[20] == [(1, False), (2, True), (3, False), (4, True), (5, False)]  # 2, 4, 6, 8, 10
