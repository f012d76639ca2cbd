import os
import random

import pytest
from pyspark.sql import functions as F

from docevidence.operators import grounding, reports
from docevidence.plans import store
from docevidence.sources import files, vocabulary
from docevidence.streaming import jobs

TOPICS = """<?xml version="1.0"?><health-topics>
<health-topic id="1" title="Sugar" url="u" language="English" date-created="3/7/2001"><also-called>Glucose</also-called><also-called>glucose</also-called>
<full-summary>&lt;p&gt;A &lt;b&gt;sweet&lt;/b&gt; thing.&lt;/p&gt;</full-summary></health-topic>
<health-topic id="2" title="Azucar" language="Spanish"><full-summary>x</full-summary></health-topic>
<health-topic id="3" title="Empty" language="English"></health-topic></health-topics>"""

DESCRIPTORS = """<?xml version="1.0"?><DescriptorRecordSet>
<DescriptorRecord DescriptorClass="1"><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Iron</String></DescriptorName><LastUpdated><Year>2020</Year><Month>7</Month><Day>1</Day></LastUpdated>
<ConceptList><Concept PreferredConceptYN="N"><ScopeNote>other</ScopeNote></Concept><Concept PreferredConceptYN="Y"><ScopeNote>A metal.</ScopeNote>
<TermList><Term IsPermutedTermYN="N"><String>Ferrum</String></Term><Term IsPermutedTermYN="Y"><String>Iron, x</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<DescriptorRecord DescriptorClass="2"><DescriptorUI>D2</DescriptorUI><DescriptorName><String>No</String></DescriptorName></DescriptorRecord></DescriptorRecordSet>"""


def test_vocabularies(spark, tmp_path):
    (tmp_path / "t.xml").write_text(TOPICS)
    (tmp_path / "desc2024.xml").write_text(DESCRIPTORS)
    t = {r["record_id"]: r for r in vocabulary.read_topics(spark, str(tmp_path / "t.xml")).collect()}
    assert (t["mplus:1"]["definition"], t["mplus:1"]["aliases"], t["mplus:1"]["published"], t["mplus:1"]["skip_reason"]) == ("A sweet thing.", ["Glucose"], "2001-03-07", None)
    assert (t["mplus:2"]["skip_reason"], t["mplus:3"]["skip_reason"]) == ("not_english", "no_definition")
    d = vocabulary.read_descriptors(spark, str(tmp_path / "desc2024.xml"))
    r = d.filter("skip_reason is null").first()
    assert (r["term"], r["definition"], r["aliases"], r["published"]) == ("Iron", "A metal.", ["Ferrum"], "2020-07-01")
    assert {x["outcome"]: x["n"] for x in vocabulary.parse_stats(d).collect()} == {"parsed": 1, "not_topical": 1, "seen": 2, "duplicates": 0}
    terms = vocabulary.alias_keys(d.filter("skip_reason is null"))
    q = spark.createDataFrame([("q", ["ferrum", "x"])], "q string, keys array<string>")
    assert [tuple(x) for x in vocabulary.exact_lookup(q, terms, "q", "keys").collect()] == [("q", "mesh:D1", 1, "exact_alias")]


def test_files(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    for n, c in (("a.pdf", b"%PDF-1"), ("b.txt", b"hi"), ("c.txt", b"\xff")):
        (tmp_path / "b1" / n).write_bytes(c)
    df = files.load_files(spark, str(tmp_path), most_files=2).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("mime", F.when(F.col("name").endswith("pdf"), "application/pdf").otherwise("text/plain"))
    out = {r["name"]: (r["rejected"], r["reason"]) for r in files.audit(df, "name", "mime", "content").collect()}
    assert out == {"a.pdf": (None, None), "b.txt": (None, None), "c.txt": ("too_many_files", "content_mismatch")}


def test_grounding(spark):
    pages = spark.createDataFrame([("d", 1, "Persistent coughing at night. Sodium 140 mmol"), ("d", 2, "other")], "doc string, page int, text string")
    folded = grounding.fold_pages(pages, "doc", "page", "text")
    facts = spark.createDataFrame([("d", 1, "cough at night", ""), ("d", 2, "fever", ""), ("e", 1, "other", "")], "doc string, fact int, value string, name string")
    assert [tuple(r) for r in grounding.text_pages(facts, folded, "doc", "fact", "value", "page").collect()] == [("d", 1, [1])]
    labs = spark.createDataFrame([("d", 1, "serum sodium", "140"), ("d", 2, "sodium", "14")], "doc string, fact int, name string, value string")
    assert [tuple(r) for r in grounding.lab_pages(labs, folded, "doc", "fact", "name", "value", "page").collect()] == [("d", 1, [1])]


@pytest.fixture
def stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(src)
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), tmp_path


def run(df, tmp_path, name):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect()}


def test_streams(spark, stream):
    rows, events, tmp_path = stream
    want = {tuple(r) for r in reports.rate_violations(rows, "user_id", "ts", "event_id", 7200, 2).collect()}
    assert run(jobs.rate_violations_stream(events, "user_id", "ts", "event_id", 7200, 2), tmp_path, "limits") == want
    stats = run(jobs.call_stats_stream(events, "ts", ["event_type"], "value", "value > 90"), tmp_path, "stats")
    batch = {(r["d"], r["event_type"]): r["n"] for r in rows.groupBy(F.to_timestamp(F.date_trunc("day", "ts")).alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert stats and all(batch[s[0], s[1]] == s[2] for s in stats)


def test_late_events_in_their_place(spark, tmp_path):
    """Events of a key that arrive in any order, over several batches, are judged as the batch form judges them."""
    rng = random.Random(5)
    rows = [(f"k{rng.randint(0, 2)}", i, 1_700_000_000 + rng.randint(0, 3000)) for i in range(200)]
    rows += [(None, 900, 1_700_000_000), ("k0", 901, None)]
    df = spark.createDataFrame(rows, "k string, e int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for n, part in enumerate(df.orderBy(F.rand(1)).randomSplit([1.0] * 4, 2)):
        part.coalesce(1).write.parquet(f"{tmp_path}/parts/{n}")
    (tmp_path / "in").mkdir()
    names = [os.path.join(d, f) for d, _, fs in sorted(os.walk(f"{tmp_path}/parts")) for f in fs if f.endswith(".parquet")]
    last = spark.createDataFrame([("end", 999, 1_700_900_000)], "k string, e int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for n, name in enumerate(names):
        os.link(name, f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (1000 + n, 1000 + n))
    last.coalesce(1).write.parquet(f"{tmp_path}/last")
    os.link(next(os.path.join(tmp_path, "last", f) for f in os.listdir(f"{tmp_path}/last") if f.endswith(".parquet")), f"{tmp_path}/in/z.parquet")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in reports.rate_violations(df, "k", "ts", "e", 300, 5).collect()}
    assert run(jobs.rate_violations_stream(events, "k", "ts", "e", 300, 5, late="2 hours"), tmp_path, "late") == want and len(want) > 20


def test_merged_windows(spark, tmp_path):
    """Windows of a day merged to one for all: counts, sums and categories are exact, percentiles within the sketch's rank error."""
    n = 4000
    df = spark.range(n).select((F.col("id") % 2).cast("string").alias("op"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 100).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("ms"), (F.col("id") % 7).alias("tokens"))
    df = df.withColumn("kind", F.when(F.col("ms") < 200, "timeout").when(F.col("ms") < 500, "odd"))
    last = spark.createDataFrame([("end", 1_900_000_000)], "op string, s long").select("op", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("ms"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("kind"))
    df.union(last).repartition(3).write.parquet(f"{tmp_path}/in")
    calls = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stats = jobs.call_stats_stream(calls, "ts", ["op"], "ms", "kind is not null", fallback="ms > 9000", tokens=["tokens"], category="kind", categories=["timeout"])
    stats.writeStream.format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    days = spark.sql("SELECT * FROM days")
    assert days.count() >= 8
    got = {r["op"]: r for r in jobs.merge_call_stats(days, ["op"]).collect()}
    for op in ("0", "1"):
        own = [r for r in df.collect() if r["op"] == op]
        ms = sorted(r["ms"] for r in own)
        g = got[op]
        assert (g["calls"], g["errors"], g["fallbacks"], g["tokens"]) == (len(own), sum(r["kind"] is not None for r in own), sum(r["ms"] > 9000 for r in own), sum(r["tokens"] for r in own))
        assert g["failures"] == {k: n for k, n in {"timeout": sum(r["kind"] == "timeout" for r in own), "other": sum(r["kind"] == "odd" for r in own)}.items() if n}
        for p, name in ((0.5, "p50"), (0.95, "p95")):
            assert abs(sum(x <= g[name] for x in ms) / len(ms) - p) < 0.01


def test_index_stream_once(spark, tmp_path, monkeypatch):
    """A failure between the vectors and the documents leaves no half: the next run does the rest, and does nothing twice."""
    (tmp_path / "in").mkdir()
    rows = [("u1", "a", "a.txt", "s", "sodium result"), ("u1", "b", "b.txt", "s", "sodium result"), ("u1", "c", "c.txt", "s", "iron result")]
    schema = "user_id string, document_id string, filename string, source string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    documents, vectors = store.Table(spark, str(tmp_path / "d"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v"), store.VECTORS)

    def start():
        uploads = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.index_stream(uploads, documents, vectors, str(tmp_path / "cp"), dims=16).awaitTermination(120)

    upsert = documents.upsert
    monkeypatch.setattr(documents, "upsert", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception, match="division"):
        start()
    assert vectors.read().count() == 2 and documents.read().count() == 0  # vectors alone are never served
    monkeypatch.setattr(documents, "upsert", upsert)
    start()
    assert vectors.read().count() == 2 and vectors.version() == 1 and {r["document_id"] for r in documents.read().collect()} == {"a", "c"}
    spark.createDataFrame([("u1", "e", "e.txt", "s", "iron result"), ("u2", "f", "f.txt", "s", "iron result")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert {r["document_id"] for r in documents.read().collect()} == {"a", "c", "f"} and vectors.read().count() == 3


def test_ingest_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b", "c"):
        (tmp_path / "in" / f"{n}.txt").write_text("same" if n < "c" else "other")
    src = spark.readStream.format("text").option("wholetext", "true").load(str(tmp_path / "in")).withColumn("sha256", F.sha2("value", 256))
    out = str(tmp_path / "out")
    spark.createDataFrame([], "value string, sha256 string").write.parquet(out)
    for k in range(2):
        jobs.incremental_ingest(src, lambda b: b.write.mode("append").parquet(out), lambda: spark.read.parquet(out), str(tmp_path / f"cp{k}")).awaitTermination(60)
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["other", "same"]
