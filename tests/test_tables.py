"""Sources, sinks, registries and record operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, registry, relational
from tessera.session import scratch_path, shared_root
from tessera.sources import readers, writers


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_whole_text_and_binary(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "sub" / "b.txt").write_text("x")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    first, again = (readers.load_whole_text(spark, str(tmp_path), "*.txt").orderBy("value").collect() for _ in range(2))
    assert [r["value"] for r in first] == ["one\ntwo\n", "x"] and first == again
    files = readers.load_binary(spark, str(tmp_path), "*.bin").collect()
    assert [(r["filename"], r["length"], bytes(r["content"])) for r in files] == [("c.bin", 2, b"\x00\x01")]
    with pytest.raises(ValueError):
        readers.load_binary(spark, str(tmp_path), "*.pdf")


def test_csv_round_trip(spark, folder):
    df = spark.createDataFrame([(1, 'say "hi",\nnow', [1, 2], b"z", None)], "id int, `odd name` string, xs array<int>, raw binary, n double")
    writers.save_csv(df, folder("csv"))
    back = readers.load_csv(spark, folder("csv"), drop=["n"], multi_line=True)
    assert back.columns == ["id", "odd name", "xs"] and tuple(back.first()) == ("1", 'say "hi",\nnow', "[1,2]")
    writers.save_csv(spark.createDataFrame([('say "hi", now', "")], "a string, b string"), folder("flat"))
    assert tuple(readers.load_csv(spark, folder("flat"), drop=["b"]).first()) == ('say "hi", now',)


def test_csv_with_line_feeds_is_whole_by_default(spark, tmp_path):
    cases = {"open": ('a,b\n1,"x\ny, ""z"""\n2,w\n', [("1", 'x\ny, "z"'), ("2", "w")]), "quote": ('a,b\n"""p\nq",""\n', [('"p\nq', None)]),
             "flat": ('a,b\n"1, ""2""",""\n"x",y\n', [('1, "2"', None), ("x", "y")])}
    for name, (text, want) in cases.items():
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in readers.load_csv(spark, str(tmp_path / name)).collect()] == want


def test_save_modes(spark, folder):
    df = spark.range(4).withColumn("p", F.col("id") % 2)
    writers.save_table(df, folder("t"), "overwrite", ["p"])
    writers.save_table(df, folder("t"), "append", ["p"])
    assert spark.read.parquet(folder("t")).count() == 8
    writers.save_table(df.select("id"), folder("t"))
    assert spark.read.parquet(folder("t")).columns == ["id"]


def test_load_check(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    assert not writers.load_check(df, 2, "v", 2).first()["ok"] and writers.load_check(df, 2).first()["ok"]
    with pytest.raises(ValueError):
        writers.require_load(df, 3)


def test_stale_table_is_rebuilt(spark, folder):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    make = lambda n, dim: writers.materialize_if_stale(spark, folder("t"), lambda: df, n, "v", dim)
    assert [make(1, 2), make(1, 2), make(2, 2), make(1, 3)] == ["created", "kept", "rebuilt", "rebuilt"]


def test_null_status_is_an_error(spark):
    df = spark.createDataFrame([("SUCCESS",), ("ERROR: x",), (None,)], "s string")
    ok, bad, counts = relational.null_or_error_split(df, "s")
    assert (ok.count(), bad.count(), tuple(counts.first())) == (1, 2, (1, 2))


def test_unparseable_and_unknown_files_are_skipped(spark):
    ext = spark.createDataFrame([("a", '{"n": "x"}'), ("b", "{"), ("c", '{"n": "y"}'), ("d", None)], "file string, extracted string")
    gold = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "x"), ("e", "x")], "file string, n string")
    assert [r["file"] for r in relational.golden_inner_join(ext, gold, "file").collect()] == ["a"]
    assert sorted(r["file"] for r in relational.golden_missing(gold, ext, "file").collect()) == ["b", "d", "e"]
    per_file, summary = evaluation.extraction_benchmark(ext, gold, "file", {"n": "text"}, wall_s=2.0)
    s = summary.first()
    assert (s["accuracy"], s["scored"], s["golden"], s["coverage"], s["docs_per_s"]) == (1.0, 1, 4, 0.25, 2.0)
    assert per_file.count() == 1


def test_prompt_versions_and_roll_back(spark):
    log = None
    for seq, (alias, version) in enumerate([("production", 1), ("production", 2), ("test", 2), ("production", 1)]):
        entry = registry.alias_change(spark, "p", alias, version, F.lit(dt.datetime(2024, 1, 1)), seq)
        log = entry if log is None else log.unionByName(entry)
    got = {r["alias"]: (r["version"], r["rollback_version"]) for r in registry.current_aliases(log).collect()}
    assert got == {"production": (1, 2), "test": (2, None)}
    versions = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "b", True), ("p", 3, "c", False)],
                                     "prompt_name string, version bigint, prompt_text string, is_active boolean")
    assert {r["prompt_text"] for r in registry.current_prompts(versions, log).collect()} == {"a", "b"}
    assert [r["version"] for r in registry.active_prompts(versions).collect()] == [2]
    new = spark.createDataFrame([("p", "d"), ("q", "e")], "prompt_name string, prompt_text string")
    assert {(r["prompt_name"], r["version"]) for r in registry.register_version(versions, new).collect()} == {("p", 4), ("q", 1)}


def test_merge_replaces_what_records_bring(spark):
    old = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 2)], "q string, facts string, n int")
    new = spark.createDataFrame([("q2", None, True), ("q3", "c", False)], "q string, facts string, seen boolean")
    got = {r["q"]: (r["facts"], r["n"], r["seen"]) for r in evaluation.merge_records(old, new, "q").collect()}
    assert got == {"q1": ("a", 1, None), "q2": (None, 2, True), "q3": ("c", None, False)}


def test_bleu_sides_of_the_penalty(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the the cat"), (2, "a b c d", "a b"), (3, "a", ""), (4, "", "a"), (5, None, "a")],
                               "id int, ref string, cand string")
    got = {r["id"]: r["bleu"] for r in evaluation.bleu1(df, ["id"], "ref", "cand").collect()}
    assert got == {1: round(2 / 3, 4), 2: round(2.718281828459045 ** -1, 4), 3: 0.0, 4: 0.0, 5: 0.0}


SPAN = "array<struct<span_type string, name string, inputs string, outputs string>>"


def test_citations_against_tool_outputs(spark):
    out = '[{"arxiv_id": "1"}, {"arxiv_id": ""}, 3]'
    spans = [("SpanType.TOOL", "search_arxiv", "{}", out), ("tool", "get", "{}", '{"arxiv_id": "2"}'), ("LLM", "m", "{}", '{"arxiv_id": "9"}'),
             ("TOOL", "search_arxiv", "{}", "oops")]
    rows = [(1, "no", spans), (2, "[arxiv:1] [arxiv:2]", spans), (3, "[arxiv:9] [arxiv:1]", spans), (4, "[arxiv:1]", [])]
    traces = spark.createDataFrame(rows, f"trace_id int, answer string, spans {SPAN}")
    got = {r["trace_id"]: (r["value"], r["rationale"]) for r in evaluation.citation_correctness(traces).collect()}
    assert got[1] == (False, "The answer cites nothing.") and got[2][0] is True
    assert got[3] == (False, "Cited without a source: 9.") and got[4][0] is False
    found = {r["trace_id"]: (r["total"], r["calls"]) for r in evaluation.num_results(traces).collect()}
    assert found[1] == (3.0, 2) and found[4] == (0.0, 0)


def test_expectations_and_label_options(spark):
    traces = spark.createDataFrame([(1, "Sorry, here is a solution"), (2, "x" * 200)], "trace_id int, answer string")
    wanted = spark.createDataFrame([(1, (150, ["SORRY", "solution"])), (2, (150, ["sorry"]))],
                                   "trace_id int, expectation struct<max_response_length int, required_elements array<string>>")
    got = {r["trace_id"]: (r["length_ok"], r["missing_elements"], r["passed"]) for r in evaluation.expectation_lookup(traces, wanted).collect()}
    assert got == {1: (True, [], True), 2: (False, ["sorry"], False)}
    labels = spark.createDataFrame([("yes",), ("maybe",), (None,)], "v string")
    assert evaluation.label_schema_check(labels, "v", ["yes", "no", "partial"]).count() == 2


def test_accuracy_prefers_the_verdict(spark):
    df = spark.createDataFrame([("a", "a", None), ("a", "b", True), ("a", "a", False), ("a", "b", None)], "p string, t string, v boolean")
    assert evaluation.accuracy(df, "p", "t", "v").first()["accuracy"] == 0.5
    assert evaluation.accuracy(df, "p", "t").first()["accuracy"] == 0.5


def test_context_styles(spark):
    from tessera.operators import documents

    df = spark.createDataFrame([("q", 2, "d2", "two", None), ("q", 1, "d1", "one", "H"), ("r", 1, "d3", "x", "K")],
                               "q string, rank int, id string, text string, head string")
    pack = lambda style: {r["q"]: r["context"] for r in documents.context_pack(
        df, "q", "rank", "id", "text", style, "head", queries=spark.createDataFrame([("q",), ("none",)], "q string")).collect()}
    assert pack("numbered") == {"q": "[1] Id: d1\nContent: one\n\n---\n[2] Id: d2\nContent: two\n", "none": "INSUFFICIENT_INFORMATION"}
    assert pack("passage")["q"] == "Passage: one\nPassage: two\n"
    assert pack("headings")["q"] == "Headings: H, Content: one\n\nHeadings: , Content: two"
    assert pack("plain")["q"] == "one\n\ntwo"
    with pytest.raises(ValueError):
        pack("odd")


def test_messages_of_typed_parts(spark):
    from tessera.operators import documents

    part = "array<struct<type string, text string>>"
    df = spark.createDataFrame([(1, "plain", None), (2, None, [("text", "a"), ("image", "z"), ("text", None), ("text", "b")])],
                               f"id int, content string, parts {part}")
    got = {r["id"]: r["m"] for r in df.select("id", documents.message_text(F.col("content"), F.col("parts")).alias("m")).collect()}
    assert got == {1: "plain", 2: "a  b"}


def test_long_conversations_come_in_parts(spark):
    from tessera.operators import documents

    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = documents.transcript(df, part_turns=10).orderBy("part").collect()
    assert [r["transcript"].count("user: ") for r in rows] == [10, 10, 5]
    assert "\n".join(r["transcript"] for r in rows) == "\n".join(f"user: {i}" for i in range(25))


def test_catalog_table(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert readers.load_table(spark, None, "three_rows").count() == 3
