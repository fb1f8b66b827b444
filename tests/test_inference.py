"""The batch runner: errors, retries, batches, schemas and the models."""

import pytest
from pyspark.sql import functions as F

from tessera.inference import counters, models, runner
from tessera.operators import documents


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, f"text {i}" if i % 4 else ("bad" if i else None)) for i in range(20)], "id int, text string")


def test_keeps_columns_and_rows(rows):
    out = runner.ai_query(rows, "text", models.Checksum("x"))
    assert out.columns == ["id", "text", "response"]
    for r in out.collect():
        assert r["response"] is None if r["text"] is None else r["response"].startswith(f"x{len(r['text'])}:")


def test_errors_as_column_mark_or_failure(rows):
    model = models.Flaky(models.Checksum(), poison="bad")
    out = runner.ai_query(rows, "text", model, on_error="column", batch=7).collect()
    assert all((r["error"] is not None) == (r["text"] == "bad") and (r["response"] is None) == (r["text"] in ("bad", None)) for r in out)
    marked = runner.ai_query(rows, "text", model, on_error="mark").where("response = 'ERROR'")
    assert marked.count() == rows.where("text = 'bad'").count()
    with pytest.raises(Exception, match="refused"):
        runner.ai_query(rows, "text", model).collect()


def test_retry_counts_and_gives_up(rows):
    some = rows.where("text is not null")
    flaky = models.Flaky(models.Checksum(), fails=2)
    good = runner.ai_query(some, "text", flaky, attempts=True, retries=5, batch=1).collect()
    assert {r["attempts"] for r in good} == {3}
    out = runner.ai_query(some.coalesce(1), "text", models.Flaky(models.Checksum(), fails=9), on_error="column", retries=1, batch=1)
    assert out.where("error like 'TimeoutError%'").count() > 0


def test_wrong_number_of_answers_is_an_error(rows):
    out = runner.ai_query(rows.where("text is not null"), "text", lambda: lambda texts: ["one"] * (len(texts) + 1), on_error="column")
    assert out.where("error is null").count() == 0


def test_batch_size_and_slots(rows):
    out = runner.ai_query(rows.coalesce(1).where("text is not null"), "text", models.BatchSize(), batch=5)
    sizes = sorted(int(r["response"]) for r in out.collect())
    assert max(sizes) == 5 and len(sizes) == 19
    assert runner.ai_query(rows, "text", models.Checksum(), slots=6).rdd.getNumPartitions() == 6


def test_schema_and_return_types(spark):
    df = spark.createDataFrame([("a@b.org c@d.org",), ("none",)], "text string")
    model = models.PatternExtractor({"first": r"\w+@[\w.]+", "all": r"\w+@[\w.]+"}, many=("all",))
    got = runner.ai_query(df, "text", model, "r", ddl="first string, all array<string>").collect()
    assert [(r["r"]["first"], r["r"]["all"]) for r in got] == [("a@b.org", ["a@b.org", "c@d.org"]), (None, [])]
    vectors = runner.ai_query(df, "text", models.HashedEmbedder(8), "v", returns="array<float>").collect()
    assert all(len(r["v"]) == 8 and abs(sum(x * x for x in r["v"]) - 1) < 1e-6 for r in vectors)


def test_model_is_called_once_per_row(spark, folder):
    df = spark.range(8).select(F.col("id").cast("string").alias("text"))
    path = folder("calls")

    def counting():
        def run(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return texts
        return run

    out = runner.ai_query(df, "text", counting, on_error="column", timed=True)
    out.where("response <> 'z' and latency_s >= 0 and error is null").select("response", "latency_s").collect()
    assert len(open(path).read()) == 8


def test_chain_sweep_and_throughput(spark):
    df = spark.createDataFrame([(1, "good day"), (2, "bad day")], "id int, text string")
    mood = models.WordPolarity(("good",), ("bad",))
    chained = runner.infer_chain(df, "text", [("mood", mood, None), ("check", models.Checksum(), "M:{answer}")]).orderBy("id").collect()
    assert [r["mood"] for r in chained] == ["positive", "negative"] and chained[0]["check"].startswith("10:")
    swept = runner.model_sweep(df, "text", {"a": mood, "b": models.CoverageJudge()})
    assert swept.count() == 4 and swept.where("error is not null").count() == 0
    timed = spark.createDataFrame([(0.5, None), (1.5, "x")], "latency_s double, error string")
    got = runner.run_throughput(timed).first()
    assert (got["rows"], got["seconds"], got["errors"], got["rows_per_s"]) == (2, 2.0, 1, 1.0)


def test_parser_callable_never_fails_the_job(spark):
    df = spark.createDataFrame([(1, b"a|b"), (2, b"\xff")], "id int, content binary")
    out = documents.document_to_text(df, "content", lambda: lambda raw: raw.decode("utf-8").split("|")).orderBy("id").collect()
    assert out[0]["parsing"]["doc_parsed_contents"] == {"num_pages": "2", "parsed_content": "a\nb"}
    assert out[1]["parsing"]["parser_status"].startswith("ERROR") and out[1]["parsing"]["doc_parsed_contents"]["num_pages"] == ""


def test_chunker_status(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "id int, text string")
    out = documents.with_recursive_chunks(df, "text", 8, 0).orderBy("id").collect()
    assert out[0]["chunked"]["chunked_text"] == ["one two", "three"] and out[1]["chunked"]["chunker_status"].startswith("ERROR")
    assert documents.recursive_chunk(df, "id", "text", 8, 0).count() == 2


def test_chunks_measured_in_tokens(spark, sf):
    files = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").limit(40)
    makers = [counters.Words(), counters.TokenizerFile(str(files.path("byte_bpe_50k.json"))),
              counters.RankFile(str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN)]
    sizes = []
    for maker in makers:
        measure = maker()
        rows = documents.recursive_chunk(docs, "doc_id", "text", 60, 10, maker).collect()
        sizes.append(len(rows))
        # A chunk is measured piece by piece, and a joined text never has more tokens than its pieces.
        assert rows and all(measure(r["chunk"]) <= 61 for r in rows)
    assert sizes[1] == sizes[2] > sizes[0]


def test_answers_and_chunks_go_on_in_pieces(spark, monkeypatch):
    """A worker holds the answers of a few rows, whatever the size of the Arrow batch."""
    import pandas as pd

    sizes = []

    class Frame(pd.DataFrame):
        def __init__(self, rows, columns):
            sizes.append(len(rows))
            super().__init__(rows, columns=columns)

    texts = pd.Series([None if i % 7 == 0 else f"text {i}" for i in range(3000)], dtype=object)
    made = []

    class Plain:
        def asNondeterministic(self):
            return lambda *columns: F.lit(1)

    def keep(ddl):
        return lambda f: made.append(f) or Plain()

    monkeypatch.setattr(F, "pandas_udf", keep)
    monkeypatch.setattr(pd, "DataFrame", Frame)
    runner.model_call(F.lit("x"), models.BatchSize(), batch=10)
    documents.with_recursive_chunks(spark.createDataFrame([("a",)], "text string"), "text", 8, 0)
    answers = [a for piece in made[0](iter([texts, texts[:0]])) for a in piece["response"]]
    assert max(sizes) < 600 and len(answers) == 3000 and [a is None for a in answers] == [t is None for t in texts]
    sizes.clear()
    assert sum(len(piece) for piece in made[1](iter([texts.fillna("")]))) == 3000 and max(sizes) < 600


def test_embedder_remembers_a_bounded_number_of_words(monkeypatch):
    texts = [f"w{i} shared w{i + 1}" for i in range(50)]
    whole = models.HashedEmbedder(8)()(texts)
    monkeypatch.setattr(models, "KNOWN_WORDS", 3)
    call = models.HashedEmbedder(8)()
    assert call(texts) == whole
    held = next(c.cell_contents for f in call.__closure__ if callable(f.cell_contents) and getattr(f.cell_contents, "__closure__", None)
                for c in f.cell_contents.__closure__ if isinstance(c.cell_contents, dict))
    assert len(held) <= 3
