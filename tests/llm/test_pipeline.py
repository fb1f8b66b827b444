import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontaminate, language, mixing, simhash
from tessera.llm.queries import REST, TARGETS
from test_language import UNSEEN
from test_simhash import roots, slow_print

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(spark, rows, items):
    """The rows after each stage, without the operators' search methods. The language model itself is fitted by the operator."""
    kept = []
    model = language.fit_language_model(rows_frame(spark, rows))
    for r in rows:
        if r["text"] is not None and any(c.isalpha() for c in r["text"]):
            if model.outputs([r["text"]]).max() >= 2 * corpus_pipeline.MIN_SCORE - 1 - 1e-6:
                kept.append(r)
    fps = [slow_print(r["text"], 3) for r in kept]
    pairs = [(i, j) for i in range(len(kept)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = roots(pairs, range(len(kept)))
    first = {}
    for i, r in enumerate(kept):
        first[root[i]] = min(first.get(root[i], (r["doc_id"], i)), (r["doc_id"], i))
    kept = [kept[i] for _, i in first.values()]
    index = decontaminate.ItemIndex([(i, t, None) for i, t in items])
    return [r for r in kept if not index.matches(r["text"])]


def rows_frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_run_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = expected(spark, rows, items)
    assert 0 < len(want) < len(rows)
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).orderBy("start").collect()]
    order = {r["doc_id"]: r["mix_position"] for r in mixing.mix(rows_frame(spark, want), TARGETS, REST).collect()}
    want.sort(key=lambda r: order[r["doc_id"]])
    at, out = 0, []
    for r in want:
        ids = [*WHOLE.encode(r["text"], add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert got == out


def test_stages_keep_columns_and_odd_rows(spark, docs, sf, folder):
    base = [(i, t, g, "src1") for i, (t, g) in enumerate([("the house and the tree by the lake", "en"), ("das Haus und der Baum am See dort", "de")] * 4)]
    rows = base + [(None, None, None, None), (50, "", "en", None), (51, "123", None, "src0"), (0, base[0][1], "en", "src1"), (52, "the tree " * 50_000, None, "x"), (None, "und der Baum steht dort", "de", "y")]
    frame = docs(rows).withColumn("score", F.lit(1)).withColumn("mix_slot", F.lit("k")).withColumn("_text", F.lit("t")).withColumn("component_id", F.lit(3))
    frame = frame.withColumn("_row", F.concat(F.lit("r"), "doc_id")).withColumn("_matches", F.array(F.lit(5))).withColumn("mix_position", F.lit(8)).withColumn("matches", F.lit("m"))
    extra = ["score", "mix_slot", "_text", "component_id", "_matches", "mix_position", "matches"]
    path = folder("in")
    frame.write.parquet(path)
    table, sizes = spark.read.parquet(path), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, sf)
        assert out.columns == (frame.columns if i < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
        out.write.parquet(folder(str(i)))
        table = spark.read.parquet(folder(str(i)))
        sizes.append(table.count())
        if i < 4:
            assert {tuple(map(str, r)) for r in table.select(*extra).distinct().collect()} == {("1", "k", "t", "3", "[5]", "8", "m")}
            assert table.where("doc_id is not null and _row <> concat('r', doc_id)").isEmpty()
    assert sizes[0] == 11 and sizes[1] == 4 and sizes[2] == sizes[3] == sizes[4] == 4


def test_keys_of_near_duplicates_are_not_broadcast(spark, docs, sf, monkeypatch):
    """The stage's keys are 68 times its fingerprints; their joins sort both sides instead of sending one through the driver."""
    linked, own = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: linked.append(edges) or own(edges))
    rows = [(i, f"{'the house by the lake ' * 9}{i % 12}", "en", "src1") for i in range(20)]
    kept = corpus_pipeline.near_duplicates(spark, docs(rows), sf)
    root = roots([(i, j) for i in range(20) for j in range(i) if (slow_print(rows[i][1], 3) ^ slow_print(rows[j][1], 3)).bit_count() <= 3], range(20))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    links = linked[1]._jdf.queryExecution().sparkPlan().toString()
    assert links.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in links


def test_empty_table(spark, docs, sf, folder):
    docs([]).write.parquet(folder("in"))
    table = spark.read.parquet(folder("in"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, sf).write.parquet(folder(str(i)))
        table = spark.read.parquet(folder(str(i)))
        assert table.count() == 0


def test_tokens_without_files(spark, docs, sf):
    got = corpus_pipeline.tokens(spark, docs([(2, "b"), (1, "a")]), sf).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2]


def test_unseen_languages_are_dropped(spark, docs, sf):
    """Also with more labels than 1 / MIN_SCORE, where an uncertain text of a known language scores less than that."""
    own = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text rlike '[a-z]'").select("doc_id", "text", "lang")
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in own.collect()]
    odd = [(10**6 + i, t, None) for i, t in enumerate(UNSEEN)]
    clean = [(2 * 10**6 + i, t, None) for i, t in enumerate(["The", "on the", "la", "der", "et le"])]
    for rows in (texts, [(i, t, f"{g}{i % 2}") for i, t, g in texts]):
        got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs(rows + odd + clean), sf).select("doc_id").collect()}
        assert not got & {r[0] for r in odd} and got >= {r[0] for r in clean} and len(got) > 0.98 * len(texts)
