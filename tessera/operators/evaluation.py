"""Scoring of extractions, answers and traces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import let
from tessera.functions.responses import as_list, kind_of, parsed_json
from tessera.functions.scoring import score_extraction
from tessera.functions.text import extract_citations, tokenize_words
from tessera.operators.aggregates import per_field_means, typed_agg
from tessera.operators.ranking import latest_per_key
from tessera.operators.relational import compare_outer, golden_inner_join

# ---------------------------------------------------------------- extraction


def extraction_benchmark(extractions: DataFrame, golden: DataFrame, key: str, fields: dict[str, str],
                         wall_s: float | Column | None = None, response: str = "extracted") -> tuple[DataFrame, DataFrame]:
    """(scores per file, summary).

    ``extractions`` holds JSON text per key, ``golden`` one column per field. Unknown keys and text
    that is no JSON are skipped, as are they in the mean; throughput counts all golden rows, and
    ``coverage`` says how many of them were scored.
    """
    # an answer may hold another kind of value where a list is expected
    types = {"list": "variant"}
    ddl = ", ".join(f"{f} {types.get(kind, 'string')}" for f, kind in fields.items())
    expected = golden.select(key, F.struct(*[F.col(f) for f in fields]).alias("expected"))
    joined = golden_inner_join(extractions.select(key, F.col(response).alias("extracted")), expected, key)
    typed = joined.withColumn("extracted", F.from_json("extracted", ddl))
    scored = score_extraction(typed, fields).select(key, *[F.col(f"score_{f}").alias(f) for f in fields], "accuracy")
    n_golden = golden.agg(F.count(F.lit(1))).scalar()
    means = scored.agg(F.avg("accuracy").alias("accuracy"), *[F.avg(f).alias(f) for f in fields],
                       F.count(F.lit(1)).alias("scored"))
    summary = means.withColumn("golden", n_golden).withColumn("coverage", F.try_divide("scored", "golden"))
    if wall_s is not None:
        wall = wall_s if isinstance(wall_s, Column) else F.lit(float(wall_s))
        summary = summary.withColumn("docs_per_s", F.col("golden") / wall)
    return scored, summary


def approach_profile(a: DataFrame, b: DataFrame, runs: DataFrame, key: str, fields: list[str],
                     names: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per file with the accuracy difference, metrics of the newest run of each approach, per field means)."""
    columns = ["accuracy", *fields]
    suffixes = (f"_{names[0]}", f"_{names[1]}")
    per_file = compare_outer(a, b, key, columns, suffixes, "accuracy")
    newest = latest_per_key(runs.where(F.col("run_name").isin(*names)), "run_name",
                            [F.col("start_time").desc(), F.col("run_id")])
    return per_file, newest, per_field_means(per_file, fields, *suffixes)


def accuracy(df: DataFrame, prediction: str, target: str, verdict: str | None = None) -> DataFrame:
    """Share of right predictions; a verdict, where there is one, wins over plain equality."""
    same = F.col(prediction).eqNullSafe(F.col(target))
    right = F.coalesce(F.col(verdict), same) if verdict else same
    return df.agg(F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- answers


def bleu1(df: DataFrame, keys: list[str], reference: str, candidate: str, digits: int = 4) -> DataFrame:
    """(keys, bleu): clipped share of candidate words found in the reference, times the brevity penalty.

    Words are counted per (key, word) before the rows of a key meet, so a very long text is spread
    over tasks by its words.
    """
    side = lambda c, is_ref: F.transform(tokenize_words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(
        w.alias("word"), F.lit(0 if is_ref else 1).alias("c"), F.lit(1 if is_ref else 0).alias("r")))
    words = df.select(*keys, F.explode_outer(F.concat(side(candidate, False), side(reference, True))).alias("_w"))
    per_word = words.groupBy(*keys, F.col("_w.word").alias("_word")).agg(F.sum("_w.c").alias("c"), F.sum("_w.r").alias("r"))
    sums = per_word.groupBy(*keys).agg(F.sum(F.least("c", "r")).alias("hits"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    penalty = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.greatest(F.lit(1), F.col("c"))))
    score = F.coalesce(penalty * F.try_divide(F.col("hits"), F.col("c")), F.lit(0.0))
    return sums.select(*keys, F.round(score, digits).alias("bleu"))


def tool_spans(spans: Column, tool: str | None = None) -> Column:
    """Spans whose type ends in TOOL, of one tool if named."""
    of_tool = lambda s: F.coalesce(F.upper(s["span_type"]).endswith("TOOL"), F.lit(False))
    if tool is None:
        return F.filter(spans, of_tool)
    return F.filter(spans, lambda s: of_tool(s) & (s["name"] == tool))


ITEM_DDL = "struct<arxiv_id string, summary string>"


def observed_ids(spans: Column) -> Column:
    """Distinct non-empty ids in the outputs of all tool spans."""
    items = F.flatten(F.transform(tool_spans(spans), lambda s: as_list(s["outputs"], ITEM_DDL)))
    ids = F.transform(items, lambda i: i["arxiv_id"])
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False))))


def trace_bleu(traces: DataFrame, id_col: str = "trace_id", question: str = "question", spans: str = "spans") -> DataFrame:
    """(id, bleu): ``bleu1`` of the question against all summaries in the tool outputs of its trace, 0 without any."""
    items = F.flatten(F.transform(tool_spans(F.col(spans)), lambda s: as_list(s["outputs"], ITEM_DDL)))
    found = F.filter(F.transform(items, lambda i: i["summary"]), lambda s: F.coalesce(s != "", F.lit(False)))
    return bleu1(traces.select(id_col, question, F.array_join(found, " ").alias("_found")), [id_col], "_found", question)


def citation_correctness(traces: DataFrame, id_col: str = "trace_id", answer: str = "answer",
                         spans: str = "spans") -> DataFrame:
    """(id, value, rationale): true if something is cited and every cited id was seen in a tool output."""
    found = traces.select(id_col, extract_citations(F.col(answer)).alias("cited"), observed_ids(F.col(spans)).alias("seen"))
    listed = lambda ids: F.array_join(F.array_sort(ids), ", ")
    judged = let(F.array_except("cited", "seen"), lambda unseen: F.when(
        F.size("cited") == 0, _feedback(False, F.lit("The answer cites nothing.")))
        .when(F.size(unseen) > 0, _feedback(False, F.concat(
            F.lit("Cited without a source: "), listed(unseen), F.lit("."))))
        .otherwise(_feedback(True, F.concat(
            F.lit("Every citation has a source: "), listed(F.col("cited")), F.lit(".")))))
    return found.select(id_col, judged.alias("_j")).select(id_col, "_j.*")


def _feedback(value: bool, rationale: Column) -> Column:
    return F.struct(F.lit(value).alias("value"), rationale.alias("rationale"))


def num_results(traces: DataFrame, tool: str = "search_arxiv", id_col: str = "trace_id", spans: str = "spans") -> DataFrame:
    """(id, total, calls): rows in the list outputs of one tool, and the number of its calls."""
    length = lambda s: let(parsed_json(s["outputs"]), lambda v: F.when(
        kind_of(v) == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).otherwise(F.lit(0)))
    mine = traces.select(id_col, tool_spans(F.col(spans), tool).alias("_s"))
    total = F.aggregate(F.transform("_s", length), F.lit(0), lambda a, x: a + x)
    return mine.select(id_col, total.cast("double").alias("total"), F.size("_s").alias("calls"))


def guideline_rules(df: DataFrame, id_col: str, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """(id, rule, pass): every global rule on every row."""
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(rule(), F.lit(False)).alias("pass"))
                      for name, rule in rules.items()])
    return df.select(id_col, F.explode(cells).alias("_c")).select(id_col, "_c.*")


@dataclass(frozen=True)
class Scorer:
    """A named column expression over a row; ``kind`` is bool, num or str."""

    name: str
    kind: str
    build: Callable[[], Column]


SCORERS: dict[str, Scorer] = {}


def scorer(name: str, kind: str) -> Callable[[Callable[[], Column]], Scorer]:
    """Turns a function that returns a column expression into a registered scorer."""
    def make(build: Callable[[], Column]) -> Scorer:
        SCORERS[name] = Scorer(name, kind, build)
        return SCORERS[name]
    return make


KIND_TYPES = {"bool": "boolean", "num": "double", "str": "string"}


def evaluate(df: DataFrame, id_col: str, scorers: list[Scorer]) -> tuple[DataFrame, DataFrame]:
    """(one column per scorer for each row, aggregates by scorer). All scorers run in one projection."""
    for s in scorers:
        if s.kind not in KIND_TYPES:
            raise ValueError(f"scorer {s.name} has unknown kind {s.kind}")
    per_row = df.select(id_col, *[s.build().cast(KIND_TYPES[s.kind]).alias(s.name) for s in scorers])
    cell = lambda s: F.struct(F.lit(s.name).alias("name"), *[
        (F.col(s.name) if kind == s.kind else F.lit(None)).cast(t).alias(f"{kind}_value") for kind, t in KIND_TYPES.items()])
    long = per_row.select(id_col, F.explode(F.array(*[cell(s) for s in scorers])).alias("_c")).select(id_col, "_c.*")
    return per_row, typed_agg(long)


def merge_records(dataset: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Dataset after an upsert by ``key``: records win in every column they bring."""
    columns = [c for c in dict.fromkeys([*dataset.columns, *records.columns]) if c != key]
    old, new = dataset.withColumn("_old", F.lit(True)), records.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), key, "full")

    def pick(c: str) -> Column:
        if c not in records.columns:
            return F.col(f"o.{c}")
        if c not in dataset.columns:
            return F.col(f"n.{c}")
        return F.when(F.col("n._new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(key, *[pick(c).alias(c) for c in columns])


def inference_log_load(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Logged rows under the names an evaluation table uses, with the id as text."""
    return df.select(*[F.col(src).cast("string").alias(dst) if dst == "request_id" else F.col(src).alias(dst)
                       for dst, src in mapping.items()])


# ---------------------------------------------------------------- feedback and expectations


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """(name, source_type, n, mean, texts, rationales) over boolean, numeric and text feedback."""
    number = F.coalesce(F.col("value_bool").cast("double"), F.col("value_num"))
    return feedback.groupBy("name", "source_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(number).alias("mean"), F.count("value_str").alias("texts"),
        F.count("rationale").alias("rationales"))


def expectation_lookup(traces: DataFrame, expectations: DataFrame, key: str = "trace_id", answer: str = "answer") -> DataFrame:
    """Traces with their expectation (max_response_length, required_elements) and the checks that follow from it."""
    joined = traces.join(expectations, key)
    low = F.lower(F.col(answer))
    missing = F.filter(F.col("expectation.required_elements"), lambda e: ~F.contains(low, F.lower(e)))
    return joined.withColumn("length_ok", F.char_length(answer) <= F.col("expectation.max_response_length")).withColumn(
        "missing_elements", missing).withColumn("passed", F.col("length_ok") & (F.size("missing_elements") == 0))


def label_schema_check(labels: DataFrame, value: str, options: list[str]) -> DataFrame:
    """Rows whose label is not one of the allowed options."""
    return labels.where(~F.coalesce(F.col(value).isin(*options), F.lit(False)))
