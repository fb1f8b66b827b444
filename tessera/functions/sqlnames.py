"""Names for use in SQL text: rules as SQL functions, models as vectorised functions, chunking as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.chunks import recursive_split
from tessera.inference.models import HashedEmbedder, ModelFactory

# Bodies are plain SQL, so the planner sees through them.
SQL_FUNCTIONS = {
    "file_name": ("path STRING", "STRING", "regexp_extract(path, '([^/]+)$', 1)"),
    "token_estimate": ("t STRING", "INT", "greatest(1, cast(floor(char_length(t) / 4) as int))"),
    "elapsed_seconds": ("a TIMESTAMP, b TIMESTAMP", "DOUBLE", "(unix_micros(b) - unix_micros(a)) / 1000000D"),
    "content_id": ("t STRING", "STRING", "md5(t)"),
    "clean_model_json": ("t STRING", "STRING", "btrim(replace(replace(t, 'json\\n', ''), '```', ''), ' \\t\\n\\r')"),
}


def register_model(spark: SparkSession, name: str, model: ModelFactory, returns: str = "string") -> None:
    """``SELECT name(prompt)``: the model is built once per task and called on Arrow batches.

    A call by named arguments is ``name(to_json(named_struct(...)))``.
    """
    @F.pandas_udf(returns)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            yield pd.Series(run(texts.tolist()))

    spark.udf.register(name, call)


@udtf(returnType="chunk_no int, chunk string", useArrow=True)
class SplitText:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(recursive_split(text, size, overlap))


def register_functions(spark: SparkSession) -> None:
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    register_model(spark, "hashed_embed", HashedEmbedder(64), "array<float>")
    spark.udtf.register("split_text", SplitText)
