"""Polarity of texts by a lexicon table of any size, with rules for negation, degree, contrast and emphasis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import rows_of
from tessera.functions.text import WORD

#: Fixed values, as published for rule-based polarity: words that turn a following one, that strengthen or weaken it, and that set off what follows.
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without", "cannot", "hardly", "rarely", "seldom")
DEGREES = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293, "most": 0.293, "more": 0.293,
           "barely": -0.293, "slightly": -0.293, "somewhat": -0.293, "almost": -0.293, "partly": -0.293, "less": -0.293, "little": -0.293}
CONTRASTS = ("but", "however", "although")
#: Words of a lexicon that is sent to every task.
SENT_WORDS = 200_000


@dataclass(frozen=True)
class ValenceRules:
    """Words and weights of the rules. Words are compared in lower case."""

    negations: tuple[str, ...] = NEGATIONS
    degrees: dict[str, float] = field(default_factory=lambda: dict(DEGREES))
    contrasts: tuple[str, ...] = CONTRASTS
    reach: int = 3
    fading: tuple[float, ...] = (1.0, 0.95, 0.9)
    turned: float = -0.74
    capitals: float = 0.733
    before_contrast: float = 0.5
    after_contrast: float = 1.5
    exclamation: float = 0.292
    question: float = 0.18
    many_questions: float = 0.96
    spread: float = 15.0


def _capitals(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def text_valence(df: DataFrame, id_col: str, text: str, lexicon: DataFrame, rules: ValenceRules | None = None) -> DataFrame:
    """(id, neg, neu, pos, compound) per row; ``lexicon`` is (word, valence) with lower-case words, each once.

    A word of the lexicon counts with its valence, raised in its own direction where it is written in capitals among other words, raised or lowered by degree
    words among the ``reach`` words before it (farther ones count less), and turned and weakened if one of them is a negation. Words before the last
    contrast of a text weigh less, those after it more. Exclamation and question marks strengthen the sum. ``compound`` is s / sqrt(s * s + spread);
    the shares count a polar word as its strength plus one and any other as one.

    Each word meets the lexicon by an equal join. A lexicon of up to ``SENT_WORDS`` words, which are counted, is sent to the tasks, and only words found look at
    their neighbours; for a larger one each word carries its few neighbours through the shuffle. Only words
    found go on to one sum per row, combined before the shuffle. So the plan does not grow with the lexicon. A text without words, or null, has zeros. Ids
    must be unique.
    """
    r = rules or ValenceRules()
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    base = df.select(F.col(id_col).alias("id"), words.alias("_w")).withColumn("_l", F.transform("_w", F.lower))
    last = F.when(F.arrays_overlap("_l", F.array(*map(F.lit, r.contrasts))), _last_of(r.contrasts)).otherwise(-1) if r.contrasts else F.lit(-1)
    # some word is not in capitals: only then do capitals stand out
    mixed = F.exists("_w", lambda w: ~_capitals(w))
    base = base.withColumn("_last", last).withColumn("_mixed", mixed)
    before = lambda i: F.slice("_l", F.greatest(i - r.reach, F.lit(0)) + 1, F.least(i, F.lit(r.reach)))
    known = lexicon.select(F.col("word").alias("_word"), F.col("valence").cast("double").alias("v"))
    if known.limit(SENT_WORDS + 1).count() <= SENT_WORDS:
        # nothing is shuffled before the words are found, so the arrays of a text are carried by reference and only words found look around
        cells = rows_of(base, ["id", "_last", "_mixed", "_w", "_l"], F.col("_l"), "_t", "_i")
        hits = cells.join(F.broadcast(known), F.col("_t") == F.col("_word")).select(
            "id", "_last", "_mixed", "v", F.struct(F.col("_i").alias("i"), _capitals(F.get("_w", F.col("_i"))).alias("c"), before(F.col("_i")).alias("p")).alias("t"))
    else:
        token = F.transform("_l", lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.get("_w", i).alias("o"), before(i).alias("p")))
        cells = rows_of(base, ["id", "_last", "_mixed"], token, "t")
        hits = cells.join(known, F.col("t.w") == F.col("_word")).withColumn("t", F.col("t").withField("c", _capitals(F.col("t.o"))))
    sign = F.signum("v")
    raised = F.col("v") + F.when(F.col("t.c") & F.col("_mixed"), sign * r.capitals).otherwise(0.0)
    back = F.reverse(F.col("t.p"))
    for d, part in enumerate(r.fading[:r.reach]):
        near = F.get(back, F.lit(d))
        degree = F.lit(0.0)
        for weight in sorted(set(r.degrees.values())):
            degree = F.when(near.isin([w for w, x in r.degrees.items() if x == weight]), weight).otherwise(degree)
        raised = raised + sign * F.coalesce(degree, F.lit(0.0)) * part
    if r.negations:
        raised = raised * F.when(F.arrays_overlap(F.col("t.p"), F.array(*map(F.lit, r.negations))), r.turned).otherwise(1.0)
    weighed = raised * F.when(F.col("_last") < 0, 1.0).when(F.col("t.i") < F.col("_last"), r.before_contrast).when(F.col("t.i") > F.col("_last"), r.after_contrast).otherwise(1.0)
    valued = hits.select("id", F.round(weighed, 9).alias("v"))
    sums = valued.groupBy("id").agg(F.sum("v").alias("_s"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1)).alias("_p"),
                                    F.sum(F.when(F.col("v") < 0, 1 - F.col("v"))).alias("_n"), F.count_if(F.col("v") != 0).alias("_k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    counted = df.select(F.col(id_col).alias("id"), F.regexp_count(whole, F.lit(WORD)).alias("_all"), *(
        (F.length(whole) - F.length(F.replace(whole, F.lit(mark)))).alias(name) for mark, name in (("!", "_e"), ("?", "_q"))))
    marks = F.least("_e", F.lit(4)) * r.exclamation + F.when(F.col("_q") > 3, r.many_questions).when(F.col("_q") > 1, F.col("_q") * r.question).otherwise(0.0)
    met = counted.select("id", "_all", marks.alias("_m")).join(sums, "id", "left")
    met = met.select("id", "_m", zero("_s").alias("_s"), zero("_p").alias("_p"), zero("_n").alias("_n"), (F.col("_all") - F.coalesce("_k", F.lit(0))).alias("_u"))
    s = F.round(F.col("_s") + F.signum("_s") * F.col("_m"), 9)
    pos = F.col("_p") + F.when(F.col("_p") > F.col("_n"), F.col("_m")).otherwise(0.0)
    neg = F.col("_n") + F.when(F.col("_n") > F.col("_p"), F.col("_m")).otherwise(0.0)
    parts = met.select("id", s.alias("s"), pos.alias("p"), neg.alias("n"), F.col("_u").cast("double").alias("u"))
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c), F.col("p") + F.col("n") + F.col("u")), 3), F.lit(0.0))
    return parts.select(F.col("id").alias(id_col), share("n").alias("neg"), share("u").alias("neu"), share("p").alias("pos"),
                        F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + r.spread), 4).alias("compound"))


def _last_of(chosen: tuple[str, ...]) -> Column:
    """Place of the last of the chosen words in ``_l``."""
    return F.size("_l") - F.array_position(F.reverse(F.transform("_l", lambda w: w.isin(list(chosen)))), True)
