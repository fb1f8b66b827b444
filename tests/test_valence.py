import math
import random
import re

from pyspark.sql import functions as F

from tessera.operators import valence
from tessera.operators.valence import ValenceRules, text_valence

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "war": -2.9, "fine": 0.8, "zero": 0.0}
RULES = ValenceRules()


def slow(text, lexicon=LEXICON, r=RULES):
    words = re.findall(r"\w+", text or "")
    low = [w.lower() for w in words]
    caps = [w.upper() == w and w.lower() != w for w in words]
    last = max((i for i, w in enumerate(low) if w in r.contrasts), default=-1)
    found = []
    for i, w in enumerate(low):
        if w not in lexicon:
            continue
        v = lexicon[w]
        sign = (v > 0) - (v < 0)
        before = low[max(0, i - r.reach):i][::-1]
        x = v + (sign * r.capitals if caps[i] and not all(caps) else 0)
        x += sum(sign * r.degrees.get(b, 0.0) * f for b, f in zip(before, r.fading))
        if any(b in r.negations for b in before):
            x *= r.turned
        if last >= 0 and i != last:
            x *= r.before_contrast if i < last else r.after_contrast
        found.append(round(x, 9))
    e, q = (text or "").count("!"), (text or "").count("?")
    m = min(e, 4) * r.exclamation + (r.many_questions if q > 3 else q * r.question if q > 1 else 0)
    s, p, n = sum(found), sum(v + 1 for v in found if v > 0), sum(1 - v for v in found if v < 0)
    s += m * ((s > 0) - (s < 0))
    u = len(words) - sum(v != 0 for v in found)
    p, n = p + (m if p > n else 0), n + (m if n > p else 0)
    whole = p + n + u
    return (*(x / whole if whole else 0.0 for x in (n, u, p)), s / math.sqrt(s * s + r.spread))


def check(spark, rows, lexicon=LEXICON, rules=RULES):
    frame = spark.createDataFrame(rows, "doc_id bigint, body string").withColumn("id", F.lit("x")).withColumn("word", F.lit(1)).repartition(3)
    table = spark.createDataFrame(list(lexicon.items()), "word string, valence double")
    got = {r["doc_id"]: (r["neg"], r["neu"], r["pos"], r["compound"]) for r in text_valence(frame.select("doc_id", "body"), "doc_id", "body", table, rules).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        for a, b, digits in zip(got[i], slow(text, lexicon, rules), (3, 3, 3, 4)):
            assert abs(a - b) <= 0.51 * 10 ** -digits + 1e-9, (text, got[i], slow(text, lexicon, rules))


def test_rules_one_by_one():
    plain = slow("the food was good")[3]
    assert slow("the food was very good")[3] > plain > slow("the food was slightly good")[3] > 0 > slow("the food was not good")[3]
    assert slow("the food was GOOD")[3] > plain and slow("the food was good!!")[3] > plain and slow("GOOD")[3] == slow("good")[3]
    assert slow("good but bad")[3] < slow("good bad")[3]


def test_against_a_plain_loop(spark):
    rng = random.Random(1)
    words = [*LEXICON, "not", "never", "very", "slightly", "but", "however", "the", "food", "GOOD", "BAD", "ΩMEGA", "été"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(14))) + rng.choice(["", "!", "!!!!!!", "??", "?????", "?!"])) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "GOOD WAR"), (1004, "good " * 20_000), (1005, "but good"), (1006, "good but")]
    check(spark, rows)
    check(spark, rows[:100], rules=ValenceRules(negations=(), contrasts=(), degrees={}))


def test_plan_does_not_grow_with_the_lexicon(spark):
    lexicon = {f"w{i}": (i % 9) - 4.0 for i in range(30_000)}
    check(spark, [(1, "w5 w77 very w123 not w4567 plain"), (2, "none of these"), (3, "W29999 and others")], lexicon)
    table = spark.createDataFrame(list(lexicon.items()), "word string, valence double")
    frame = spark.createDataFrame([(1, "w5")], "doc_id bigint, body string")
    assert len(text_valence(frame, "doc_id", "body", table)._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_empty_tables(spark):
    table = spark.createDataFrame([], "word string, valence double")
    assert text_valence(spark.createDataFrame([], "doc_id bigint, body string"), "doc_id", "body", table).count() == 0
    check(spark, [(1, "good"), (2, None)], {"unused": 1.0})


def test_small_and_large_lexicons_agree_and_marks_need_no_pattern(spark, monkeypatch):
    rows = [(i, f"GOOD {'very ' * (i % 3)}bad but not good{'!' * i}?") for i in range(8)] + [(9, None), (9, "good good"), (None, "bad")]
    frame = spark.createDataFrame(rows, "doc_id bigint, body string")
    table = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    small = text_valence(frame, "doc_id", "body", table)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    # marks are counted without a pattern that is tried at every character
    assert "regexp_replace(" not in plan
    monkeypatch.setattr(valence, "SENT_WORDS", 0)
    large = text_valence(frame, "doc_id", "body", table)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
