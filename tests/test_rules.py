"""Each branch of the scalar rules on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import language, markup, pii, responses, scoring, text


def value(spark, column, **cells):
    ddl = {str: "string", int: "int", float: "double", bool: "boolean"}
    names = list(cells)
    types = ", ".join(f"{n} {'array<string>' if isinstance(cells[n], list) else ddl.get(type(cells[n]), 'string')}" for n in names)
    df = spark.createDataFrame([tuple(cells[n] for n in names)], types) if names else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


a, b = F.col("a"), F.col("b")


@pytest.mark.parametrize("shown, date", [
    ("1/2/49", (1, 2, 2049)), ("1/2/50", (1, 2, 1950)), ("01-02-99", (1, 2, 1999)), ("1.2.100", (1, 2, 100)),
    ("  12/31/2010 noon", (12, 31, 2010)), ("99/99/2010", (99, 99, 2010)), ("on 1/2/2010", None), ("2010-01-02", None),
    ("", None), (None, None)])
def test_parse_us_date(spark, shown, date):
    got = value(spark, scoring.parse_us_date(a), a=shown)
    assert (tuple(got) if got else None) == date


@pytest.mark.parametrize("ext, exp, score", [
    ("ABC", "abc ", 1.0), ("Commercial ABC", "abc", 1.0), ("O'Brien", "OBrien", 1.0), ("abc def", "abc", 0.8),
    ("abc", "abc def", 0.8), ("abc", "xyz", 0.0), (None, "abc", 0.0), ("", "abc", 0.8), (None, None, 1.0), ("", None, 1.0),
    ("null", None, 1.0), ("<UNKNOWN>", None, 1.0), ("abc", None, 0.0)])
def test_score_text(spark, ext, exp, score):
    assert value(spark, scoring.score_text(a, b), a=ext, b=exp) == score


@pytest.mark.parametrize("exp, ext, score", [
    ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0), (["General Liability"], ["Commercial General Liability"], 1.0),
    (["a1", "b1"], ["a1"], 0.5), (["a1"], ["a1", "x", "y"], 0.9), (["a1"], ["a1"] + [c * 2 for c in "qrstuvw"], 0.8),
    (["a1", "b1"], ["x", "y", "z", "q", "r"], 0.0)])
def test_score_list(spark, exp, ext, score):
    assert value(spark, scoring.score_list(a, b), a=ext, b=exp) == pytest.approx(score)


@pytest.mark.parametrize("ext, exp, score", [("1/2/2010", "01-02-10", 1.0), ("1/3/2010", "1/2/2010", 0.0), ("soon", "soon", 0.0),
                                             (None, "1/2/2010", 0.0), (None, None, 1.0), ("1/2/2010", None, 0.0)])
def test_score_date(spark, ext, exp, score):
    assert value(spark, scoring.score_date(a, b), a=ext, b=exp) == score


@pytest.mark.parametrize("shown", ["\xa0 x\t\r\n", " x ", "　x\x85", "\x1cx"])
def test_strip_like_python(spark, shown):
    assert value(spark, text.strip_ws(a), a=shown) == shown.strip()


def test_title_text(spark):
    short, joined = text.title_text(a, b, 5, 12)
    assert value(spark, short, a="  long title", b="x") == "long "
    assert value(spark, joined, a="t", b="body of text") == "t -- body of"
    assert value(spark, joined, a=None, b="- body -") == "body"


def test_prompt_slots(spark):
    assert value(spark, text.compose_prompt("Q {a}: {b}!", a=a, b=b), a="x", b=None) == "Q x: !"
    with pytest.raises(ValueError):
        text.compose_prompt("{c}", a=a)


@pytest.mark.parametrize("shown, paper", [("http://x/abs/2301.12345v2", "2301.12345"), ("http://x/abs/2301.12345", "2301.12345"),
                                          ("http://x/abs/hep-vx", "hep-vx")])
def test_paper_id(spark, shown, paper):
    assert value(spark, text.paper_id(a), a=shown) == paper


def test_citations(spark):
    assert value(spark, text.extract_citations(a), a="[arxiv:1.2] [ArXiv:a/b-1] [arxiv:1.2] [arxiv:]") == ["1.2", "a/b-1"]


@pytest.mark.parametrize("shown, ok", [('{"a": 1}', True), ("[]", True), ("1", True), ("null", True), ('"x"', True), ('{"a": 1}]', False),
                                       ('{"a": 1}}', False), ("[1] [2]", False), ("", False), ("1, 2", False), ("{", False),
                                       ('1, "end": 1}', False), ("no", False)])
def test_is_json_needs_the_whole_text(spark, shown, ok):
    assert value(spark, responses.is_json(a), a=shown) is ok


def test_clean_model_json(spark):
    assert value(spark, responses.clean_model_json(a), a='```json\n{"a": 1}\n```\n') == '{"a": 1}'


@pytest.mark.parametrize("shown, ids", [('[{"k": 1}, {"k": 2}]', [1, 2]), ('{"k": 3}', [3]), ('[{"k": 1}, 5, "x"]', [1]), ("7", []),
                                        ("no", []), ("[]", []), ('[{"k": 1}] x', [])])
def test_as_list(spark, shown, ids):
    got = value(spark, responses.as_list(a, "struct<k bigint>"), a=shown)
    assert [r["k"] for r in got] == ids


RULES = [responses.FieldRule("name", "string"), responses.FieldRule("score", "number", nullable=True, low=0, high=5),
         responses.FieldRule("mood", "string", required=False, choices=("good", "bad"))]


@pytest.mark.parametrize("shown, found", [
    ('{"name": "x", "score": 4.8}', []), ('{"name": "x", "score": null, "mood": "good"}', []), ('{"score": 1}', ["missing:name"]),
    ('{"name": 3, "score": "high"}', ["type:name", "type:score"]), ('{"name": "x", "score": 9}', ["range:score"]),
    ('{"name": "x", "score": 1, "mood": "odd", "z": 1, "y": 2}', ["choice:mood", "extra:y", "extra:z"]), ("[1]", ["not_object"]),
    ("broken", ["not_object"])])
def test_validate_response(spark, shown, found):
    assert value(spark, responses.validate_response(a, RULES), a=shown) == found


def test_elements_to_text(spark):
    tree = '{"document": {"elements": [{"content": "a", "type": "t"}, {"content": null}, {"content": "b"}]}}'
    assert value(spark, responses.elements_to_text(a), a=tree) == "a\nb"


@pytest.mark.parametrize("shown, score", [("1. a\n2. b", (2 + (600 - 9) / 200) / 5), ("1. a\n2. a", (1 + (600 - 9) / 200) / 5),
                                          ("x" * 700, 1 / 5)])
def test_length_list_metric(spark, shown, score):
    assert value(spark, scoring.length_list_metric(a), a=shown) == pytest.approx(score)


def test_visible_text(spark):
    page = "<p>a &lt;b&gt; <b>c</b></p><script>var x='</p>'</script><p>d&#233; &amp;amp; &middot;</p><!-- z -->"
    assert value(spark, markup.visible_text(markup.drop_hidden(a)), a=page) == "a <b> c\ndé &amp; ·"


def test_sections_reset_lower_headers(spark):
    from tessera.operators.documents import html_header_sections

    page = "<p>pre</p><h2>A</h2>one<h3>x</h3>two<h2 class='k'>B</h2>three<h4>deep</h4>four"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    rows = html_header_sections(df, "id", "html").orderBy("sec_no").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("", "", "", "pre"), ("A", "", "", "one"), ("A", "x", "", "two"), ("B", "", "", "three"), ("B", "", "deep", "four")]


def test_sentiment_against_direct_formula(spark):
    lexicon = {"good": 2.0, "bad": -1.5}
    got = value(spark, language.sentiment(a, lexicon), a="Good good day, bad luck")
    s = 2.5
    assert got["compound"] == pytest.approx(round(s / (s * s + 15) ** 0.5, 4))
    total = 2 * 3.0 + 2.5 + 2
    assert (got["pos"], got["neg"], got["neu"]) == (round(6 / total, 3), round(2.5 / total, 3), round(2 / total, 3))


def test_route_defaults_to_retrieval(spark):
    route = lambda q, h: value(spark, language.route_with_default(a, b, F.lit(None).cast("string")), a=q, b=h)
    assert route("what is it", None)["need_retrieval"] is True
    assert route("", "known words")["need_retrieval"] is True
    assert route("known words", "some known words")["need_retrieval"] is False
    assert route("new facts please", "known words")["need_retrieval"] is True


def entities(*pairs):
    return F.array(*[F.struct(F.lit(0).alias("pos"), F.lit(t).alias("entity_type"), F.lit(v).alias("original_value"))
                     for t, v in pairs])


def test_salt_reuses_ids(spark):
    got = value(spark, pii.with_salt_ids(entities(("EMAIL", "x"), ("PHONE", "y"), ("EMAIL", "z"), ("EMAIL", "x"))))
    assert [e["salt_id"] for e in got] == ["EMAIL_001", "PHONE_001", "EMAIL_002", "EMAIL_001"]


def test_mask_is_sequential_longest_first(spark):
    salted = lambda *p: pii.with_salt_ids(entities(*p))
    assert value(spark, pii.mask(F.lit("john johnson"), salted(("PERSON", "john"), ("PERSON", "johnson")))) == "PERSON_001 PERSON_002"
    # A short value also hits inside an id that was written before.
    assert value(spark, pii.mask(F.lit("4111 001"), salted(("CREDIT_CARD", "4111"), ("OTHER", "001")))) == "CREDIT_CARD_OTHER_001 OTHER_001"


def pairs(*items):
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in items]) if items else F.array().cast(
        "array<struct<type string, value string>>")


@pytest.mark.parametrize("pred, gold, counts", [
    ([], [], (0, 0, 0)), ([("EMAIL", "a@b")], [], (0, 1, 0)), ([], [("EMAIL", "a@b")], (0, 0, 1)),
    ([("PERSON", "Ann Lee"), ("PERSON", "Ann")], [("PERSON", "ann lee")], (1, 1, 0)),
    ([("PERSON", "x")], [("OTHER", "x")], (1, 0, 0)), ([("OTHER", "x")], [("PERSON", "x")], (0, 1, 1)),
    ([("SSN", "123-45-6789")], [("SSN", "123 45 6789")], (1, 0, 0)),
    ([("PERSON", "a"), ("PERSON", "ab")], [("PERSON", "ab"), ("PERSON", "a")], (2, 0, 0)),
    ([("PERSON", "- -")], [("PERSON", "zed")], (1, 0, 0))])
def test_greedy_match(spark, pred, gold, counts):
    assert tuple(value(spark, pii.match(pairs(*pred), pairs(*gold)))) == counts


def test_empty_document_scores_one(spark):
    scores = pii.document_scores(F.lit(0), F.lit(0), F.lit(0))
    assert [value(spark, c) for c in scores.values()] == [1.0, 1.0, 1.0]


def test_truth_reads_json_literals_and_ranges(spark):
    got = lambda s: [tuple(e) for e in value(spark, pii.truth(a, b), a=s, b="mail ann@x.org now")]
    assert got('[{"label": " Email ", "text": " a@b "}, 5]') == [("EMAIL", "a@b")]
    assert got("[{'type': 'iban', 'value': \"O'X1\"}]") == [("BANK_ACCOUNT", "O'X1")]
    assert got('[{"label": "thing", "start": 5, "end": 14}]') == [("OTHER", "ann@x.org")]
    assert got('[{"label": "name", "text": " x "}]') == []
    assert got("nothing") == []


@pytest.mark.parametrize("spans", [
    [{"label": "name", "text": None, "start": 5, "end": 8}, {"label": "city", "text": "Ulm", "sure": True, "seen": False}],
    ({"label": "name", "text": "O'Neil \"x\""},), (), [{"type": "email", "value": "a\\b'c\\'d"}], [{"type": "dob", "value": "a\tb\nc\x85d é"}],
    [{"label": "None", "text": "(True, None)"}, {"label": "iban", "text": "[a,]"}], [{"label": "city", "score": 0.5, "at": (1, 2), "text": "New York"}]])
def test_truth_reads_python_literals(spark, spans):
    shown = "mail ann@x.org now"
    want = []
    for s in spans:
        found = s.get("text", s.get("value")) or shown[s["start"]:s["end"]]
        want.append((pii.LABEL_TYPES.get(s.get("label", s.get("type")).lower(), "OTHER"), found.strip()))
    assert [tuple(e) for e in value(spark, pii.truth(a, b), a=repr(spans), b=shown)] == want


@pytest.mark.parametrize("spans", ["[{'label': 'name', 'text': 'it's'}]", "[{'label': 'name', 'text': u'abc'}]", "['a' 'b'", "'", ""])
def test_truth_of_unreadable_spans_is_empty(spark, spans):
    assert value(spark, pii.truth(a, b), a=spans, b="text") == []


@pytest.mark.parametrize("answer, expected, score", [
    ('"a"', [], 1.0), ("7", [], 1.0), ('{"x": 1}', [], 1.0), ("[]", [], 1.0), ('["a"]', [], 0.0), ("null", [], 0.0), (None, [], 0.0),
    ('"a"', ["a"], 0.0), ('["a1", "x"]', ["a1"], 0.95), ("null", None, 1.0), (None, None, 1.0), ('""', None, 1.0), ('"<UNKNOWN>"', None, 1.0),
    ('"a"', None, 0.0), ("[]", None, 0.0)])
def test_score_list_answer(spark, answer, expected, score):
    want = (F.lit(None) if expected is None else F.array(*[F.lit(v) for v in expected])).cast("array<string>")
    assert value(spark, scoring.score_list_answer(F.try_parse_json(a), want), a=answer) == pytest.approx(score)


@pytest.mark.parametrize("number, ok", [("4111-1111-1111-1111", True), ("4111 1111 1111 1112", False)])
def test_luhn(spark, number, ok):
    assert value(spark, pii.luhn_ok(a), a=number) is ok


def test_detect_types(spark):
    shown = ("Dr. Maria Garcia, born on 01/15/1990, 742 Evergreen Terrace, ann@x.org, +1 (555) 123-4567, 123-45-6789, "
             "4111111111111111, 4111111111111112, DE89370400440532013000, 10.0.0.1###")
    got = value(spark, pii.detect(a), a=shown)
    # The digits inside the account number count as well: a value too many is better than one too few.
    assert [e["entity_type"] for e in got] == ["PERSON", "DATE_OF_BIRTH", "ADDRESS", "EMAIL", "PHONE", "SSN", "CREDIT_CARD",
                                               "BANK_ACCOUNT", "BANK_ACCOUNT", "BANK_ACCOUNT", "OTHER"]


def test_sentiment_counts_as_the_word_rule(spark, monkeypatch):
    """Words counted in Arrow, piece by piece, are those of ``tokenize_words``, whatever the characters."""
    import random

    monkeypatch.setattr(language, "PIECE_BYTES", 200)
    rng = random.Random(4)
    lexicon = {"good": 2.0, "bad": -1.5, "été": 1.0, "x": 0.0, "νος": 3.0, "a-b": 9.0, "": 1.0, "ⱥ": 0.5, "war_1": -1.5, "𝒳": 4.0}
    marks = [" ", "\n", "-", "’", "…", "€", "\u00a0", "\x00", "'", "_", "ª", "²", "½", "\u0301", "\u0130", "Σ", "Ⅳ", "中", "𝒳", "ǅ", "Ⱥ"]
    words = ["Good", "BAD", "ÉTÉ", "x", "νοΣ", "war_1", "WAR_1", "straße", "other", "A-B", "7"]
    texts = ["".join(rng.choice(words) + rng.choice(marks if i % 2 else marks[:10]) for _ in range(rng.randrange(30))) for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "\n\n", "good " * 500])], "id int, text string")
    odd = rows.select("id", F.decode(F.concat(F.encode(F.lit("good "), "utf-8"), F.unhex(F.lit("41ff20"))), "iso-8859-1").alias("text")).limit(1)
    rows = rows.unionByName(odd).repartition(2)
    fast = sorted(map(repr, rows.select("id", language.sentiment(F.col("text"), lexicon).alias("s")).collect()))
    known = rows.select(language.word_counts([["good"]])(F.col("text")).alias("c"))
    assert known.where("c is not null").count() > 50
    monkeypatch.setattr(language, "word_counts", lambda groups: lambda text: F.lit(None).cast("array<int>"))
    assert fast == sorted(map(repr, rows.select("id", language.sentiment(F.col("text"), lexicon).alias("s")).collect()))
