import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows, templates=licenses.TEMPLATES, share=0.7, anchors=3):
    import math
    vocabulary = {w for t in templates for w in t.words}
    bags = [set(words(t)) for _, t in rows]
    weight = {w: 1 + math.log((1 + len(rows)) / (1 + sum(w in b for b in bags))) for w in vocabulary}
    rare = {t: sorted(set(t.words), key=lambda w: (t.words.count(w) > 1, -weight[w], w))[:anchors] for t in templates}
    out = []
    for i, text in rows:
        ws = words(text)
        places, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [o for o in range(len(ws)) if ws[o:o + len(p)] == p]
            places += found
            base |= {label} if found else set()
        labels, best = set(base), 0.0
        for t in templates:
            laid = range(-len(t.words), len(ws))
            same = lambda o, n: 0 <= o + n < len(ws) and ws[o + n] == t.words[n]  # noqa: E731, B023
            for o in laid:
                if sum(same(o, t.words.index(w)) for w in rare[t]) < min(2, len(rare[t])) or not all(same(o, n) for n in t.key_at):
                    continue
                worth = min(1.0, sum(weight[w] for n, w in enumerate(t.words) if same(o, n)) / sum(weight[w] for w in t.words))
                if worth >= share:
                    labels.add(t.label)
                    best = max(best, worth)
        out.append((i, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9)))
    return sorted(out, key=repr)


def test_matches_brute_force(docs):
    rng = random.Random(2)
    fill = ["the", "of", "license", "mit", "apache", "general", "public", "code", "É", "x1", "under"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(fill, k=rng.randrange(25)))
        for t in rng.sample(licenses.TEMPLATES, rng.choice([0, 0, 1, 2])):
            own = [w if rng.random() > 0.05 else "zz" for w in t.words]
            text += rng.choice([" ", ".\n", "--"]) + rng.choice([" ", ", "]).join(w.upper() if rng.random() < 0.3 else w for w in own) + " end"
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "MIT License"), (503, "mit, license"), (504, "mıt license"), (505, "mit licenſe"), (506, "MIT LİCENSE"),
             (507, "apaKhe license"), (508, "mit license " * 5000), (None, "The Apache License"), (5, rows[5][1]), (509, "the mit license. mit license")]
    extra = docs(rows).withColumn("_words", F.lit("w")).withColumn("labels", F.lit(1)).withColumn("col", F.lit(1))
    got = [(*tuple(r)[:-1], round(r[-1], 9)) for r in licenses.scan_licenses(extra).collect()]
    assert sorted(got, key=repr) == slow(rows)


def test_empty(docs):
    assert licenses.scan_licenses(docs([])).count() == 0


@pytest.mark.parametrize("anchors", [1, 2, 5])
def test_any_number_of_anchors(docs, anchors):
    """Also templates with fewer words than anchors, and with words that stand in them more than once."""
    rng = random.Random(anchors)
    own = (*licenses.TEMPLATES[:3], licenses.Template("short", "wtfpl", "wtfpl"), licenses.Template("two", "free free", "free free"),
           licenses.Template("twice", "do what you want do what you like", "want do what"))
    rows = [(i, " ".join(rng.choices(["free", "wtfpl", "do", "what", "you", "want", "like", "the"], k=rng.randrange(20))) + rng.choice(["", " do what you want do what you like"]))
            for i in range(120)]
    got = [(*tuple(r)[:-1], round(r[-1], 9)) for r in licenses.scan_licenses(docs(rows), templates=own, anchors=anchors).collect()]
    assert sorted(got, key=repr) == slow(rows, own, anchors=anchors)
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs(rows), anchors=0)


def test_hundreds_of_whole_templates(docs):
    """The plan holds the index as constants: three hundred templates of a hundred words are no larger than a few."""
    rng = random.Random(11)
    usual = ["the", "of", "to", "and", "any", "license", "software"]
    own = []
    for n in range(300):
        ws = [rng.choice(usual) if rng.random() < 0.5 else f"t{rng.randrange(2500)}" for _ in range(100)]
        ws[40:43] = ["key", f"phrase{n % 40}", f"number{n}"]
        own.append(licenses.Template(f"l{n:03}", " ".join(ws), " ".join(ws[40:43])))
    rows = []
    for i in range(25):
        text = [rng.choice(usual) for _ in range(rng.randrange(40))]
        for t in rng.sample(own, rng.choice([0, 1, 2])):
            lost = rng.choice([0, 0, 0.1])
            text += [w if rng.random() >= lost else "zz" for w in t.words] + ["end"]
        rows.append((i, " ".join(text)))
    got = [(*tuple(r)[:-1], round(r[-1], 9)) for r in licenses.scan_licenses(docs(rows), templates=tuple(own)).collect()]
    want = slow(rows, own)
    assert sorted(got, key=repr) == want and sum(bool(r[6]) for r in want) > 8
    frame = licenses.scan_licenses(docs(rows), templates=tuple(own))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
