import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import lines


def slow(rows, min_lines, long_line, min_chars=0):
    """Rows in the order (id, row): every later start of a run marks its lines."""
    cut = [t.split("\n") if t is not None else [] for _, t in rows]
    seen, out = set(), []
    gone = [set() for _ in rows]
    for n, parts in enumerate(cut):
        for i in range(len(parts)):
            size = min_lines
            while i + size <= len(parts):
                run = (size, *parts[i:i + size])
                if run in seen and sum(map(len, run[1:])) >= min_chars:
                    gone[n].update(range(i, i + size))
                seen.add(run)
                size *= 2
            if len(parts[i]) >= long_line:
                if (parts[i],) in seen and min_lines > 1:
                    gone[n].add(i)
                seen.add((parts[i],))
    for n, parts in enumerate(cut):
        best = run = 0
        for i in range(len(parts)):
            run = run + 1 if i in gone[n] else 0
            best = max(best, run)
        text = None if rows[n][1] is None else "\n".join(p for i, p in enumerate(parts) if i not in gone[n])
        out.append((rows[n][0], text, len(parts), len(gone[n]), best))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_lines", "min_chars"), [(2, 0), (3, 0), (4, 0), (7, 0), (1, 6), (2, 7), (2, 40), (3, 12), (2, 100)])
def test_matches_brute_force(docs, min_lines, min_chars):
    rng = random.Random(min_lines)
    alphabet = ["", "a", "b", "c", "x" * 9, "y" * 12]
    rows = []
    for i in range(80):
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(old))
            text = "\n".join([f"own {i}"] + old[at:at + rng.randrange(1, 12)] + ["end"])
        else:
            text = "\n".join(rng.choice(alphabet + [f"u{rng.randrange(400)}"] * 8) for _ in range(rng.randrange(1, 20)))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "same\n" * 40), (103, "same\n" * 40), (104, "é\u2028\r\nb")]
    frame = docs(rows).withColumn("line", F.lit("q")).withColumn("row", F.lit(1)).withColumn("first", F.lit(1)).repartition(5)
    got = [tuple(r) for r in lines.drop_repeated_lines(frame, min_lines=min_lines, long_line=9, min_chars=min_chars).collect()]
    assert sorted(got, key=repr) == slow(rows, min_lines, 9, min_chars)


def test_repeated_rows_null_ids_and_empty(docs):
    assert lines.drop_repeated_lines(docs([])).count() == 0
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "z")]
    got = [tuple(r) for r in lines.drop_repeated_lines(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "a\nb", 2, 0, 0), (1, "", 2, 2, 2), (1, "", 2, 2, 2), (2, "z", 1, 0, 0)], key=repr)


def test_short_shared_lines_stay_unless_a_stretch_has_enough_text(docs):
    body = [f"line {i} of it" for i in range(9)]
    rows = [(1, "first\n}\n\nother words here"), (2, "second\n}\n\nquite different"), (3, "\n".join(["a", *body, "b"])), (4, "\n".join(["c", *body, "d"])),
            (5, "x\n" * 500), (6, "y" * 100_000 + "\n}\n" + "z"), (7, "y" * 100_000 + "\n}\nw")]
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs(rows), min_chars=60).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 0] and got[4]["text"].split("\n")[0] == "c" and got[4]["longest_run"] == 9
    # starts one, two, three lines on are copies too, once they have sixty characters
    assert got[5]["n_removed"] == 499 and got[7]["text"] == "w"
