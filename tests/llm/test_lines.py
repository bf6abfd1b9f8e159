"""Line dedup against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.llm import lines
from reelspark.llm.lines import drop_duplicate_lines, duplicate_lines


def brute(rows, t=0.8):
    lines = []
    for i, text in rows:
        if i is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                lines.append(((i, k), frozenset(line.encode().split())))
    first = {}
    for place, s in sorted(lines, key=lambda x: x[0]):
        first.setdefault(s, place)
    sets = sorted(((p, s) for s, p in first.items() if s), key=lambda x: x[0])
    kept = {p for k, (p, s) in enumerate(sets) if not any(len(s & o) >= t * len(s | o) - 1e-9 for _, o in sets[:k])}
    out = []
    for i, text in rows:
        own = [] if text is None else text.split("\n")
        keep = [k for k, line in enumerate(own) if i is None or not line.split() or (i, k) in kept]
        out.append((str(i), len(own), len(own) - len(keep), keep))
    return sorted(out)


def marked(spark, rows):
    """The order of several texts of one id: by the mark of the text."""
    from reelspark.llm.lines import text_mark
    texts = spark.createDataFrame([(t,) for t in sorted({t for _, t in rows if t is not None})], "t string")
    return {r.t: r.m for r in texts.select("t", text_mark(texts["t"]).alias("m")).collect()}


def brute_repeated(spark, rows, t=0.8):
    """All pairs of lines, where a line stands in a text, a text under an id, and equal rows are one."""
    mark = marked(spark, rows)
    places = {}
    for i, text in rows:
        if i is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                places[(i, mark[text], k)] = frozenset(line.encode().split())
    kept, seen = set(), []
    for place in sorted(places):
        s = places[place]
        if s and not any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
            kept.add(place)
        if s:
            seen.append(s)
    out = []
    for i, text in rows:
        own = [] if text is None else text.split("\n")
        keep = [k for k, line in enumerate(own) if i is None or not line.split() or (i, mark[text], k) in kept]
        out.append((str(i), len(own), len(own) - len(keep), keep))
    return sorted(out)


def test_several_texts_of_one_id(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "first line here\nalpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "alpha beta gamma delta"),
            (2, None), (3, "first line here\nnew words stand here\n"), (3, "new words stand here"), (None, "first line here"), (4, "one\ntwo"), (4, "two\none\nthree")]
    got = run(spark, rows)
    assert got == brute_repeated(spark, rows)
    assert all(n >= 0 and (not keep or max(keep) < size) for _, size, n, keep in got)


def test_random_repeated_ids_match_all_pairs(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefghijkl") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = [(rng.randint(0, 25), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))) for _ in range(90)]
    assert run(spark, rows + rows[:10]) == brute_repeated(spark, rows + rows[:10])


def test_one_of_equal_rows_stays(spark):
    rows = [(1, "a b c\nd e", "x"), (1, "a b c\nd e", "y"), (1, "other text", "z"), (2, "a b c", "w"), (None, "a b c", "n"), (None, "a b c", "n"), (3, None, "u"), (3, None, "u")]
    got = sorted((str(r.doc_id), str(r.text)) for r in drop_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string, size string")).collect())
    assert got == [("1", "a b c\nd e"), ("1", "other text"), ("3", "None"), ("None", "a b c"), ("None", "a b c")]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, pos int, words int")
    return sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_lines) for r in duplicate_lines(df).collect())


def test_random_lines_match_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{min(rng.randint(0, 300), rng.randint(0, 300))}" for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(60)]

    def variant(ws):
        ws = list(ws)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        rng.shuffle(ws)
        return " ".join(ws)
    rows = [(rng.randint(-500, 5000) * 7 + k, "\n".join(variant(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for k in range(150)]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, "a b c d e\n\nx"), (3, "e d c b a a"), (None, "a b c d e"), (7, None), (8, ""), (9, " \t \n\n"), (10, "x\x0by\rz\tq"), (11, "x y z q"),
            (12, "long " * 3 + " ".join(f"t{k}" for k in range(3000))), (13, " ".join(f"t{k}" for k in range(3000))),
            (14, "same\nsame\nsame two"), (14, "same\nsame\nsame two")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_text_without_duplicate_lines(spark):
    rows = [(1, "alpha beta gamma\n\ndelta", "k"), (2, "delta\nnew line here\n", "k"), (3, "gamma beta alpha\ndelta", "k"), (4, None, None), (5, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dl_kept string")
    got = {r.doc_id: (r.text, r.dl_kept) for r in drop_duplicate_lines(df).collect()}
    assert got == {1: ("alpha beta gamma\n\ndelta", "k"), 2: ("new line here\n", "k"), 4: (None, None), 5: ("", "k")}


def test_words_are_hashed_once_and_counts_reach_the_driver_as_arrow(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a b\tc"), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("a row object a slot"))
    levels = lines.rarity_levels(docs, "text")
    monkeypatch.undo()
    assert str(lines.ordered_keys(F.col("line"), levels)).count("xxhash64(") == 2       # a word's, and the empty word's
    got = docs.select(F.size(lines.ordered_keys(F.lit(" b\ta  a\rb "), levels)).alias("n"), F.array_sort(lines.hashes_of(F.lit("b\t\x0ba  a\rb"))).alias("h"),
                      F.array_sort(F.array(F.xxhash64(F.lit("a")), F.xxhash64(F.lit("b")))).alias("want")).first()
    assert got.n == 2 and got.h == got.want


def test_pairs_pass_the_cheap_filters_before_their_words_are_compared(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx y"), (2, "e d c b a\nz")], "doc_id long, text string")
    keys = docs.select(lines.ordered_keys(F.col("text"), lines.rarity_levels(docs, "text")).alias("keys"))
    assert not keys.schema["keys"].dataType.containsNull            # else Spark sorts objects instead of longs
    plan = lines.line_matches(docs)._jdf.queryExecution().optimizedPlan().toString()
    compared = [line for line in plan.splitlines() if "array_intersect(" in line]
    assert len(compared) == 1 and compared[0].count("array_intersect(") == 1
    assert 0 <= compared[0].find("bit_count(") < compared[0].find("array_intersect(")


def test_sets_at_the_threshold_and_just_below(spark):
    rows = []
    for n in (*range(1, 14), 27, 45, 63, 64, 65, 66, 90, 125):
        for m in {n, -(-4 * n // 5), n - 1} - {0}:
            least = -(-4 * (n + m) // 9)                                # words that the two must share
            for shared in {least, least - 1} & set(range(min(n, m) + 1)):
                tag = f"{n}_{m}_{shared}_"
                long = [f"{tag}c{k}" for k in range(shared)] + [f"{tag}a{k}" for k in range(n - shared)]
                short = [f"{tag}c{k}" for k in range(shared)] + [f"{tag}b{k}" for k in range(m - shared)]
                rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(reversed(short)))]
    got = run(spark, rows)
    assert got == brute(rows) and 0 < sum(r[2] for r in got) < len(rows) / 2
