import itertools
import random
import time

from kinsift.llm import linededup as L


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain(rows):
    """Every line against every earlier line."""
    before, out = [], []
    for k, text in sorted(rows):
        left, n, kept = [], 0, 0
        for raw in text.split("\n"):
            line = raw.strip(L.BLANKS)
            if not line:
                left.append(raw)
                continue
            n += 1
            if not any(within_one(line, e) for e in before):
                left.append(raw)
                kept += 1
            before.append(line)
        out.append((k, n, kept, "\n".join(left)))
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_lines", "n_kept", "text").collect())


def test_edits_against_brute_force(spark):
    base = ["the quick brown fox jumps", "aaaaaaaaaaaaaaaaaaaa", "ñandú über straße ñandú", "short line", "abc", "q", "☃", "no"]
    lines = []
    for b in base:
        for i in (0, 1, len(b) // 2 - 1, len(b) // 2, len(b) - 1, len(b)):
            lines += [b[:i] + "x" + b[i:], b[:i] + b[i + 1 :], b[:i] + "y" + b[i + 1 :], b]
    rows = [(7 * i % 97, "\n".join(p)) for i, p in enumerate(itertools.batched(lines + [" " + x + "\t" for x in lines[::5]], 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(L.deduplicated(docs)) == plain(rows)


def test_edge_rows(spark):
    long = "long line " * 3000
    rows = [(3, None, 1), (1, "", 2), (2, "apple\r\n\n  \nberry\n", 3), (4, "berry\napple\n\nclove", 4), (5, long, 5), (6, long[:-2] + "X ", 6), (7, "apple\nberry", 7), (None, "clove\nnew line", 8), (8, "same\nsame", 9)]
    docs = spark.createDataFrame([(*r, "k", "x", 7, "y") for r in rows], "doc_id long, text string, n_chars int, n_lines string, __gone string, row int, hash string")
    got = {r.doc_id: r for r in L.deduplicated(docs).collect()}
    assert len(got) == 9 and got[3].text is None and got[3].n_lines == 0
    assert got[2].text == "apple\r\n\n  \nberry\n" and got[7].text == "" and got[7].n_kept == 0 and got[7]["__gone"] == "x" and got[7].row == 7
    assert got[6].n_kept == 0 and got[5].n_kept == 1 and got[None].text == "clove\nnew line" and got[4].text == "" and got[8].text == "same"
    out = L.without_repeats(docs)
    rest = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(rest) == {3, 1, 2, 5, None, 8} and rest[8].n_chars == 4 and rest[8].n_lines == "k" and rest[8].hash == "y"


def test_very_long_lines(spark):
    long = "".join(f"{i:x} " for i in range(200_000))
    other = long[:500_000] + "#" + long[500_001:]
    docs = spark.createDataFrame([(1, long), (2, other), (3, long[:700_000] + long[700_001:]), (4, long + "and two"), (5, other[::-1])], "doc_id long, text string")
    start = time.perf_counter()
    assert {r.doc_id: r.n_kept for r in L.deduplicated(docs).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    assert time.perf_counter() - start < 120


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "first line"), (1, "other words"), (1, "other words"), (2, "other words\n\nmore"), (2, "other words\n\nmore"), (3, None), (3, None), (None, "null id"), (None, "null id")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text or "", r.n_kept) for r in L.deduplicated(docs).collect()))
    assert got == [(0, "", 0), (0, "null id", 1), (1, "", 0), (1, "first line", 1), (1, "other words", 1), (2, "", 0), (2, "\nmore", 1), (3, "", 0), (3, "", 0)]
    assert L.deduplicated(docs.filter("false")).collect() == []
    assert L.without_repeats(docs.filter("false")).columns == docs.columns


def test_a_counter_and_a_hot_line_lose_no_link(spark):
    rows = [(i, f"entry {i:04d} of the same list\nstanding line") for i in range(300)] + [(1000 + i, "standing line") for i in range(300)]
    assert found(L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_native_plan(spark, sf):
    plan = L.deduplicated(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_wider_edit_bounds_against_brute_force(spark):
    rng = random.Random(4)
    lines = []
    for b in ["the quick brown fox jumps", "aaaaaaaaaaaaaaaaaaaa", "ñandú über straße ñandú", "short line"]:
        for _ in range(25):
            line = b
            for _ in range(rng.randint(0, 5)):
                i = rng.randrange(len(line))
                line = rng.choice([line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + "y" + line[i + 1 :]])
            lines.append(line)
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = []
    for edits in (0, 1, 2, 3):
        want = [x for i, x in enumerate(lines) if not any(distance(x, e) <= edits for e in lines[:i])]
        assert [r[3] for r in found(L.deduplicated(docs, edits=edits)) if r[2]] == want
        kept.append(len(want))
    assert kept == sorted(set(kept), reverse=True)
