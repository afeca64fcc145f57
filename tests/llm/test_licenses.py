import re

from kinsift.llm import licenses as L


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_spans(w):
    """Every cluster of diagonals of every notice, aligned with it."""
    spans = set()
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    for notice, label in L.NOTICES:
        t = notice.split(" ")
        votes = [(i, j) for j in range(len(t) - 2) for i in where.get(tuple(t[j : j + 3]), ())]
        drift = L.drift_of(len(t))
        clusters = {}
        for i, j in votes:
            for key in [(0, i - j)] if not drift else [(0, (i - j) // (2 * drift)), (1, (i - j + drift) // (2 * drift))]:
                clusters.setdefault(key, []).append((i, j))
        for own in clusters.values():
            if len({j + x for _, j in own for x in range(3)}) / len(t) < L.ENOUGH:
                continue
            first, last = min(i for i, _ in own), max(i for i, _ in own) + 3
            longer, edits = max(len(t), last - first), edit_distance(w[first:last], t)
            if edits <= (0 if len(t) < 10 else int(longer * (1 - L.LEAST) + 1e-9)):
                spans.add((label, first, last - 1, (longer - edits) / longer, longer - edits))
    return sorted(s for s in spans if not any(t[1] <= s[2] and s[1] <= t[2] and t[4] > s[4] for t in spans))


def plain(rows):
    out = []
    for k, text in rows:
        w = plain_words(text)
        places, labels, score = [], set(), 0.0
        for phrase, label in L.BASE:
            p = phrase.split(" ")
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
            score = max(score, float(bool(at)))
        spans = plain_spans(w)
        score = max([score, *(s[3] for s in spans)])
        out.append((k, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x[2] for x in want) > 10
    assert found(L.digest(docs)) == want


def test_edge_rows(spark):
    mit = L.NOTICES[0][0]
    bent = mit.replace("free of charge", "wholly free of any charge").title()
    rows = [(1, None), (2, ""), (3, "MIT"), (4, "MIT-License"), (5, "the mit license mit license"), (5, "the mit license mit license"), (None, "GNU General  Public\nLicense"), (6, bent), (7, mit[: len(mit) // 3]), (8, "licence é mit\x80license " + "license " * 50_000), (9, "public license mit"), (10, " ".join(n for n, _ in L.NOTICES) * 2), (11, "of the software " * 200)]
    docs = spark.createDataFrame([(*r, 3, "q", 1) for r in rows], "doc_id long, text string, n_words int, words string, row int")
    assert found(L.digest(docs)) == plain(rows)
    spans = {r.doc_id: r.spans for r in L.scan(docs).collect()}
    assert [(s.label, s.first) for s in spans[6]] == [("mit", 0)] and spans[6][0].share < 1 and spans[11] == []


def test_notices_are_told_apart(spark):
    of = lambda label: next(n for n, x in L.NOTICES if x == label)
    filler = "some other words " * 9
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "licensed under CC BY-SA"), (3, "Licensed under CC by mail"), (4, filler + of("lgpl") + " " + filler), (5, of("agpl")), (6, of("isc").replace("fee", "charge") + ". " + of("zlib")), (7, filler + " ".join(of("unlicense").split()[:25])), (8, "Licensed under CC BY 4.0. " * 9), (9, of("mit").replace("software", "work product"))]
    got = {r.doc_id: r.labels for r in L.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "cc-by-nc", 2: "cc-by-sa", 3: "cc-by", 4: "gpl,lgpl" if "general public license" in of("lgpl") else "lgpl", 5: "agpl,gpl", 6: "isc,zlib", 7: "unlicense", 8: "cc-by", 9: got[9]}
    assert found(L.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_labels_go_beyond_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.filter("text like '%Licensed under CC BY-NC 4.0.%'")
    got = [r for r in L.digest(lines).collect()]
    assert len(got) > 50 and all("cc-by-nc" in r.labels.split(",") and "cc-by-nc" not in r.base_labels for r in got)


def test_empty_and_native_plan(spark, sf):
    assert L.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    plan = L.digest(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
