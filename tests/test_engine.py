import pytest
from pyspark.sql import functions as F

from kinsift import cli
from kinsift import types as T
from kinsift.functions import lexer
from kinsift.operators import pairs, tally
from kinsift.operators.classify import classify
from kinsift.operators.seeds import is_seed
from kinsift.plans import compare, snippets
from kinsift.sources import files, typescript


@pytest.mark.parametrize(
    ("similarity", "overlap", "steps", "verdict", "domain"),
    [
        (0.84, 1.0, 0, T.REVIEW, T.SAME),
        (None, 1.0, 0, T.REVIEW, T.SAME),
        (0.9, None, 9, T.REVIEW, T.UNDECIDABLE),
        (0.85, 0.5, 9, T.EXTRACT, T.SAME),
        (0.9, 0.49, 2, T.DO_NOT_EXTRACT, T.SEPARATE),
        (0.9, 0.49, 1, T.REVIEW, T.UNDECIDABLE),
        (0.2, 0.0, 5, T.REVIEW, T.SEPARATE),
    ],
)
def test_decision_table(spark, similarity, overlap, steps, verdict, domain):
    signals = spark.createDataFrame([(similarity, overlap, steps)], f"{T.STRUCTURAL} double, {T.IMPORTS} double, {T.DISTANCE} int")
    row = classify(signals).first()
    assert (row.verdict, row.domain) == (verdict, domain)
    assert [r.signal for r in row.reasons] == [T.STRUCTURAL, T.IMPORTS, T.DISTANCE]
    assert row.reasons[0].lean == (T.TOWARD_EXTRACT if (similarity or 0) >= 0.85 else T.NEITHER)
    assert row.reasons[1].lean == (T.NEITHER if overlap is None else T.TOWARD_EXTRACT if overlap >= 0.5 else T.TOWARD_DO_NOT)


def test_snippets_chunks_imports_and_seeds(spark):
    source = spark.createDataFrame(snippets.SOURCES, "path string, source string")
    got = files.chunks(source).select("path", "seq", "kind", "start_line", "end_line", "has_error").collect()
    assert sorted(map(tuple, got)) == sorted(snippets.EXPECTED)
    modules = {r.path: r.modules for r in files.chunks(source).collect()}
    assert modules["shop/cart.ts"] == ["model/item", "react", "shop/rate"] and modules["broken/half.ts"] is None


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const f = async <T>(x: T): Promise<T> => x;", [("arrow_function", 1, 1)]),
        ("let f: (a: number) => void = a => { g(a) }", [("arrow_function", 1, 1)]),
        ("type F = (a: number) => void;\ninterface G { h(a: (b: string) => void): void }", []),
        ("const o = { get v() { return 1 }, async *g() {}, [k]() {}, 'q'() {} }", [("method_definition", 1, 1)] * 4),
        ("if (a) { b() }\nfor (const x of y) {\n}", []),
        ("const s = `a ${[1].map(x => x)} } ${`${() => 1}`}`;", [("arrow_function", 1, 1)] * 2),
        ("const r = /[}/]{/.test(s); function f() {\n}", [("function_declaration", 1, 2)]),
        ("function f(a: { b: number }): { c: string } {\n return { c: '' };\n}", [("function_declaration", 1, 3)]),
        ("abstract class A<T> extends B<T> implements C {\n constructor(private x: T) {\n  super();\n }\n abstract y(): void;\n z = () => 1;\n}", [("method_definition", 2, 4), ("arrow_function", 6, 6)]),
        ("export default function () {\n return 1;\n}", [("function_expression", 1, 3)]),
        ("x.function(1);\nfn(function* () {\n yield 1;\n});", [("generator_function", 2, 4)]),
        ("const a = x\n  ? (y) : z;\nconst g = (q) =>\n  q +\n  1\nlet k", [("arrow_function", 3, 5)]),
    ],
)
def test_chunk_shapes(source, want):
    assert [(k, a, b) for _, k, a, b, _, e in typescript.chunks_of(source) if not e] == want


def test_dependency_forms():
    source = """import a, { b } from './a';\nimport type { T } from "./t";\nimport './side';\nexport { c } from './c';\nexport * as d from './d';
export const e = './no';\nexport { f };\n// import './commented'\nconst g = require('./no');\nconst h = import('./h');\nconst i = import(`./${x}`);\nimport('');\nimport j = require('./no');\nconst k = "import './no'";\nimport {\n  l,\n  m,\n} from "./l";\n"""
    assert typescript.specifiers_of(source) == ["./a", "./t", "./side", "./c", "./d", "./h", "./l"]


SHAPES = {
    "sales/discount.ts": 'import { price } from "./price";\n\nconst cap = 3;\n\nexport function lowered(amount: number, rate: number): number {\n  const cut = amount * rate;\n  return Math.max(amount - cut, 0);\n}\n\nconst outside = 1;\n',
    "stock/refill.ts": 'import { shelf } from "./shelf";\n\nconst floor = 2;\n\nexport function missing(target: number, held: number): number {\n  const gap = target * held;\n  return Math.min(target + gap, 0);\n}\n',
    "day/long.ts": 'import { wide } from "../text/wide";\n\nexport function reef(s: Sail): string {\n  return `${wide(s.area())}`;\n}\n',
    "text/short.ts": 'import { wide } from "./wide";\n\nexport function furl(s: Sail): string {\n  return `${wide(s.edge())}`;\n}\n',
    "bad/open.ts": "export function open(a: number) {\n  if (a) {\n    return 1;\n",
    "none/plain.ts": "export function reefAgain(s: Sail): string {\n  return `${wide(s.area())}`;\n}\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in {**SHAPES, "node_modules/x/y.ts": SHAPES["text/short.ts"], "a/readme.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_compare_and_errors(spark, folder):
    source = files.read_files(spark, folder)
    assert sorted(r.path for r in source.collect()) == sorted(SHAPES)
    asked = {
        ("sales/discount.ts:6", "stock/refill.ts:6"): (T.DO_NOT_EXTRACT, None, None),
        ("day/long.ts:4", "text/short.ts:4"): (T.EXTRACT, None, None),
        ("day/long.ts:4", "none/plain.ts:2"): (T.REVIEW, None, None),
        ("gone.ts:1", "alsogone.ts:1"): (None, T.UNREADABLE, "gone.ts:1"),
        ("day/long.ts:4", "sales/discount.ts:10"): (None, T.CHUNKING_FAILED, "sales/discount.ts:10"),
        ("day/long.ts:100", "text/short.ts:4"): (None, T.CHUNKING_FAILED, "day/long.ts:100"),
        ("bad/open.ts:2", "text/short.ts:4"): (None, T.CHUNKING_FAILED, "bad/open.ts:2"),
        ("day/long.ts:x", "text/short.ts:4"): (None, T.NOT_A_NUMBER, "day/long.ts:x"),
    }
    rows = compare.compared(source, spark.createDataFrame(list(asked), "a string, b string")).collect()
    assert {(r.a, r.b): (r.verdict, r.error, r.error_at) for r in rows} == asked
    told = {r.a: r.error_text for r in rows}
    assert told["day/long.ts:100"] == "the source has only 5 lines" and told["bad/open.ts:2"] == "the function from line 1 has a syntax error"
    alike = next(r for r in rows if r.verdict == T.EXTRACT)
    assert alike.report.split("\n")[0] == "[EXTRACT-CANDIDATE] day/long.ts:4 <-> text/short.ts:4"
    assert alike.report.split("\n")[1] == "  structural similarity: 1.00 (threshold 0.85) -> toward extracting"
    unmeasured = next(r for r in rows if r.verdict == T.REVIEW)
    assert unmeasured.import_overlap is None and "not measured (a file has none) -> toward neither" in unmeasured.report


def test_scan_and_cap(spark, folder):
    rows = compare.scan(spark, folder).collect()
    assert len(rows) == 10 and {r.verdict for r in rows} == {T.REVIEW, T.EXTRACT, T.DO_NOT_EXTRACT}
    with pytest.raises(ValueError, match="10 pairs are more than 9"):
        compare.scan(spark, folder, cap=9)
    with pytest.raises(ValueError, match="make no pair"):
        compare.scan(spark, folder + "/day")


def test_command_line(spark, folder, capsys):
    assert cli.main(["--threshold", "0.5", "compare", "day/long.ts:4", "text/short.ts:4", "--root", folder, "--explain", "--fail-on", "do-not-extract"], spark) == 0
    assert "(threshold 0.5)" in capsys.readouterr().out
    assert cli.main(["compare", "gone.ts:1", "text/short.ts:4", "--root", folder], spark) == 1
    assert capsys.readouterr().err.startswith("gone.ts:1: the file can't be read")
    for wrong in (["compare", "a:1"], ["compare", "a:1", "b:1", "--threshold", "nan"], ["compare", "a:1", "b:1", "--lang", "rs"]):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)


def test_histogram_counts_pairs_within_and_between_classes(spark):
    rows = [(i, ["I", "N"], ["m"] if i % 2 else None, ["x"] if i % 3 else ["y", "z"]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id long, tokens array<string>, modules array<string>, dirs array<string>")
    want = {r.verdict: r.n for r in tally.histogram(pairs.verdict_pairs(chunks), "verdict").collect()}
    assert {r.verdict: r.n for r in pairs.verdict_histogram(chunks).collect()} == want and sum(want.values()) == 435


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.85, 1.0])
def test_prefix_filter_loses_nothing(spark, threshold):
    import random

    rng = random.Random(7)
    rows = [(i, sorted(rng.sample("abcdefghijkl", rng.randrange(1, 9)))) for i in range(150)]
    sets = spark.createDataFrame(rows, "id long, tokens array<string>")
    first = {}
    for i, t in rows:
        first.setdefault(tuple(t), i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
    assert {(r.rep_a, r.rep_b) for r in pairs.similar_sets(sets, threshold).collect()} == want


def test_recurrence(spark):
    rows = [(1, "a", False), (2, "a", False), (2, "a", True), (3, "a", False), (3, "b", False), (5, "b", False), (7, "c", True)]
    frame = spark.createDataFrame(rows, "pr long, tag string, fixed boolean")
    got = tally.records_after(tally.recurrence(frame, "tag", "pr", F.col("fixed")), frame.select(F.col("pr").alias("number")).distinct())
    assert sorted(map(tuple, got.collect())) == [("a", 1, 3, 3, 2), ("b", 2, 2, 5, 0)]


def test_records_after_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(tally, "BUCKET", 3)
    rows = [(n, f"t{n % 4}", n % 13 == 0) for n in range(1, 120) if n % 5]
    frame = spark.createDataFrame(rows, "pr long, tag string, fixed boolean")
    got = tally.records_after(tally.recurrence(frame, "tag", "pr", F.col("fixed")), frame.select(F.col("pr").alias("number")).distinct())
    last = {t: max((n for n, x, f in rows if x == t and f), default=0) for _, t, _ in rows}
    assert {r.tag: (r.last_intervention, r.records_after) for r in got.collect()} == {t: (n, sum(m > n for m, _, _ in rows)) for t, n in last.items()}


@pytest.mark.parametrize(("line", "seed"), [("function f() {", True), ("  method(a: T): U {  ", True), ("} else if (x) {", False), ("if (x) {", False), ("iffy(x) {", True), ("class A {", False), (") => {", False), ("for(;;) {", False), ("return x;", False)])
def test_seed_lines(spark, line, seed):
    assert spark.createDataFrame([(line,)], "t string").select(is_seed(F.col("t")).alias("x")).first().x is seed


def test_seed_lines_of_documents(spark, sf):
    from kinsift.plans.queries import seed_lines_documents

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert seed_lines_documents(spark, sf).select("doc_id").distinct().count() == n


def test_token_set_of_a_mere_comment_is_not_measured(spark):
    rows = [("a b", False), (" // nothing but a comment", True), ("/* c */", True), ("", True)]
    got = spark.createDataFrame(rows, "t string, missing boolean").select("missing", lexer.token_set(F.col("t")).isNull().alias("x")).collect()
    assert all(r.x is r.missing for r in got)


def test_streamed_verdicts_equal_batch(spark, tmp_path):
    from kinsift.streaming.verdicts import to_parquet, verdict_stream

    kind = "id long, tokens array<string>, modules array<string>, dirs array<string>"
    rows = [(i, ["I", "N"][: 1 + i % 2], ["m"], ["x"]) for i in range(6)]
    spark.createDataFrame(rows[:3], kind).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame(rows[3:], kind)
    stream = verdict_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), known)
    to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_wide_type_lists_and_generic_bases():
    many = ", ".join(f"T{i}" for i in range(500))
    source = f"class Wide extends Base<{many}> implements A<{{ x: number; y: string }}>, B {{\n  run() {{\n    return 1;\n  }}\n}}\nconst f = <{many}>(x: T0) => x;\nclass D<T = {{}}> extends mix({{ a: 1 }}) {{\n go(): void {{\n }}\n}}\nif (a) {{\n}}\n{{\n g()\n}}\n"
    assert [(k, a, b, e) for _, k, a, b, _, e in typescript.chunks_of(source)] == [("method_definition", 2, 4, False), ("arrow_function", 6, 6, False), ("method_definition", 8, 9, False)]


def test_only_searched_files_are_read(spark, folder):
    assert files.source_paths(spark, folder) == sorted(SHAPES)
    assert [r.path for r in files.read_files(spark, folder, ["day/long.ts", "gone.ts", "day/long.ts", ""]).collect()] == ["day/long.ts"]
    assert files.read_files(spark, folder, []).collect() == []


def test_pairs_are_whole_whatever_the_ids(spark):
    rows = [(i * 7 % 101, ["a", "b", "c"][: i % 4], None if i % 5 == 0 else [f"m{i % 3}"], ["x"] * (i % 3)) for i in range(80)]
    chunks = spark.createDataFrame([(i, t or None, m, d) for i, t, m, d in rows], "id long, tokens array<string>, modules array<string>, dirs array<string>")
    got = {(r.id_a, r.id_b): (r[T.STRUCTURAL], r[T.IMPORTS], r[T.DISTANCE]) for r in pairs.all_pairs(chunks).collect()}
    share = lambda a, b: None if not a or not b else len({*a} & {*b}) / len({*a} | {*b})
    want = {(a[0], b[0]): (share(a[1], b[1]), share(a[2], b[2]), abs(len(a[3]) - len(b[3]))) for a in rows for b in rows if a[0] < b[0]}
    assert got == want
    for threshold in (0.0, 0.5, 0.85):
        tally_of = {r.verdict: r.n for r in tally.histogram(pairs.verdict_pairs(chunks, threshold), "verdict").collect()}
        assert {r.verdict: r.n for r in pairs.verdict_histogram(chunks, threshold).collect()} == tally_of


KIND = "id long, tokens array<string>, modules array<string>, dirs array<string>"


def odd_chunks(spark):
    """Chunks with every feature missing somewhere, deep directories, and directories below each other."""
    deep = [None, [], ["h"], ["h", "a"], ["h", "a", "b"], list("habcde"), list("habcdf"), list("habcdefg"), list("habxde"), list("zabcde")]
    rows = [(i, ["a", "b", "c", "d", "e"][: i % 6] or None, None if i % 5 == 0 else [f"m{i % 3}", "n"], deep[i % 10]) for i in range(70)]
    return rows, spark.createDataFrame(rows, KIND)


def signals_by_hand(a, b):
    share = lambda x, y: None if x is None or y is None else len({*x} & {*y}) / len({*x} | {*y})
    same = next((i for i, (x, y) in enumerate(zip(a[3] or [], b[3] or [], strict=False)) if x != y), min(len(a[3] or []), len(b[3] or [])))
    return share(a[1], b[1]), share(a[2], b[2]), None if a[3] is None or b[3] is None else len(a[3]) + len(b[3]) - 2 * same


@pytest.mark.parametrize("limit", [0, 500_000])
def test_pairs_of_odd_chunks_looked_up_or_measured_in_place(spark, monkeypatch, limit):
    monkeypatch.setattr(pairs, "BROADCAST_PAIRS", limit)
    rows, chunks = odd_chunks(spark)
    got = {(r.id_a, r.id_b): (r[T.STRUCTURAL], r[T.IMPORTS], r[T.DISTANCE]) for r in pairs.all_pairs(chunks).collect()}
    assert got == {(a[0], b[0]): signals_by_hand(a, b) for a in rows for b in rows if a[0] < b[0]}


@pytest.mark.parametrize("name", ["lean_columns", "module_distance", "pair_signals", "verdict_low_threshold", "verdict_pairs", "report_text", "domain_column", "import_overlap", "reasons_exploded"])
def test_pairs_go_through_no_shuffle(spark, sf, monkeypatch, name):
    import re

    from kinsift.plans.queries import QUERIES

    monkeypatch.setattr(pairs, "BROADCAST_PAIRS", 0)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    joined = min(m.start() for m in re.finditer(r"cell_a#\d+L?\], \[cell_b", plan))
    assert "Exchange" not in plan[:joined] and plan.count("SortMergeJoin") == 1


def test_written_pairs_take_little_room(spark, tmp_path):
    """A row b meets rows a in an order in which values repeat: a byte for each pair is more than all columns take."""
    words = list("abcdefghij")
    rows = [(i * 7919 % 2003, [w for k, w in enumerate(words) if (i * 31 % 97 + 1) >> (k % 7) & 1 or k == i % 3], [f"m{i * 13 % 60}", f"n{i % 7}"], [f"h{i % 40}", "d"]) for i in range(2000)]
    chunks = spark.createDataFrame(rows, KIND)
    pairs.all_pairs(chunks).write.parquet(f"{tmp_path}/pairs")
    written = spark.read.parquet(f"{tmp_path}/pairs")
    n = len(rows) * (len(rows) - 1) // 2
    assert written.count() == written.select("id_a", "id_b").distinct().count() == n and written.filter("id_a >= id_b").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < n


def test_rows_are_dealt_out_once_for_each_block(spark):
    """Twice for each before; ids that repeat or are NULL make no pairs of their own."""
    chunks = spark.createDataFrame([(i // 2 if i % 11 else None,) for i in range(700)], "id long")
    got = sorted((r.id_a, r.id_b) for r in pairs.paired(chunks).collect())
    ids = [i // 2 for i in range(700) if i % 11]
    assert got == sorted((a, b) for a in ids for b in ids if a < b)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.85])
@pytest.mark.parametrize("repeated", [False, True])
def test_tallies_of_odd_chunks(spark, threshold, repeated):
    rows, _ = odd_chunks(spark)
    rows += [(None, ["a"], ["n"], ["h"])] + [(3, ["a", "b"], ["n"], ["h"])] * repeated
    chunks = spark.createDataFrame(rows, KIND)
    told = classify(pairs.all_pairs(chunks), threshold)
    n = sum(a[0] < b[0] for a in rows for b in rows if None not in (a[0], b[0]))
    assert told.count() == n
    want = {(r.u, r.import_lean, r.domain, r.verdict): r["count"] for r in told.groupBy(F.col(T.IMPORTS).isNull().alias("u"), "import_lean", "domain", "verdict").count().collect()}
    assert {(r.unmeasured, r.import_lean, r.domain, r.verdict): r.n for r in pairs.tally(chunks, threshold).collect()} == want
    by_verdict = {r.verdict: r["count"] for r in told.groupBy("verdict").count().collect()}
    assert {r.verdict: r.n for r in pairs.verdict_histogram(chunks, threshold).collect()} == by_verdict
    shown = lambda s: F.round(s, 2).cast("string")
    want = {r.x: r["count"] for r in told.groupBy(shown(F.col(T.STRUCTURAL)).alias("x")).count().collect()}
    assert {r.shown: r.n for r in pairs.similarity_tally(chunks, shown).collect()} == want and None in want


def test_unmeasured_similarity_is_shown_as_null(spark, tmp_path):
    from kinsift.plans.queries import similarity_display

    rows = [(i, "http://a/b/c", html) for i, html in enumerate(["x y", "x 1", None, "// no token", "x z"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.shown: r.n for r in similarity_display(spark, str(tmp_path)).collect()} == {"1.00": 1, "0.50": 2, None: 7}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_report_texts_are_made_where_similarities_are_looked_up(spark, sf, monkeypatch, limit):
    from kinsift.plans.queries import QUERIES

    monkeypatch.setattr(pairs, "BROADCAST_PAIRS", limit)
    told = QUERIES["report_text"](spark, sf)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert ("format_string" in plan) == (limit == 0)
    assert told.filter("report is null").count() == 0


def test_reasons_make_no_structs_for_each_pair(spark, sf):
    from kinsift.plans.queries import QUERIES

    told = QUERIES["reasons_exploded"](spark, sf)
    assert "posexplode" not in told._jdf.queryExecution().executedPlan().toString()
    assert dict(told.dtypes) == {"id_a": "bigint", "id_b": "bigint", "pos": "bigint", "signal": "string", "value": "double", "lean": "string"}
