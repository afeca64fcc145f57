"""Operator 3. Line dedup by a deletion-neighbourhood join. DataFrame functions only.

A line is dropped if an equal line, or one within one edit of it, stands earlier in the corpus, in the order of document
id and line number; the earliest stays. Lines are compared without the blanks around them. One edit inserts, deletes or
replaces one character. What is earlier need not itself be kept: each of a chain of lines an edit apart gives way to the one
before.

1. Occurrences are reduced to distinct lines, by hashes of 96 bits, each with its earliest place and its text there. They are
   written as a table in buckets of these hashes, so that later joins by line move keys, not texts.
2. Lines within one edit of each other agree on the first or on the last half of their characters (of length // 2 or
   (length - 1) // 2). Distinct lines are grouped by hashes of these halves; a line that shares none of them with another
   can't have a neighbour. That loses none, and leaves few lines.
3. The same again, finer, for those: of up to 16 segments (more in very long lines), two lines within one edit agree outside one. Those that share all but a
   segment with another emit the deletion neighbourhood of that segment: itself and every variant with one character left
   out, as keys hashed with what is outside. Lines of an equal variant that left out the same place differ in one replaced
   character; a line that equals another's variant lacks one character of it. Each line meets only the earliest line of
   each such group, not all of its pairs.
4. The texts of the pairs so found are compared: outside the segment they must be equal, inside it edit distance decides.
5. A line that stays is one distinct line at its earliest place, so documents are put together from the table of distinct
   lines; the documents' own texts are never moved.

No step depends on the size of the input: every join is by hash, none broadcasts.

With `edits` above one, two lines are near if they are within that many edits. Of `edits` + 1 segments of the shorter line one
stands unchanged in the longer, at most `edits` characters off; lines are joined by these, and all pairs so found compared.
That loses none, but a segment that many lines share costs the square of their number.

Defined results: a null text has no lines and stays null; blank lines are kept and never compared. A document whose
lines are all kept keeps its text as it was. Rows that repeat an id are one document each, told apart by a hash of
their text; of rows that are equal in both, one is the earliest and the others lose all their lines. A null id sorts first.
An empty table gives an empty table. Columns of any other name are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import free_shuffles
from .common import cut, discard, shared_folder

BLANKS = " \t\r"
#: Parts of a line at most, outside one of which two lines within an edit agree, and characters for each; the mark of a variant
#: of the longer of two lines.
SEGMENTS, SEGMENT_CHARS, LONGER = 16, 8, -1


def trimmed(line: Column) -> Column:
    """Without blanks at its ends; lines that have none there, nearly all, aren't copied."""
    some = F.lit(False)
    for c in BLANKS:
        some = some | line.startswith(c) | line.endswith(c)
    return F.when(some, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, raw): every line of every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    return rows.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "raw"))


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and last halves, of either rounding."""
    keys = []
    for size in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys += [F.xxhash64(F.lit("first"), size, F.left(line, size)), F.xxhash64(F.lit("last"), size, F.right(line, size))]
    return F.array_distinct(F.array(*keys))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(a, b, doc_id, text_hash, pos, raw): each distinct line, by two hashes, with its earliest place and its text there."""
    rows = raw_lines(docs).withColumn("line", trimmed(F.col("raw"))).filter("line != ''")
    rows = rows.select(F.xxhash64("line").alias("a"), F.hash("line").alias("b"), F.struct("doc_id", "text_hash", "pos", "raw").alias("first"))
    return bucketed(rows.groupBy("a", "b").agg(F.min("first").alias("first")).select("a", "b", "first.*"))


def bucketed(df: DataFrame) -> DataFrame:
    """The frame, grouped by (a, b), as a table in as many buckets as the shuffle that grouped it had partitions: a task writes
    whole buckets, and joins on (a, b) read them where they are."""
    spark = df.sparkSession
    name, path = f"distinct_lines_{uuid.uuid4().hex}", f"{shared_folder(spark)}/distinct-lines-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "a", "b").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    discard(spark, path, at_exit=True)
    free_shuffles(spark)  # those of whole texts
    return spark.table(name)


def segment_codes(own: Column) -> Column:
    """A code for each piece of a line of `own` characters: twice the segment's number, and one more for the line's part as the
    longer of two. There is a segment for SEGMENT_CHARS characters, one at least and SEGMENTS at most; but in very long lines
    the cube root of their length, which keeps the hashing of pieces and that of variants in balance."""
    of = lambda n, turn: F.transform(F.sequence(F.lit(0), segment_count(n) - 1), lambda j: 2 * j + turn)
    return F.concat(of(own, 0), of(own - 1, 1))


def segment_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(SEGMENTS), F.floor(n / SEGMENT_CHARS).cast("int")), F.floor(F.cbrt(n)).cast("int"))


def pieces_of(lines: DataFrame) -> DataFrame:
    """Adds longer, middle and segment to lines with a `code`: a line's part inside the segment, and a hash of all the rest of
    it. Segments are those of n characters, n being the line's own length or, for its part as the longer of two lines, one
    less. Lines within an edit share the hash of what is outside the edit's segment."""
    own = F.char_length("line")
    each = lines.withColumns({"longer": F.col("code") % 2 == 1, "j": F.expr("cast(code div 2 as long)")}).withColumn("n", F.when(F.col("longer"), own - 1).otherwise(own))
    each = each.withColumn("count", segment_count(F.col("n")))
    each = each.withColumns({"from": F.expr("cast(j * n div count as int)"), "rest": F.expr("cast(n - (j + 1) * n div count as int)")})
    middle = F.substr("line", F.col("from") + 1, own - F.col("from") - F.col("rest"))
    return each.withColumns({"middle": middle, "segment": F.xxhash64("n", "j", F.left("line", "from"), F.right("line", "rest"))})


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(key, earlier): distinct lines, as hashes, with an earlier line within one edit."""
    spark, line = distinct.sparkSession, trimmed(F.col("raw"))
    halves = distinct.select("a", "b", line.alias("line")).select("a", "b", F.explode(half_keys(F.col("line"), F.char_length("line"))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least != most").select("half")
    some = halves.join(shared, "half", "left_semi").select("a", "b").distinct()
    lines = cut(distinct.join(some, ["a", "b"], "left_semi").select("a", F.struct("a", "b").alias("key"), F.struct("doc_id", "text_hash", "pos").alias("place"), line.alias("line")))
    free_shuffles(spark)

    # Hashes alone tell which pieces meet another line's; the texts follow those.
    slim = pieces_of(lines.select("a", "line", F.explode(segment_codes(F.char_length("line"))).alias("code"))).select("a", "code", "segment")
    met = slim.groupBy("segment").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least != most").select("segment")
    alive = slim.join(met, "segment", "left_semi").groupBy("a").agg(F.collect_set("code").alias("codes"))
    pieces = pieces_of(lines.join(alive, "a").select("key", "place", "line", F.explode("codes").alias("code")))
    n = F.char_length("middle")
    variant = lambda i: F.struct(F.when(F.col("longer"), F.lit(LONGER)).otherwise(i).alias("left_out"), F.xxhash64("segment", F.concat(F.left("middle", i - 1), F.substr("middle", i + 1, n))).alias("variant"))
    itself = F.when(~F.col("longer"), F.array(F.struct(F.lit(0).alias("left_out"), F.xxhash64("segment", "middle").alias("variant")))).otherwise(F.array().cast("array<struct<left_out: int, variant: bigint>>"))
    without = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), variant)).otherwise(F.array().cast("array<struct<left_out: int, variant: bigint>>"))
    of = ["n", "from", "rest"]  # the segment that a variant is of, for the comparison of texts
    emitted = cut(pieces.select("key", "place", *of, F.explode(F.concat(itself, without)).alias("v")).select("key", "place", *of, "v.*").distinct())
    free_shuffles(spark)
    member = F.struct("place", "key")
    # A replaced character: the same place left out.
    replaced = emitted.filter("left_out > 0").groupBy("variant", "left_out").agg(F.min(member).alias("one"), F.max(member).alias("other")).filter("one != other")
    by_replacing = emitted.join(replaced.select("variant", "left_out", "one"), ["variant", "left_out"]).select("key", "place", "one", *of)
    # A missing character: one line is the variant itself. The earliest of the longer ones, and the line itself, speak for all.
    whole = emitted.filter("left_out = 0").groupBy("variant", *of).agg(F.min(member).alias("whole"))
    longer = emitted.filter(F.col("left_out") == LONGER).groupBy("variant").agg(F.min(member).alias("longer"))
    both = whole.join(longer, "variant")
    shorter_goes = both.select(F.col("whole.key").alias("key"), F.col("whole.place").alias("place"), F.col("longer").alias("one"), *of)
    longer_go = emitted.filter(F.col("left_out") == LONGER).join(both.select("variant", F.col("whole").alias("one")), "variant").select("key", "place", "one", *of)
    found = by_replacing.unionByName(shorter_goes).unionByName(longer_go).filter("one.place < place").select("key", F.col("one.key").alias("earlier"), "from", "rest").distinct()
    text = lambda as_: lines.select(F.col("key").alias(as_), F.col("line").alias(f"{as_}_line"))
    inside = lambda c: F.substr(c, F.col("from") + 1, F.char_length(c) - F.col("from") - F.col("rest"))
    outside = (F.left("key_line", "from") == F.left("earlier_line", "from")) & (F.right("key_line", "rest") == F.right("earlier_line", "rest"))
    within = F.levenshtein(inside("key_line"), inside("earlier_line"), 1) >= 0
    verified = found.join(text("key"), "key").join(text("earlier"), "earlier").filter(outside & within & (F.col("key_line") != F.col("earlier_line")))
    verified = cut(verified.select("key", "earlier").distinct())
    free_shuffles(spark)
    return verified


def pairs_within(distinct: DataFrame, edits: int) -> DataFrame:
    """(key, earlier): distinct lines, as hashes, with each earlier line within `edits` edits."""
    lines = cut(distinct.select(F.struct("a", "b").alias("key"), F.struct("doc_id", "text_hash", "pos").alias("place"), trimmed(F.col("raw")).alias("line")))
    own = F.char_length("line")

    def parts(off: Column, shifts: range) -> DataFrame:
        each = lines.select("key", "place", "line", F.explode(off).alias("off")).withColumn("n", own - F.col("off"))
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("j")).select("*", F.explode(F.array(*[F.lit(x) for x in shifts])).alias("shift"))
        each = each.withColumns({"from": F.expr(f"cast(j * n div {edits + 1} as int)"), "to": F.expr(f"cast((j + 1) * n div {edits + 1} as int)")})
        each = each.filter((F.col("from") + F.col("shift") >= 0) & (F.col("to") + F.col("shift") <= own) & (F.col("n") > 0))
        return each.select("key", "place", "line", F.xxhash64("n", "j", F.substr("line", F.col("from") + F.col("shift") + 1, F.col("to") - F.col("from"))).alias("part"))

    shorter = parts(F.array(F.lit(0)), range(1)).select("part", F.struct("place", "key", "line").alias("one"))
    longer = parts(F.sequence(F.lit(0), F.lit(edits)), range(-edits, edits + 1)).select("part", F.struct("place", "key", "line").alias("other"))
    met = shorter.join(longer, "part").filter("one.key != other.key").filter(F.levenshtein("one.line", "other.line", edits) >= 0)
    one_first = F.col("one.place") < F.col("other.place")
    return met.select(F.when(one_first, F.col("other.key")).otherwise(F.col("one.key")).alias("key"), F.when(one_first, F.col("one.key")).otherwise(F.col("other.key")).alias("earlier")).distinct()


def kept_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """(doc_id, text_hash, pos, raw, counts): the lines that stay; blank lines are among them and don't count."""
    distinct = distinct_lines(docs)
    near = near_pairs(distinct) if edits == 1 else pairs_within(distinct, edits)
    stay = distinct.join(near.select("key.a", "key.b").distinct(), ["a", "b"], "left_anti") if edits else distinct
    blank = raw_lines(docs).filter(trimmed(F.col("raw")) == "")
    return stay.select("doc_id", "text_hash", "pos", "raw", F.lit(1).alias("counts")).unionByName(blank.select("*", F.lit(0).alias("counts")))


def judged(docs: DataFrame, edits: int = 1) -> DataFrame:
    """(row, text, n_lines, n_kept): the rows of `docs` as structs, with what is left of their texts; blank lines count in neither
    number."""
    # Equality that holds for null ids too, in columns that a join need not rewrite, so both sides are dealt out once.
    key = ["no_id", "id", "hash"]
    keyed = lambda hash_: [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), hash_.alias("hash")]
    whole = kept_lines(docs, edits).select(*keyed(F.col("text_hash")), "pos", "raw", "counts").repartition(*key)
    whole = whole.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("pos", "raw"))).alias("left"), F.sum("counts").alias("n_kept")).select(*key, F.array_join("left.raw", "\n").alias("left"), "n_kept")
    lines = F.split("text", "\n", -1)
    n = F.coalesce(F.size(F.filter(lines, lambda x: trimmed(x) != "")), F.lit(0))
    blank = F.array_join(F.filter(lines, lambda x: trimmed(x) == ""), "\n")
    bare = [F.lit(None).cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*bare).alias("row"), *keyed(F.xxhash64("text")), F.col("text").isNull().alias("none"), n.cast("long").alias("n_lines"), blank.alias("blank"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    joined = rows.join(whole, key, "left")
    text = F.when(F.col("none"), F.lit(None)).when(F.col("copy") > 1, F.col("blank")).otherwise(F.coalesce("left", F.lit("")))
    return joined.select("row", text.alias("text"), "n_lines", F.when(F.col("copy") > 1, F.lit(0)).otherwise(F.coalesce("n_kept", F.lit(0))).cast("long").alias("n_kept"))


def deduplicated(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The rows of `docs` with what is left of their texts, and n_lines and n_kept in place of columns of these names."""
    docs = docs.drop("n_lines", "n_kept")
    return judged(docs, edits).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "n_lines", "n_kept")


def without_repeats(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The rows of `docs` with the columns they had; n_chars is that of what is left. Documents that had lines and kept none go."""
    rest = judged(docs, edits).filter("n_kept > 0 or n_lines = 0")
    of = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rest.select(*[of[c] if c in of else F.col("row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
d AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM t WHERE line <> '' GROUP BY line),
h AS (SELECT *, 'a' || left(line, k) AS half, k FROM d, LATERAL (SELECT unnest([n // 2, (n - 1) // 2]) AS k)
  UNION ALL SELECT *, 'z' || right(line, k) AS half, k FROM d, LATERAL (SELECT unnest([n // 2, (n - 1) // 2]) AS k)),
near AS (SELECT DISTINCT x.line FROM h x JOIN h y ON x.half = y.half AND y.first < x.first AND abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 4 -- of bytes, of which a character has four at most
  WHERE CASE x.n - y.n WHEN 0 THEN len(list_filter(range(1, x.n + 1), lambda i: x.line[i] <> y.line[i])) = 1
    WHEN 1 THEN list_contains(list_transform(range(1, x.n + 1), lambda i: left(x.line, i - 1) || substr(x.line, i + 1)), y.line)
    ELSE list_contains(list_transform(range(1, y.n + 1), lambda i: left(y.line, i - 1) || substr(y.line, i + 1)), x.line) END),
kept AS (SELECT t.doc_id, t.pos, t.raw, t.line FROM t LEFT JOIN d ON t.line = d.line
  WHERE t.line = '' OR ((t.doc_id, t.pos) = d.first AND t.line NOT IN (SELECT line FROM near)))
SELECT o.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(b.n_kept, 0) AS n_kept,
  CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(b.text, '') END AS text
FROM documents o
LEFT JOIN (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines FROM t GROUP BY doc_id) a ON o.doc_id = a.doc_id
LEFT JOIN (SELECT doc_id, count(*) FILTER (line <> '') AS n_kept, string_agg(raw, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id) b ON o.doc_id = b.doc_id
"""
