"""Line dedup with content-defined chunks, in DataFrame functions only.

Lines are the text's lines, and sentences inside a longer line; put together they are the text again. A line's content is
the line without the one line end or blank that closes it; lines without a word are passed over. Chunks are stretches of
neighbouring lines that depend on their own contents alone, wherever they stand:

- a boundary falls inside each pair of lines whose rolling hash is less than both its neighbours', so that chunks have two
  lines or more, three on average;
- from every line on, and up to every line, the fewest lines that make ``MIN_WORDS`` words. Whatever passage of so many
  words two documents share as whole lines, these chunks cover it from its first line to its last.

Every chunk is looked up in the whole corpus; its first occurrence is that of the smallest doc_id, then place. Lines of a
later occurrence are removed. So what goes is a chunk that one earlier place holds as it stands, and never lines that only
meet piecemeal elsewhere. The first occurrence of a line always stays. Occurrences meet by hash in an aggregate of counts
and least document; before anything is removed, all contents under one hash are compared whole, byte by byte: the lines
under each line hash, and the line hashes under each chunk hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import discard, materialize, table

#: Chunks between boundaries have so many lines at least.
MIN_LINES = 2
#: The other chunks have so many words; so many characters count as much, for scripts without spaces.
MIN_WORDS, MIN_CHARS = 50, 400
#: Lines with what closes them.
LINES = r"(?<=[\n ])(?<=\n|[.!?] )"
#: A character that no text should hold; it marks where lines end, since a plain split is three times as fast as a look behind.
_MARK = "\uffff"


def contents(text: str) -> str:
    """SQL: the contents of a text's lines, none for an empty text: a blank that closes a sentence becomes a line end first."""
    plain = f"split(replace(replace(replace({text}, '. ', '.\\n'), '! ', '!\\n'), '? ', '?\\n'), '\\n')"
    return f"transform(array({plain}), c -> IF(element_at(c, -1) = '', slice(c, 1, size(c) - 1), c))[0]"


def lines(text: str) -> str:
    """SQL: the lines of a text, which put together are the text."""
    marked = f"replace(replace(replace(replace({text}, '\\n', '\\n{_MARK}'), '. ', '. {_MARK}'), '! ', '! {_MARK}'), '? ', '? {_MARK}')"
    look = LINES.replace("\\", "\\\\")
    return f"filter(IF(contains({text}, '{_MARK}'), split({text}, '{look}'), split({marked}, '{_MARK}')), u -> u <> '')"


#: SQL: whether a line has a word.
_WORDED = "trim(' \\t\\r' FROM u) <> ''"


def _weight(u: str) -> str:
    """SQL: a line's characters, or ``MIN_CHARS / MIN_WORDS`` for each of its words if that is more. What is cheap to tell comes first."""
    plain = f"length({u}) - length(replace({u}, ' ', '')) + 1 - int(startswith({u}, ' ')) - int(endswith({u}, ' '))"
    words = f"IF(contains({u}, '  ') OR contains({u}, '\\t'), size(filter(split(replace({u}, '\\t', ' '), ' '), v -> v <> '')), {plain})"
    return f"greatest({MIN_CHARS // MIN_WORDS} * {words}, length({u}))"


#: Lengths of the stretches whose weights are kept; a chunk of MIN_WORDS words has so many lines at most.
_LEVELS = [1 << j for j in range(MIN_WORDS.bit_length())]


def _sum(n: int, back: bool = False) -> str:
    """SQL: the weight of the ``n`` lines from place i on, or up to it; lines outside the text weigh nothing."""
    parts, at = [], 0
    for size in reversed(_LEVELS):
        if n & size:
            place = f"i - {at + size - 1}" if back else f"i + {at}"
            # a stretch that opens before the text has no place in the table: its chunk would not be whole either
            parts.append(f"coalesce(get(w{size}, {place}), 0)")
            at += size
    return " + ".join(parts)


def _fewest(back: bool) -> str:
    """SQL: how many lines from place i on, or up to it, weigh ``MIN_CHARS``; null if all of them do not."""
    whole = f"WHEN {_sum(MIN_WORDS)} < {MIN_CHARS} THEN NULL" if not back else ""
    cases = " ".join(f"WHEN {f'i < {n - 1} THEN NULL WHEN ' if back else ''}{_sum(n, back)} >= {MIN_CHARS} THEN {n}" for n in range(1, MIN_WORDS + 1))
    return f"CASE {whole} {cases} END"


def _with_lines(df: DataFrame, text: str) -> DataFrame:
    """Add ``c``, the contents of the lines with a word, and ``h``, their hashes."""
    return df.withColumn("c", F.expr(f"filter({contents(text)}, u -> {_WORDED})")).withColumn("h", F.expr("transform(c, u -> xxhash64(u))"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of ``docs``, as ``d_...``, with ``k``: a number per document in the order of doc_id, then text hash; and (k, text) once per document.

    Where no doc_id is null or repeated, it is the number; else documents are numbered by a sort of ids and hashes.
    """
    whole = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns], F.col("doc_id").cast("long").alias("k"))
    once = lambda w: w.select("k", F.col("d_text").alias("text"))
    if whole.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").isEmpty():
        return whole, once(whole)
    whole = whole.withColumnRenamed("k", "k_id").withColumn("k_text", F.xxhash64("d_text"))
    ids = whole.groupBy("k_id", "k_text").agg(F.count("*").alias("n")).orderBy("k_id", "k_text").select(F.col("k_id").alias("n_id"), F.col("k_text").alias("n_text"), F.monotonically_increasing_id().alias("k"))
    ids = materialize(ids, "numbers")
    whole = materialize(whole.join(ids, F.col("k_id").eqNullSafe(F.col("n_id")) & (F.col("k_text") == F.col("n_text"))).drop("k_id", "k_text", "n_id", "n_text"), "numbered")
    return whole, once(whole).dropDuplicates(["k"])


def _spots(keyed: DataFrame) -> DataFrame:
    """(k, hash, at, n) of all chunks: their first line, among those with a word, and number of lines; a chunk comes once."""
    df = _with_lines(keyed, "text").withColumn("w1", F.expr(f"transform(c, u -> {_weight('u')})"))
    for size in _LEVELS[1:]:
        df = df.withColumn(f"w{size}", F.expr(f"transform(w{size // 2}, (x, i) -> x + coalesce(get(w{size // 2}, i + {size // 2}), 0))"))
    df = (
        df.withColumn("on", F.expr(f"transform(w1, (x, i) -> {_fewest(False)})"))
        .withColumn("upto", F.expr(f"transform(w1, (x, i) -> {_fewest(True)})"))
        .withColumn("r", F.expr("transform(slice(h, 2, greatest(size(h) - 1, 0)), (x, i) -> xxhash64(h[i], x))"))
        .withColumn("cuts", F.expr("filter(sequence(0, size(h)), i -> i = 0 OR i = size(h) OR (i >= 2 AND i <= size(h) - 2 AND r[i - 1] < r[i - 2] AND r[i - 1] < r[i]))"))
    )
    span = "struct(cast({at} AS int) AS at, cast({n} AS int) AS n)"
    forward = f"transform(on, (x, i) -> {span.format(at='i', n='x')})"
    # those that are also the fewest lines from their first on are there already
    backward = f"transform(upto, (x, i) -> {span.format(at='i - x + 1', n='IF(on[i - x + 1] = x, NULL, x)')})"
    cut = f"transform(cuts, (x, i) -> {span.format(at='x', n=f'IF(coalesce(get(cuts, i + 1), x) - x >= {MIN_LINES}, get(cuts, i + 1) - x, NULL)')})"
    # a chunk between boundaries that has the words is covered by the others
    short = f"filter({cut}, x -> x.n IS NOT NULL AND (x.n <= {MIN_WORDS} AND coalesce(on[x.at], {MIN_WORDS + 1}) > x.n))"
    spans = f"concat(filter(concat({forward}, {backward}), x -> x.n IS NOT NULL), {short})"
    # the outer form: for the plain one, the optimiser would add a filter on the array's size and with it compute the array twice
    rows = df.select("k", F.explode_outer(F.expr(f"transform({spans}, x -> struct(xxhash64(slice(h, x.at + 1, x.n)) AS hash, x.at AS at, x.n AS n))")).alias("x"))
    return rows.where("x IS NOT NULL").select("k", "x.*")


def _heads(spots: DataFrame) -> DataFrame:
    """(hash, first): the hashes that occur more than once and their first document, counted before they are dealt out."""
    return spots.groupBy("hash").agg(F.count("*").alias("times"), F.min("k").alias("first")).where("times > 1").drop("times")


def _repeated(spots: DataFrame, heads: DataFrame) -> DataFrame:
    """(k, found): each document's chunks with a head, as structs of hash, place, number of lines and whether it is a later one.

    Both sides are tables, so Spark can split the partition of a very common chunk (its skew join) as far as it takes.
    """
    lists = spots.join(heads, "hash").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("hash", "at", "n", (F.col("k") > F.col("first")).alias("later")))).alias("found"))
    # within the first document all but the first place are later ones
    return lists.select("k", F.expr("transform(found, (x, i) -> struct(x.hash AS hash, x.at AS at, x.n AS n, x.later OR (i > 0 AND found[greatest(i - 1, 0)].hash = x.hash) AS later))").alias("found"))


def _marked(cut: DataFrame) -> DataFrame:
    """``cut`` (text, removable) with ``lines`` and ``gone``: structs of first line and number of lines, in order and apart."""
    return (
        cut.withColumn("lines", F.expr(lines("text")))
        .withColumn("b", F.expr(f"filter(transform({contents('text')}, (u, i) -> IF({_WORDED}, i, -1)), i -> i >= 0)"))
        .withColumn("p", F.expr("array_sort(array_distinct(flatten(transform(removable, x -> sequence(x.at, x.at + x.n - 1)))))"))
        .withColumn("gone", F.expr("zip_with(filter(p, (x, i) -> i = 0 OR p[i - 1] < x - 1), filter(p, (x, i) -> i = size(p) - 1 OR p[i + 1] > x + 1), (x, y) -> struct(b[x] AS at, b[y] - b[x] + 1 AS n))"))
        .drop("b", "p")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, plus ``n_lines`` and ``n_removed``.

    ``docs`` needs doc_id and text; all its columns return, ``n_chars`` (if there) following the new text. A null text
    stays null and has no lines; an empty table gives no rows. Rows equal in doc_id and text are one document and keep the
    same lines; rows that only share a doc_id follow each other by the hash of their texts; null ids come first. A document
    may become empty. Columns may have any names; only those two are
    replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole, once = _numbered(docs.select(*names))
    spots = materialize(_spots(once), "spots")
    heads = materialize(_heads(spots), "heads")
    lists = materialize(_repeated(spots, heads), "repeated")
    discard(spots, heads)
    joined = materialize(whole.join(lists, "k", "left"), "found")
    discard(lists)

    # each line that lies in a chunk meets its like once, not once a chunk; the contents are cut out before they are dealt out, so that no row carries a whole document
    seen = _with_lines(joined.where("found IS NOT NULL").select("found", "d_text"), "d_text")
    seen = seen.withColumn("p", F.expr("array_distinct(flatten(transform(found, x -> sequence(x.at, x.at + x.n - 1))))"))
    parts = "concat(transform(p, i -> struct(h[i] AS hash, 0 AS lines, c[i] AS bytes)), transform(found, x -> struct(x.hash AS hash, x.n AS lines, array_join(transform(slice(h, x.at + 1, x.n), y -> hex(y)), ' ') AS bytes)))"
    texts = seen.select(F.explode_outer(F.expr(parts)).alias("t")).select("t.hash", (F.col("t.lines") > 0).alias("chunk"), "t.bytes")
    unequal = materialize(texts.groupBy("hash", "chunk").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("hash"), "unequal")
    removable = F.filter("found", lambda x: x["later"])
    if not unequal.isEmpty():  # different texts under one hash stay, and so does a chunk with a line of such a hash
        hashes = _with_lines(joined.where("found IS NOT NULL").select("k", "found", "d_text"), "d_text").select("k", "h", F.explode_outer("found").alias("x"))
        spread = hashes.select("k", "x.hash", F.explode_outer(F.expr("concat(array(x.hash), slice(h, x.at + 1, x.n))")).alias("part"))
        bad = spread.join(unequal.withColumnRenamed("hash", "part").distinct(), "part").groupBy("k").agg(F.collect_set("hash").alias("bad"))
        joined = joined.join(bad, "k", "left")
        removable = F.filter("found", lambda x: x["later"] & ~F.array_contains(F.coalesce("bad", F.array().cast("array<bigint>")), x["hash"]))
    # only documents with later occurrences are cut up in full
    cut = joined.withColumn("removable", removable).withColumn("text", F.when(F.size("removable") > 0, F.col("d_text")))
    out = _marked(cut)
    # the lines between removed runs
    kept = F.expr("flatten(transform(sequence(0, size(gone)), j -> slice(lines, IF(j = 0, 0, gone[j - 1].at + gone[j - 1].n) + 1, IF(j = size(gone), size(lines), gone[j].at) - IF(j = 0, 0, gone[j - 1].at + gone[j - 1].n))))")
    out = out.withColumn("left", F.when(F.size("gone") > 0, F.array_join(kept, "")).otherwise(F.col("d_text")))
    columns = [F.col("left").alias("text") if c == "text" else F.length("left").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"d_{c}").alias(c) for c in names]
    n_lines = F.size(F.expr(contents("coalesce(d_text, '')"))).cast("long").alias("n_lines")
    return out.select(*columns, n_lines, F.coalesce(F.expr("aggregate(gone, 0L, (a, c) -> a + c.n)"), F.lit(0).cast("long")).alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_lines")
