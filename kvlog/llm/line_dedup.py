"""Line dedup with a fixed-depth log-template tree; DataFrame functions only.

A line's words (by ASCII white space) that hold a digit are variable fields, ``<*>``.  The first level of the tree is the
number of words n, the second one a run of words at a fixed place.  Up to d = min(n / 4, MAX_VARIABLE) places of a line may
vary, and the line is cut into d + 1 runs, so one run at least stands unchanged in all lines of a template: the leading
words are one route into the tree, and where a variable field stands among them another run is.  Of the runs that recur in
MIN_DOCS lines the first and the last are a line's routes.  Below a route (a leaf) the lines are compared place by place:
the support of a word at a place is the number of lines of the leaf that have it there (supports under MIN_DOCS count as
none), and the d places of least support become ``<*>``.  What is left is the line's template.  Templates that occur in at
least MIN_DOCS documents are dropped.

A line of LONG_WORDS words or more is also dropped when the same line stands in LONG_DOCS unrelated documents: documents
are related when they share one of their SKETCH least other lines (by MD5), so that copies of one document keep theirs.

A document is a distinct (id, text): repeated rows count once, and are treated alike.  Counts are combined before each
shuffle, equal lines are worked on once, and only documents that lose lines are shuffled with their texts.  Defined cases:
null texts stay null with no lines; blank lines and lines of fewer than MIN_WORDS words stay; an empty table stays empty;
other columns stay, whatever their names, but columns n_lines and n_dropped of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm import exact_dedup as exact
from kvlog.llm.common import cut, forget, let, packed, stored, table

MIN_WORDS = 3
MIN_DOCS = 10
#: Places that may vary: a quarter of the words, and at most so many.
MAX_VARIABLE = 8
LONG_WORDS, LONG_DOCS, SKETCH = 50, 3, 3
#: Tables of keys are broadcast up to so many rows (of under 100 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 1 << 18
_BLANK = r"\x20\x09-\x0D"


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _variable(n: Column) -> Column:
    return F.least(F.floor(n / 4).cast("int"), F.lit(MAX_VARIABLE))


def _run(words: Column, n: Column, j: Column) -> Column:
    """Hash of a line's run j, with the path to it; null past the last run.  Cut out of the text: arrays of words would cost more."""
    runs = _variable(n) + 1
    begin, end = F.floor(j * n / runs).cast("int"), F.floor((j + 1) * n / runs).cast("int")
    part = F.call_function("substring_index", F.call_function("substring_index", words, F.lit(" "), end), F.lit(" "), begin - end)
    return F.when(j < runs, F.xxhash64(n, j, part))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is evaluated once, wherever it is used: projections would be merged and repeat it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(keyed: DataFrame, text: Column) -> DataFrame:
    """(sha, line, n, words, runs) of every line of at least MIN_WORDS words; words are joined by one space, those with digits
    are ``<*>``.  Regular expressions run only on lines that need them."""
    lines = keyed.select("sha", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    lines = _once(lines, F.btrim("raw", F.lit(" \t\n\x0b\f\r")), "own")
    odd = F.contains("own", F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains("own", F.lit(c))
    lines = _once(lines, F.when(odd, F.regexp_replace("own", rf"[{_BLANK}]+", " ")).otherwise(F.col("own")), "plain")
    masked = F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.col("plain"))
    lines = _once(lines, masked, "words").select("sha", "line", "words")
    counted = _once(lines, F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1, "n").where(F.col("n") >= MIN_WORDS)
    return counted.withColumn("runs", F.array(*[_run(F.col("words"), F.col("n"), F.lit(j)) for j in range(MAX_VARIABLE + 1)]))


def _candidates(lines: DataFrame) -> DataFrame:
    """(sha, line, n, words, lo, hi) of the lines with a recurring run; lo and hi are the first and the last such run."""
    often = cut(lines.select(F.explode("runs").alias("run")).where(F.col("run").isNotNull()).groupBy("run").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= MIN_DOCS).select("run"))
    each = lines.select("sha", "line", "n", "words", F.posexplode("runs").alias("j", "run")).where(F.col("run").isNotNull())
    n = often.count()
    if n <= BROADCAST_KEYS:
        hit = each.join(F.broadcast(often), "run", "left_semi")
    else:  # a bitmap of bounded size first, so that few other runs are shuffled
        masks, log_words = exact.masks_of(often, n, "run")
        hit = exact.marked(each, cut(masks), log_words, "run").where("_maybe").join(often, "run", "left_semi")
    return hit.groupBy("sha", "line", "n", "words").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))


def _recurring(found: DataFrame) -> DataFrame:
    """(a, b) hashes of the lines of recurring templates; found: (sha, line, n, lo, hi, words, a, b)."""
    distinct = cut(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("words").alias("words")))
    routes = distinct.select("a", "b", "c", "n", "words", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("j")).withColumn("leaf", _run(F.col("words"), F.col("n"), F.col("j")))
    places = routes.select("a", "b", "c", "n", "leaf", F.posexplode(F.split("words", " ")).alias("at", "word"))
    support = cut(places.groupBy("leaf", "at", "word").agg(F.sum("c").alias("s")).where(F.col("s") >= MIN_DOCS))
    ranked = places.join(_small(support), ["leaf", "at", "word"], "left").select("a", "b", "leaf", "n", F.struct((-F.coalesce("s", F.lit(0))).alias("s"), "at", "word").alias("p"))
    own = ranked.groupBy("a", "b", "leaf").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("p")).alias("p"))
    kept = F.array_sort(F.transform(F.slice("p", F.lit(1), F.col("n") - _variable(F.col("n"))), lambda x: F.struct(x["at"], x["word"])))
    templates = cut(own.select("a", "b", "leaf", F.xxhash64("n", kept).alias("rest")))
    # a line of MIN_DOCS documents makes its templates recur; the documents of all others are counted together
    per = cut(found.select("a", "b", "sha").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")))
    hot = templates.join(per.where(F.col("docs") >= MIN_DOCS), ["a", "b"], "left_semi").select("leaf", "rest").distinct()
    alone = per.where(F.col("docs") < MIN_DOCS)
    enough = templates.join(alone, ["a", "b"]).groupBy("leaf", "rest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("leaf", "rest")
    open_ = cut(templates.join(_small(cut(enough)), ["leaf", "rest"], "left_semi").join(alone.select("a", "b"), ["a", "b"], "left_semi"))
    each = found.select("a", "b", "sha").join(_small(open_), ["a", "b"]).select("leaf", "rest", "sha").distinct()
    counted = each.groupBy("leaf", "rest").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= MIN_DOCS).select("leaf", "rest")
    often = cut(hot.union(counted).distinct())
    return templates.join(_small(often), ["leaf", "rest"], "left_semi").select("a", "b").distinct()


def _passages(lines: DataFrame) -> DataFrame:
    """(sha, line) of long lines that stand in several unrelated documents, but in too few to be a recurring template."""
    whole = lines.where(F.col("n") >= LONG_WORDS).select("sha", "line", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))
    several = whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LONG_DOCS).select("a", "b")
    held = cut(whole.join(_small(cut(several)), ["a", "b"], "left_semi"))
    docs = held.select("a", "b", "sha").distinct()
    few = cut(docs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs").between(LONG_DOCS, MIN_DOCS - 1)).select("a", "b"))
    docs = cut(docs.join(_small(few), ["a", "b"], "left_semi"))
    holders = cut(docs.select("sha").distinct())
    # SKETCH + 1 least lines a document: the line in question may be one of them
    least = lines.join(_small(holders), "sha", "left_semi").select("sha", F.md5("words").alias("m"), F.xxhash64("words").alias("ma"), F.xxhash64(F.lit(1), "words").alias("mb")).distinct()
    least = least.groupBy("sha").agg(F.slice(F.array_sort(F.collect_list(F.struct("m", "ma", "mb"))), 1, SKETCH + 1).alias("least"))
    others = F.transform(F.slice(F.filter("least", lambda x: (x["ma"] != F.col("a")) | (x["mb"] != F.col("b"))), 1, SKETCH), lambda x: x["m"])
    sketched = docs.join(least, "sha").select("a", "b", "sha", others.alias("o")).withColumn("o", F.when(F.size("o") == 0, F.array(F.lit(""))).otherwise(F.col("o")))
    shared = sketched.select("a", "b", "sha", F.explode("o").alias("m"))
    common = shared.groupBy("a", "b", "m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    related = shared.join(common, ["a", "b", "m"], "left_semi").select("a", "b", "sha").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("related"))
    all_docs = docs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")).join(related, ["a", "b"], "left")
    groups = F.col("docs") - F.coalesce("related", F.lit(0)) + F.when(F.col("related") > 0, 1).otherwise(0)
    gone = cut(all_docs.where(groups >= LONG_DOCS).select("a", "b"))
    return held.join(_small(gone), ["a", "b"], "left_semi").select("sha", "line")


def _without(keyed: DataFrame, names: list[str], text: str, lost: DataFrame) -> DataFrame:
    """The rows (row, sha) without their lost lines (sha, gone)."""
    masks, log_words = exact.masks_of(lost.select("sha"), lost.count())
    tested = exact.marked(keyed, cut(masks), log_words)
    own = F.col("row").getField(text)
    split = F.split(own, "\n")
    n_lines = F.when(own.isNull(), F.lit(0)).otherwise(F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long")
    stay = [c for c in names if c not in ("n_lines", "n_dropped")]
    kept = [F.col("row").getField(c).alias(c) for c in stay]
    passed = tested.where(~F.col("_maybe")).select(*kept, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    # equal rows are many rows of one key: the lost lines go to each salt
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int")
    flagged = tested.where("_maybe").withColumn("salt", salt)
    dealt = lost.select("sha", "gone", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    joined = flagged.join(dealt, ["sha", "salt"], "left")
    rest = F.array_join(let(split, lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))), "\n")
    cleaned = F.when(F.col("gone").isNull(), own).otherwise(rest)
    changed = joined.select(*[cleaned.alias(c) if c == text else k for c, k in zip(stay, kept, strict=True)], n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return passed.unionByName(changed)


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the recurring lines, then n_lines and n_dropped."""
    own = F.col("row").getField(text)
    sha = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("row").getField(doc_id).cast("string"), F.lit("")), own), 256))
    keyed = packed(docs).withColumn("sha", sha)
    lines = stored(_lines(keyed.where(own.isNotNull()), own), "lines")
    found = stored(_candidates(lines).withColumns({"a": F.xxhash64("words"), "b": F.xxhash64(F.lit(1), "words")}), "found")
    recurring = cut(_recurring(found))
    gone = found.join(_small(recurring), ["a", "b"], "left_semi").select("sha", "line").unionByName(_passages(lines))
    lost = cut(gone.distinct().groupBy("sha").agg(F.collect_list("line").alias("gone")))
    forget(lines)
    forget(found)
    return _without(keyed, docs.columns, text, lost)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = rf"""
WITH raw AS (
  SELECT doc_id, text, unnest(range(len(s))) AS line, unnest(s) AS t
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
l AS (
  SELECT doc_id, line, w, len(w) AS n, least(len(w) // 4, {MAX_VARIABLE}) AS d
  FROM (SELECT doc_id, line, list_transform(list_filter(string_split_regex(t, '[{_BLANK}]+'), lambda x: x <> ''),
                                            lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM raw)
  WHERE len(w) >= {MIN_WORDS}),
runs AS (
  SELECT doc_id, line, n, d, w, j, w[j * n // (d + 1) + 1:(j + 1) * n // (d + 1)] AS run
  FROM (SELECT *, unnest(range(d + 1)) AS j FROM l)),
often AS (SELECT n, j, run FROM runs GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
cand AS (SELECT doc_id, line, n, d, w, min(j) AS lo, max(j) AS hi FROM runs WHERE (n, j, run) IN (SELECT (n, j, run) FROM often) GROUP BY ALL),
dl AS (SELECT w, n, d, lo, hi, count(*) AS c FROM cand GROUP BY ALL),
routes AS (
  SELECT w, n, d, c, j, w[j * n // (d + 1) + 1:(j + 1) * n // (d + 1)] AS run
  FROM (SELECT w, n, d, c, unnest(list_distinct([lo, hi])) AS j FROM dl)),
places AS (SELECT w, n, d, c, j, run, unnest(range(n)) AS p, unnest(w) AS word FROM routes),
support AS (SELECT n, j, run, p, word, sum(c) AS s FROM places GROUP BY ALL HAVING sum(c) >= {MIN_DOCS}),
ranked AS (
  SELECT w, n, d, j, run, p, word, row_number() OVER (PARTITION BY w, j ORDER BY coalesce(s, 0) DESC, p) AS r
  FROM places LEFT JOIN support USING (n, j, run, p, word)),
templates AS (SELECT w, n, j, run, list((p, word) ORDER BY p) AS t FROM ranked WHERE r <= n - d GROUP BY w, n, j, run),
recur AS (
  SELECT n, j, run, t FROM (SELECT DISTINCT n, j, run, t, doc_id FROM templates JOIN cand USING (w, n)) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT w FROM templates WHERE (n, j, run, t) IN (SELECT (n, j, run, t) FROM recur)),
h AS (SELECT doc_id, line, n, md5(array_to_string(w, ' ')) AS m FROM l),
long AS (SELECT m, count(DISTINCT doc_id) AS docs FROM h WHERE n >= {LONG_WORDS} GROUP BY m HAVING count(DISTINCT doc_id) BETWEEN {LONG_DOCS} AND {MIN_DOCS - 1}),
holder AS (SELECT DISTINCT m, doc_id FROM h WHERE m IN (SELECT m FROM long)),
least_lines AS (
  SELECT k.m, k.doc_id, o.m AS o, row_number() OVER (PARTITION BY k.m, k.doc_id ORDER BY o.m) AS r
  FROM holder k JOIN (SELECT DISTINCT doc_id, m FROM h) o ON o.doc_id = k.doc_id AND o.m <> k.m),
sketch AS (
  SELECT m, doc_id, o FROM least_lines WHERE r <= {SKETCH}
  UNION ALL SELECT m, doc_id, '' FROM holder k WHERE NOT EXISTS (SELECT 1 FROM least_lines x WHERE x.m = k.m AND x.doc_id = k.doc_id)),
related AS (
  SELECT m, count(DISTINCT doc_id) AS related FROM sketch WHERE (m, o) IN (SELECT (m, o) FROM sketch GROUP BY m, o HAVING count(*) > 1) GROUP BY m),
passage AS (SELECT m FROM long LEFT JOIN related USING (m) WHERE docs - coalesce(related, 0) + CAST(coalesce(related, 0) > 0 AS INT) >= {LONG_DOCS}),
lost AS (
  SELECT doc_id, line FROM l WHERE w IN (SELECT w FROM gone)
  UNION SELECT doc_id, line FROM h WHERE n >= {LONG_WORDS} AND m IN (SELECT m FROM passage)),
kept AS (
  SELECT raw.doc_id, count(*) AS n_lines, count(lost.line) AS n_dropped,
         coalesce(string_agg(raw.t, chr(10) ORDER BY raw.line) FILTER (WHERE lost.line IS NULL), '') AS t
  FROM raw LEFT JOIN lost ON raw.doc_id = lost.doc_id AND raw.line = lost.line GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
