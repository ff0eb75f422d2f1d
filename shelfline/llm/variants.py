"""Spelling variants: words that differ by one code point, found without making pairs of words.

Words that differ by a replacement share a wildcard group, named by the position of the free
code point, what stands before it and what after. A group keeps its size and its two largest
words, so each member is told how many near words it has there and which is the largest other
than itself. Words that differ by an insertion meet where a deletion of the longer is the
shorter: deletions join the vocabulary under their own text, and such a group tells the
shorter word the number and the largest of the longer ones, and each longer word the shorter.
A word adds up what its groups tell it. No group has more members than letters times places,
and the rows of every step are in proportion to the letters of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_folders, materialise, scratch, text_of

#: Letters of the contract; A-Z are lower-cased before.
RUN = "[a-zÀ-ÿ]+"
#: Stands for the free code point in a group's name; no letter.
FREE = "*"


def planted(doc_id: Column, run: Column, every: int) -> Column:
    """The run, less one code point where ``every`` divides the CRC-32 of ``doc_id:run``. A null id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: the words of all texts that have ``shortest`` code points and ``least`` occurrences."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(ascii_lower(text_of(F.col("text").cast("string"))), F.lit(RUN), F.lit(0))).alias("run"))
    # Nothing gets longer, so shorter runs can't become words. A task's occurrences of a word meet before they are shuffled.
    words = runs.filter(F.char_length("run") >= shortest).select(planted(F.col("doc_id"), F.col("run"), every).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.char_length("word") >= shortest) & (F.col("n") >= least))


def _groups(words: DataFrame) -> DataFrame:
    """``name, own, members``: of each group its members (n negative, word) and, where its name is a word, that word's n.

    ``members`` has at most one word a letter in a wildcard group, and one a letter and place
    among the words that a deletion turns into the name.
    """
    size, ranked = F.char_length("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    before = lambda i: F.substring(F.col("word"), F.lit(1), i - 1)
    after = lambda i: F.substring(F.col("word"), i + 1, size)
    letter = lambda i: F.substring(F.col("word"), i, F.lit(1))
    places = F.sequence(F.lit(1), size)
    wildcards = F.transform(places, lambda i: F.concat(before(i), F.lit(FREE), after(i)))
    # Deleting any of equal neighbours gives the same text; the first of them stands for all.
    deletions = F.transform(F.filter(places, lambda i: (i == 1) | (letter(i) != letter(i - 1))), lambda i: F.concat(before(i), after(i)))
    told = words.select(F.explode(F.concat(wildcards, deletions)).alias("name"), ranked.alias("member"), F.lit(None).cast("long").alias("own"))
    told = told.unionByName(words.select(F.col("word").alias("name"), F.lit(None).cast("struct<m:bigint,w:string>").alias("member"), F.col("n").alias("own")))
    return told.groupBy("name").agg(F.max("own").alias("own"), F.sort_array(F.collect_list("member")).alias("members"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best`` of distinct words (word, n); ``best`` is the near word of largest n as (n negative, word), null if none."""
    groups = _groups(words).withColumn("size", F.size("members")).filter("size > 0")
    wild = F.col("name").contains(FREE)
    first, second = F.col("members")[0], F.try_element_at("members", F.lit(2))
    alike = groups.filter(wild & (F.col("size") > 1)).select(F.explode("members").alias("to"), (F.col("size") - 1).alias("near"), first.alias("first"), second.alias("second"))
    alike = alike.select(F.col("to.w").alias("word"), "near", F.when(F.col("to.w") == F.col("first.w"), F.col("second")).otherwise(F.col("first")).alias("best"))
    met = groups.filter(~wild & F.col("own").isNotNull())
    longer = met.select(F.col("name").alias("word"), F.col("size").alias("near"), first.alias("best"))
    shorter = met.select(F.explode("members").alias("to"), F.lit(1).alias("near"), F.struct((-F.col("own")).alias("m"), F.col("name").alias("w")).alias("best")).select(F.col("to.w").alias("word"), "near", "best")
    told = alike.unionByName(longer).unionByName(shorter).select("word", F.lit(None).cast("long").alias("n"), F.col("near").cast("long").alias("near"), "best")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<m:bigint,w:string>").alias("best"))
    return told.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word reached by following forms. Steps double each round; n grows at each step, so there is no circle."""
    spark, old = forms.sparkSession, []
    with scratch() as made:
        reach = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        old, further = made.folders, reach.select(F.col("word").alias("from"), F.col("root").alias("to"))
        with scratch() as made:
            nearer = reach
            reach = materialise(nearer.join(further.hint("merge"), F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        drop_folders(spark, old)
        if reach.filter("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words come from maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are
    lower-cased; where ``every`` divides the CRC-32 of ``doc_id:run`` a run loses one code point.
    A word has ``shortest`` code points and ``least`` occurrences or more. ``form`` is its near word of
    largest n (ties: smallest in code-point order) if that n is ``ratio`` times its own, else null;
    ``ratio`` is 2 or more. ``root`` is the last word that forms lead to. Null, empty and letterless
    texts have no runs; a null doc_id counts as empty text before the colon; rows that repeat count each
    time; an empty table gives none. Columns besides doc_id and text are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more: forms must lead to more frequent words")
    words = materialise(vocabulary(docs, every, shortest, least), "words")
    near = near_words(words)
    fits = -F.col("best.m") >= ratio * F.col("n")
    near = near.select("word", "n", "n_near", F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    near = materialise(near, "near")
    found = roots(near.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "leaf")
    out = near.join(found.hint("merge"), F.col("word") == F.col("leaf"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 is spelled out by its table of remainders; near words by self-joins over wildcards and deletions.
ORACLE = """
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), coded AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT run, times, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST((instr('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT)) AS b FROM coded),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS z FROM places),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM cut d JOIN words w ON w.word = d.a || d.z
  UNION SELECT w.word, d.word, d.n FROM cut d JOIN words w ON w.word = d.a || d.z
), summed AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN summed USING (word)
), walk AS (
  SELECT word, word AS last_word, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next
)
SELECT word, form, last_word AS root, n, n_near, form_n FROM forms JOIN (SELECT word, last_word FROM walk WHERE next IS NULL) USING (word)
"""
