"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

The index is document-partitioned: each partition of the documents writes one shard, a Parquet file of
postings (term, document, position) sorted by term, so that a lookup by term reads few row groups and no
posting is shuffled to build it. Only terms of the test set are stored unless all are asked for: no other
posting is ever read. A posting of term END with the document's length closes each document.

Phrases are searched from the rarest terms: of each window the two rarest terms' lists, each shifted by
the term's offset, are intersected; only the alignments left are intersected with the lists of all other
terms. Nothing is grouped by term, so a frequent term burdens no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm.shared import drop, fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = 0
#: Rows, of 64 bytes of text at most, up to which a side is broadcast; beyond it Spark joins by a shuffle.
MOST_BROADCAST = 500_000


def words(text: Column) -> Column:
    """The words as they stand in the text; none of a null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAK), "")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _weight(df: DataFrame, text: str) -> int:
    """Rows as _small() counts them: one with a text of more than 64 bytes stands for several."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(n, size // 64)


class TestSet:
    """Test items as term positions: ``positions`` (item, at, term, length) and ``vocabulary`` (word, term).

    ``item`` numbers the distinct pairs of id and word list; items without words are left out.
    """

    __test__ = False

    def __init__(self, items: DataFrame, item_id: str, text: str):
        lists = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.transform(words(F.col(text)), _ascii_lower).alias("words"))
        lists, at1 = written(lists.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "test-items")
        self.items = lists.select("item", "item_id", F.size("words").alias("length"))
        self.n_items = _weight(self.items, "item_id")
        each = lists.select("item", F.size("words").alias("length"), F.posexplode("words").alias("at", "word"))
        vocabulary, at2 = written(each.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1), "test-words")
        self.vocabulary = vocabulary
        self.n_words = _weight(vocabulary, "word")
        self.positions, at3 = written(each.join(_small(vocabulary, self.n_words), "word").drop("word"), "test-positions")
        self.n_positions = self.positions.count()
        self.folders = [at1, at2, at3]


def build_index(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame, n_words: int) -> tuple[DataFrame, str]:
    """Postings (term, row, doc, at) of the vocabulary's words, written shard by shard; and their folder.

    ``row`` numbers the documents' rows, so rows with one doc_id stay apart. The END posting's position is
    the document's number of words; a null or empty text has that posting alone.
    """
    spark = docs.sparkSession
    end = spark.createDataFrame([("\0", END)], "word string, term long")
    known = vocabulary.select("word", "term").unionAll(end).select(F.lower("word").alias("key"), "word", "term")
    token = docs.select(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"), F.concat(words(F.col(text)), F.array(F.lit("\0"))).alias("tokens"))
    token = token.select("doc", "row", F.posexplode("tokens").alias("at", "token"))
    # Equal words are equal when fully lower-cased, which is far cheaper than translate() on all tokens.
    found = token.withColumn("key", F.lower("token")).join(_small(known, n_words), "key").where(_ascii_lower(F.col("token")) == F.col("word"))
    return written(found.select("term", "row", "doc", "at").sortWithinPartitions("term", "row", "at"), "postings")


def _windows(tests: TestSet, frequency: DataFrame, width: int) -> DataFrame:
    """Each item's windows that can occur, with the places of their two rarest terms."""
    term = tests.positions.join(_small(frequency, tests.n_words), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.least(F.col("length"), F.lit(width))
    first = F.greatest(F.col("at") - size + 1, F.lit(0))
    each = term.select("item", "length", "at", "term", "n", size.alias("size"), F.explode(F.sequence(first, F.least(F.col("at"), F.col("length") - size))).alias("start"))
    best = each.groupBy("item", "start", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by"))
    # Of a window's terms a repeated one isn't a second list worth much, but still a valid one.
    return best.where(F.col("by")[0]["n"] > 0).select("item", "start", "size", F.col("by")[0].alias("first"), F.when(F.size("by") > 1, F.get("by", F.lit(1))).otherwise(F.col("by")[0]).alias("second"))


def phrase_matches(index: DataFrame, tests: TestSet, width: int = 10) -> tuple[DataFrame, list[str]]:
    """Every stretch of an item, ``width`` words or longer (or the whole of a shorter item), that occurs.

    Rows (row, doc, item, shift, first, last): item words first..last are the document's words
    shift+first..shift+last, and the stretch can't be extended. Also the folders in use.
    """
    frequency = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    windows, at1 = written(_windows(tests, frequency, width), "windows")
    many = windows.count()
    anchors = windows.select("item", F.explode(F.array("first", "second")).alias("a")).select("item", F.col("a.term").alias("term"), F.col("a.at").alias("place")).distinct()
    near = index.join(_small(anchors, 2 * many), "term").groupBy("row", "doc", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    # A place that was met brings only the windows whose rarest term it is.
    own = windows.select("item", "start", "size", F.col("first.at").alias("met"), F.col("second.at").alias("too"))
    left = near.withColumn("met", F.explode("places")).join(_small(own, many), ["item", "met"]).where(F.array_contains("places", F.col("too")))
    span = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    left, at2 = written(left.select("row", "doc", "item", "shift", span.alias("place")).distinct(), "alignments")
    wanted_rows = left.select("row").distinct()
    n_rows = wanted_rows.count()
    postings = index.where(F.col("term") != END).select("row", "term", "at")
    if n_rows <= MOST_BROADCAST:
        postings = postings.join(F.broadcast(wanted_rows), "row", "left_semi")
    terms = tests.positions.select("item", F.col("at").alias("place"), "term", "length")
    need = left.join(_small(terms, tests.n_positions), ["item", "place"])
    need = need.withColumn("at", F.col("shift") + F.col("place"))
    met = need.join(postings, ["row", "at", "term"], "left_semi")
    by = Window.partitionBy("row", "item", "shift").orderBy("place")
    island = met.withColumn("island", F.col("place") - F.row_number().over(by))
    runs = island.groupBy("row", "doc", "item", "shift", "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("length").alias("length"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(width), F.col("length"))).select("row", "doc", "item", "shift", "first", "last"), [at1, at2]


def proximity_matches(index: DataFrame, tests: TestSet, within: int = 20, width: int = 10) -> DataFrame:
    """Rows (row, doc, item, start, at): of item's window of ``width`` words (or the whole of a shorter item)
    that begins at ``start``, the rarest term stands at ``at`` and each other term no more than ``within``
    words from it, in any order. ``within`` is at least what lets a verbatim window match."""
    within = max(within, width - 1)
    frequency = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    size = F.least(F.col("length"), F.lit(width))
    start = F.explode(F.sequence(F.greatest(F.col("at") - size + 1, F.lit(0)), F.least(F.col("at"), F.col("length") - size)))
    each = tests.positions.join(_small(frequency, tests.n_words), "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("item", "term", "n", start.alias("start"))
    windows = each.groupBy("item", "start").agg(F.min(F.struct("n", "term")).alias("rarest"), F.collect_set("term").alias("terms")).where("rarest.n > 0")
    own = windows.groupBy("item", F.col("rarest.term").alias("anchor")).agg(F.collect_list(F.struct("start", "terms")).alias("windows"))
    stride = within + 1
    postings = index.where(F.col("term") != END).withColumn("cell", F.floor(F.col("at") / stride))
    anchors = postings.join(_small(own.select("item", "anchor"), tests.n_positions), F.col("term") == F.col("anchor")).select("row", "doc", "item", "anchor", F.col("at").alias("centre"), "cell")
    around = anchors.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    others = postings.join(_small(tests.positions.select("item", "term").distinct(), tests.n_positions), "term").select("row", "item", "term", "at", "cell")
    met = around.join(others, ["row", "item", "cell"]).where(F.abs(F.col("at") - F.col("centre")) <= within)
    found = met.groupBy("row", "doc", "item", "anchor", "centre").agg(F.collect_set("term").alias("found")).join(_small(own, tests.n_positions), ["item", "anchor"])
    whole = F.filter("windows", lambda w: F.size(F.array_except(w["terms"], F.col("found"))) == 0)
    return found.select("row", "doc", "item", F.explode(whole).alias("w"), F.col("centre").alias("at")).select("row", "doc", "item", "w.start", "at")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and
    the folders that it reads.

    Words are those between BREAK characters, A-Z lower-cased. Null and empty texts have no words and no
    hits; items without words match nothing; items with one id count once, a null id as "null"; rows that
    share a doc_id are judged each by itself. Empty tables give no rows, or no hits.
    """
    tests = TestSet(benchmark, item_id, item_text)
    index, at = build_index(docs, doc_id, text, tests.vocabulary, tests.n_words)
    matches, more = phrase_matches(index, tests, width)
    matches, at2 = written(matches, "matches")
    drop(docs.sparkSession, *more)
    items = _small(tests.items.select("item", "item_id"), tests.n_items)
    hits = matches.select("row", F.explode(F.sequence(F.col("shift") + F.col("first"), F.col("shift") + F.col("last"))).alias("at")).groupBy("row").agg(F.count_distinct("at").alias("n_hit"))
    which = matches.select("row", "item").distinct().join(items, "item").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    every = index.where(F.col("term") == END).select("row", F.col("doc").alias(doc_id), F.col("at").cast("long").alias("n_words"))
    out = every.join(hits, "row", "left").join(which, "row", "left").select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return out, [at, at2, *tests.folders]


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no test window. Each row is judged by its own text, known
    by a 64-bit hash, whatever rows share its doc_id."""
    own = F.xxhash64(F.col("text").cast("string"))
    found, _ = contamination(docs.select(own.alias("doc_id"), "text"), benchmark, width)
    hit = fresh(docs, "_hit")
    bad = found.where("contaminated").select(F.col("doc_id").alias(hit)).distinct()
    bad = _small(bad, bad.count())
    return docs.join(bad, own == F.col(hit), "left_anti")
