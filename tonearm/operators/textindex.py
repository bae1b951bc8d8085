"""A stored inverted index for prefix search: term-sorted postings in blocks with bounds, read by term range and by bound.

Documents fall into blocks of at most about ``BLOCK`` documents and ``BLOCK_BYTES`` of text, those of like length together, so that a
block's bounds are tight.  A row of the postings is a term in a document: their block, how often, and the document's length.  Texts are
dealt out by block once; a task counts its blocks' words and writes them sorted by term and block, a file for each of ``RANGES`` ranges
of terms, so words and postings are never shuffled.  A manifest knows each file's range.  A search

1. opens only files whose terms can start with one of the query's words;
2. counts how many documents hold each word, and bounds every block's best score (blocks that lack a word are out), without ids;
3. reads blocks in order of their bound, more each round, until no block left can reach the last place wanted.

``add`` writes further documents as a part of its own; totals are sums over parts.  An id is indexed once: where a text changes, the
index is built anew.  Documents without words count in the totals but are never found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import cut, shared_folder

BLOCK, BLOCK_BYTES = 4096, 8 << 20
TASK_BYTES = 16 << 20  # of text, a task; less where cores would be idle
RANGES = 8  # of terms, each a file of a task
SAMPLE = 500  # documents from whose first 1,000 characters the ranges' limits come; they decide only how even the files are
AT_ONCE = 8  # blocks of the first round; twice as many in each later one


def tokens(text: Column) -> Column:
    """Search tokens: lower case runs of letters, digits, ``_`` and ``-``."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", ""), r"\s+"), lambda w: w != "")


def query_words(query: str) -> list[str]:
    words = list(dict.fromkeys(t for t in ("".join(c for c in w if c.isalnum() or c in "_-") for w in query.lower().split()) if t))
    if not words:
        raise ValueError("empty query")
    return words


@dataclass(frozen=True)
class TextIndex:
    """An index at ``path``: ``postings`` (a folder for each part), ``manifest`` and ``totals``."""

    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def totals(self) -> tuple[int, float]:
        """How many documents there are, and their mean length."""
        r = self.spark.read.parquet(f"{self.path}/totals").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        return r["docs"] or 0, (r["words"] or 0) / (r["docs"] or 1)

    def postings(self, words: list[str]) -> DataFrame | None:
        """Rows of terms that start with one of ``words``, with the word's number ``q``; None where no file can hold one."""
        near = [(F.col("last") >= w) & ((F.col("first") <= w) | F.startswith("first", F.lit(w))) for w in words]
        files = [[r["file"] for r in self.manifest().where(x).select("file").collect()] for x in near]
        each = [self.spark.read.parquet(*some).where((F.col("term") >= w) & F.col("term").startswith(w)).withColumn("q", F.lit(q)) for q, (w, some) in enumerate(zip(words, files, strict=True)) if some]
        return reduce(DataFrame.unionByName, each) if each else None


def built(docs: DataFrame, id_col: str, text: str) -> TextIndex:
    """A new index of ``docs`` in the shared folder."""
    index = TextIndex(docs.sparkSession, shared_folder(docs.sparkSession, "text-index"))
    add(index, docs, id_col, text)
    return index


def _limits(texts: DataFrame, docs: int) -> list[str]:
    """Terms that part the words of a sample into ``RANGES`` like shares."""
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(math.ceil(docs / SAMPLE))) == 0).limit(2 * SAMPLE) if docs else texts.limit(0)
    terms = sorted(r["t"] for r in some.select(F.explode(tokens(F.substring("text", 1, 1000))).alias("t")).distinct().collect())
    return sorted({terms[len(terms) * i // RANGES] for i in range(1, RANGES)}) if terms else []


def add(index: TextIndex, docs: DataFrame, id_col: str, text: str) -> None:
    """Indexes further documents as a part of its own."""
    path = shared_folder(index.spark, "part").rsplit("/", 1)[1]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lengths = F.floor(2 * F.log2(F.octet_length("text") + 1)).cast("int")
    counts = texts.groupBy(lengths.alias("lengths")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # at most 64 classes of length
    n, size = sum(r["n"] for r in counts), sum(r["bytes"] for r in counts)
    number, blocks = F.lit(0), 0
    for r in counts:
        here = max(1, math.ceil(r["n"] / BLOCK), math.ceil(r["bytes"] / BLOCK_BYTES))
        number, blocks = F.when(lengths == r["lengths"], blocks + F.pmod(F.xxhash64("id"), F.lit(here))).otherwise(number), blocks + here
    tasks = max(1, math.ceil(size / TASK_BYTES), min(index.spark.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))))
    dealt = texts.withColumn("number", number.cast("int")).repartitionById(tasks, "number")  # what follows groups by number and needs no other shuffle
    split = dealt.select("number", "id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    each = split.select("number", "id", "len", F.explode_outer("t").alias("term")).where("term IS NOT NULL")  # explode's own filter would split texts twice
    rows = each.groupBy("number", "term", "id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    limits = _limits(texts, n)
    place = reduce(lambda c, x: c + (F.col("term") >= x).cast("int"), limits, F.lit(0)).alias("range")
    rows = rows.select("*", place).sortWithinPartitions("range", "term", "number").select("term", F.concat_ws("-", F.lit(path), "number").alias("block"), "id", "tf", "len", "range")
    at = f"{index.path}/postings/{path}"
    rows.write.option("compression", "zstd").partitionBy("range").parquet(at)
    stored = index.spark.read.schema(rows.schema).parquet(at)
    total = stored.agg(F.sum("tf").alias("words")).first()["words"] or 0
    ends = stored.where(F.col("range").isin(0, len(limits))).agg(F.min("term").alias("first"), F.max("term").alias("last")).first()
    files = index.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(at).select(F.col("path").alias("file"))  # names only
    bound = lambda ends: F.element_at(F.array(*map(F.lit, ends)), F.regexp_extract("file", r"/range=(\d+)/[^/]*$", 1).cast("int") + 1)
    files.select("file", bound([ends["first"], *limits]).alias("first"), bound([*limits, ends["last"]]).alias("last")).coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")
    index.spark.createDataFrame([(n, total)], "docs long, words long").coalesce(1).write.mode("append").parquet(f"{index.path}/totals")


def _score(idf: Column, tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def search(index: TextIndex, query: str, most: int | None = 50, k1: float = 1.2, b: float = 0.75, read: list | None = None) -> DataFrame:
    """id and rank of documents in which every word of the query starts some word, by BM25; the best ``most``, or all.

    A word's count in a document is that of all terms it starts.  Equal ranks: the lesser id comes first.  ``read``, if given,
    gets the blocks that were read.
    """
    words = query_words(query)
    none = index.spark.createDataFrame([], "id long, rank double")
    rows = index.postings(words)
    if rows is None:
        return none
    n, mean = index.totals()
    terms = rows.groupBy("q", "block", "term").agg(F.max("tf").alias("most"), F.min("len").alias("shortest"), F.count(F.lit(1)).alias("n"))
    bounds = cut(terms.groupBy("q", "block").agg(F.sum("most").alias("most"), F.min("shortest").alias("shortest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms")))  # a row for each word and block
    single = bounds.where("terms = 1").groupBy("q").agg(F.sum("n").alias("df"))
    several = rows.join(F.broadcast(bounds.where("terms > 1").select("q", "block")), ["q", "block"], "left_semi").select("q", "id").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    df = {r["q"]: r["df"] for r in single.unionByName(several).groupBy("q").agg(F.sum("df").alias("df")).collect()}
    if len(df) < len(words):
        return none
    idf = [F.log(F.lit(1.0 + (n - df[q] + 0.5) / (df[q] + 0.5))) for q in range(len(words))]
    weight = reduce(lambda c, i: F.when(F.col("q") == i, idf[i]).otherwise(c), range(1, len(words)), idf[0])
    bound = F.sum(_score(weight, F.col("most"), F.col("shortest"), mean, k1, b))
    blocks = bounds.groupBy("block").agg(F.count(F.lit(1)).alias("held"), bound.alias("bound")).where(F.col("held") == len(words)).select("block", "bound")

    def scored(chosen: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(chosen.select("block")), "block", "left_semi")
        tf = [F.sum(F.when(F.col("q") == q, F.col("tf")).otherwise(0)).alias(f"c{q}") for q in range(len(words))]
        every = reduce(lambda x, y: x & y, [F.col(f"c{q}") > 0 for q in range(len(words))])
        rank = reduce(lambda x, q: x + _score(idf[q], F.col(f"c{q}"), F.col("len"), mean, k1, b), range(len(words)), F.lit(0.0))
        return found.groupBy("id", "len").agg(*tf).where(every).select("id", rank.alias("rank"))

    if most is None:
        return scored(blocks)
    blocks, best, size, last = cut(blocks), [], AT_ONCE, None
    while True:
        left = blocks if last is None else blocks.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("block") > last[1])))
        if len(best) >= most:
            left = left.where(F.col("bound") * (1 + 1e-12) >= best[most - 1]["rank"])  # a bound is summed in another order than a score
        chosen = left.orderBy(F.desc("bound"), "block").limit(size).collect()
        if not chosen:
            break
        if read is not None:
            read += [r["block"] for r in chosen]
        new = scored(index.spark.createDataFrame([(r["block"],) for r in chosen], "block string"))
        best = sorted(best + new.orderBy(F.desc("rank"), "id").limit(most).collect(), key=lambda r: (-r["rank"], r["id"]))[:most]
        last, size = (chosen[-1]["bound"], chosen[-1]["block"]), 2 * size
    return index.spark.createDataFrame([(r["id"], r["rank"]) for r in best], "id long, rank double")
