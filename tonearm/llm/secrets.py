"""Secret scans with DataFrame functions only.

Base spans come from three patterns (``KINDS``) and are always whole.  The method adds spans: the text
that base spans leave is searched for long runs of key characters with a letter and a digit or with letters
of both cases; such a run is a secret where a character Markov model of random strings explains it
better than one of ordinary identifiers, by mean log-likelihood ratio per transition.

Both models are trained from labelled samples.  ``corpus_samples`` takes them from all documents: values that
a base pattern found (random), words and paths of documents without any (ordinary).  ``default_samples`` makes
some by rule, for what a corpus may lack.  Transitions of both are counted apart and their probabilities
averaged, with a weight that grows from 0 to 1 with the transitions seen, so that neither drowns the other and a
few rows decide nothing; the table of ratios has one entry per pair of characters, so its size is fixed by the alphabet.

Spans are code-point offsets, end exclusive.  Matches are found from the left without overlap; a
match that fails its length test is dropped but still consumes its text.  Every step takes time in
proportion to the text and to n log n of its n matches, so very long runs and texts need no limit.

Null text: empty.  No match: counts 0 and an empty list.  Rows with equal or null doc_id are scanned each
on its own, and rows that repeat count as often for the models.  An empty table: no rows, and
models of the made samples alone.  Columns other than doc_id and text are ignored (``masked`` keeps them).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"  # a run that is shorter fails the length test whole, so it need not match
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
THRESHOLD = 0.6
SPANS = "array<struct<start:int,kind:int,end:int>>"

# Where a base pattern can match at all.
HINTS = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")

# Words that ordinary identifiers are made of.
WORDS = (
    "user name list item count index value key table column row page file path data base time date start end size length "
    "width height color font style button event handler class object method function return string number array map set get "
    "put post update delete create insert select order group by from to with request response server client config default "
    "error message test example version build release debug info warning manager service controller model view image video "
    "audio stream buffer cache queue thread process task job batch input output source target result report summary total "
    "first last next previous current new old main local global static public private http https www com org html css"
).split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an integer array under ``op``; each round doubles how far an entry looks back."""

    def totals(v):
        shifts = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(v)))), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(shifts, v, lambda acc, d: F.transform(acc, lambda x, i: F.coalesce(op(x, F.get(acc, i - d)), x)))

    return _let(values, totals)


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """start, kind, end and the given group of every match of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.struct(found.alias("found"), value.alias("value"), F.split(text, pattern, -1).alias("gaps"))

    def placed(b):
        steps = F.zip_with(b["found"], F.slice(b["gaps"], 1, F.size(b["found"])), lambda m, gap: F.length(m) + F.length(gap))
        rows = F.arrays_zip(_running(steps, lambda x, y: x + y).alias("end"), b["found"].alias("match"), b["value"].alias("value"))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["match"])).alias("start"), F.lit(kind).alias("kind"), r["end"].alias("end"), r["value"].alias("value")))

    return _let(both, placed)


def _spans(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    def scan_for(kind, pattern, least, group=0):
        long_enough = F.filter(_matches(text, pattern, kind, group), lambda m: F.length(m["value"]) >= least)
        return F.when(F.regexp_like(text, F.lit(HINTS[kind])), _spans(long_enough)).otherwise(F.array().cast(SPANS))

    return F.concat(scan_for(0, ASSIGN, 6, 1), scan_for(1, ACCESS, 20), scan_for(2, HEX, 24))


def stretches(spans: Column) -> Column:
    """Start and end of each maximal stretch of overlapping spans; ``spans`` are sorted by start."""

    def merge(s):
        def parts(reach):
            heads = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
            last = lambda h, j: F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1)
            return _let(heads, lambda h: F.transform(h, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), last(h, j).alias("end"))))

        return _let(_running(F.transform(s, lambda x: x["end"]), F.greatest), parts)

    return _let(spans, merge)


def replaced(text: Column, spans: Column, filler: Callable[[Column], Column]) -> Column:
    """The text with ``filler`` of each stretch of overlapping spans in its place."""

    def fill(w):  # four bytes a code point: a cut costs no walk from the start
        cut = lambda lo, n: F.decode(F.substr(w["wide"], lo * 4 + 1, n * 4), "UTF-32")
        before = lambda j: F.coalesce(F.get(w["at"], j - 1)["end"], F.lit(0))
        pairs = F.transform(w["at"], lambda x, j: F.array(cut(before(j), x["start"] - before(j)), filler(x)))
        at = before(F.size(w["at"]))
        return F.array_join(F.concat(F.flatten(pairs), F.array(cut(at, F.length(text) - at))), "")

    return F.when(F.size(spans) > 0, _let(F.struct(F.encode(text, "UTF-32").alias("wide"), stretches(spans).alias("at")), fill)).otherwise(text)


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each maximal stretch of overlapping spans replaced by ``mask``."""
    return replaced(text, spans, lambda x: F.lit(mask))


def default_samples(spark: SparkSession, each: int = 3000) -> DataFrame:
    """Labelled samples made by rule: random strings over four alphabets (1), identifiers joined from words (0)."""
    i = F.col("i")

    def pick(options: Column, n: int, salt: Column) -> Column:
        return F.element_at(options, (F.pmod(F.xxhash64(i, salt), F.lit(n)) + 1).cast("int"))

    def random_string(alphabet: str) -> Column:
        n = (F.pmod(F.xxhash64(i, F.lit("len")), F.lit(28)) + 20).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(i, j), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))), "")

    words = F.split(F.lit(" ".join(WORDS)), " ")

    def identifier(sep: str, shape) -> Column:
        n = (F.pmod(F.xxhash64(i, F.lit("words")), F.lit(4)) + 2).cast("int")
        tail = F.when(F.pmod(F.xxhash64(i, F.lit("t")), F.lit(2)) == 0, F.concat(F.lit(sep), F.pmod(F.xxhash64(i, F.lit("n")), F.lit(2100)).cast("string"))).otherwise("")
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: shape(pick(words, len(WORDS), j))), sep), tail)

    hexes, base62 = "0123456789abcdef", ALPHABET[:62]
    random = F.when(i % 4 == 0, random_string(hexes)).when(i % 4 == 1, random_string(hexes.upper())).when(i % 4 == 2, random_string(base62)).otherwise(random_string(base62 + "+/"))
    plain = F.when(i % 4 == 0, identifier("_", F.lower)).when(i % 4 == 1, identifier("-", F.lower)).when(i % 4 == 2, identifier("", F.initcap)).otherwise(identifier("/", F.lower))
    ids = spark.range(each).withColumnRenamed("id", "i")
    return ids.select(random.alias("sample"), F.lit(1).alias("label")).unionAll(ids.select(plain.alias("sample"), F.lit(0).alias("label")))


def corpus_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples from all documents.

    1: what base patterns found, the values of assignments for that kind, of 16 to 200 characters with a letter and a digit.
    0: runs of 12 to 40 key characters of documents in which no base pattern can match.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    secret = F.filter(F.concat(of(ASSIGN, 1), of(ACCESS), of(HEX)), lambda s: F.length(s).between(16, 200) & F.regexp_like(s, F.lit("[0-9]")) & F.regexp_like(s, F.lit("[A-Za-z]")))
    plain = of("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,40}(?![A-Za-z0-9+/_-])")
    marked = F.regexp_like("text", F.lit(HINTS[0])) | F.regexp_like("text", F.lit(HINTS[1])) | F.regexp_like("text", F.lit(HINTS[2]))
    rows = docs.select(text.alias("text"))  # read twice: beside an exploded array, the test of the text would run for each entry
    kept = lambda rows, samples, label: rows.select(F.explode(samples).alias("sample")).select("sample", F.lit(label).alias("label"))
    return kept(rows.where(marked), secret, 1).unionAll(kept(rows.where(~marked), plain, 0))


def _counts(samples: DataFrame) -> list[list[list[int]]]:
    """By label and character, how often each character comes next."""
    size = len(ALPHABET)
    text = F.col("sample").cast("string")
    usable = samples.where("sample IS NOT NULL AND label IN (0, 1)").select("label", text.alias("s"))
    pairs = usable.select("label", F.explode(F.when(F.length("s") > 1, F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr("s", i, F.lit(2))))).alias("pair"))
    counts = [[[0] * size for _ in range(size)] for _ in range(2)]
    for r in pairs.where(F.regexp_like("pair", F.lit("^[A-Za-z0-9+/_-]{2}$"))).groupBy("label", "pair").count().collect():
        counts[int(r["label"])][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    return counts


def train(*samples: DataFrame, smoothing: float = 0.5, half: int = 500) -> list[float]:
    """Log-likelihood ratio (random over identifier) of each pair of alphabet characters, in alphabet order.

    Each of ``samples`` has columns sample and label (1 random, 0 identifier).  For each label and character, a sample set with
    n transitions from it weighs n / (n + ``half``).  All rows count; at most two numbers per pair reach the driver from each.
    """
    tables, size = [_counts(s) for s in samples], len(ALPHABET)

    def chance(label, a, b):
        rows = [t[label][a] for t in tables if any(t[label][a])]
        weights = [sum(row) / (sum(row) + half) for row in rows]
        chances = [(row[b] + smoothing) / (sum(row) + smoothing * size) for row in rows]
        return sum(w * p for w, p in zip(weights, chances)) / sum(weights) if rows else 1 / size

    return [log(chance(1, a, b) / chance(0, a, b)) for a, b in itertools.product(range(size), repeat=2)]


def log_ratio(s: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string over the alphabet."""
    size = len(ALPHABET) + 1  # place 0: outside the alphabet
    padded = [0.0] * size
    for a in range(size - 1):
        padded += [0.0, *table[a * (size - 1) : (a + 1) * (size - 1)]]
    ratios = F.from_json(F.lit("[" + ",".join(f"{x:.5f}" for x in padded) + "]"), "array<double>")
    places = F.from_json(F.lit(str([ALPHABET.find(chr(c)) + 1 for c in range(128)])), "array<int>")
    codes = F.transform(F.split(s, ""), lambda c: F.coalesce(F.get(places, F.ascii(c)), F.lit(0)))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["total"] + F.get(ratios, acc["last"] * size + c)).alias("total"))
    return F.aggregate(codes, start, step, lambda acc: acc["total"]) / F.greatest(F.length(s) - 1, F.lit(1))


def markov_spans(text: Column, base: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans that the Markov models add, of runs cut at the base spans (sorted by start)."""

    def added(clear):
        has = lambda m, some: F.regexp_like(m["value"], F.lit(some))
        mixed = lambda m: (has(m, "[0-9]") & has(m, "[A-Za-z]")) | (has(m, "[a-z]") & has(m, "[A-Z]"))
        kept = F.filter(F.filter(_matches(clear, RUN, 3), mixed), lambda m: log_ratio(m["value"], table) > threshold)
        return F.when(F.regexp_like(clear, F.lit("[A-Za-z0-9+/_-]{20}")), _spans(kept)).otherwise(F.array().cast(SPANS))

    return _let(replaced(text, base, lambda x: F.repeat(F.lit(" "), x["end"] - x["start"])), added)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _found(rows: DataFrame, text: Column, table: list[float], threshold: float) -> DataFrame:
    based = rows.withColumn("base", F.array_sort(base_spans(text)))
    return based.withColumn("spans", F.array_sort(F.concat("base", markov_spans(text, F.col("base"), table, threshold))))


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, base and spans (both sorted by start, kind, end) of every document; models of ``docs`` by default."""
    table = table or train(default_samples(docs.sparkSession), corpus_samples(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _found(rows, F.col("text"), table, threshold)


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``n_chars`` counted anew where that column exists."""
    table = table or train(default_samples(docs.sparkSession), corpus_samples(docs))
    row = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    found = _found(row, text, table, threshold)
    clean = found.select("row", F.when(F.col("row.text").isNotNull(), redacted(text, F.col("spans"), mask)).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
