"""Names, titles, artists and folders. Columns in, columns out; nothing here runs Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that introduce a featured artist, longest first.
FEAT = r"(?:featuring|feat\.|feat|ft\.|ft) "


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """A-Z only: the order and equality of a case-insensitive ASCII collation."""
    return F.translate(c, UPPER, LOWER)


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def group_key(c: Column) -> Column:
    """Lower case, white space collapsed, trimmed: what names are grouped by."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def sort_key(c: Column) -> Column:
    """A leading article goes to the end: "The Beatles" sorts as "Beatles, The"."""
    return F.regexp_replace(F.trim(c), r"(?is)^(the|a) \s*(\S.*)$", "$2, $1")


def sane_year(c: Column, this_year: int) -> Column:
    return F.when(c.between(1900, this_year + 1), c)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal strings, falling to 0 with edit distance, as a float."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == b) | (longest == 0), F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b).cast("float") / longest.cast("float")).cast("float")


def main_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?s)^[^:(]*", 0))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of a's words (repeats count) that b has."""
    words = F.filter(F.split(F.trim(a), r"\s+"), lambda w: w != "")
    other = F.split(F.trim(b), r"\s+")
    hits = F.size(F.filter(words, lambda w: F.array_contains(other, w)))
    return (hits / F.greatest(F.size(words), F.lit(1))).cast("float")


def distinct_folded(names: Column) -> Column:
    """Names without repeats that differ in ASCII case only; the first of each stays."""
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        k = ascii_lower(x)
        new = F.struct(F.concat(acc["keys"], F.array(k)).alias("keys"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(F.array_contains(acc["keys"], k), acc).otherwise(new)

    return F.aggregate(names, start, step, lambda acc: acc["out"])


def split_artists(c: Column) -> Column:
    """Artists of a tag, main ones first: featured ones are lifted out, ";" splits, and "/" where it touches white space."""
    inner = rf"(?i)\(\s*{FEAT}\s*([^)]*[^)\s][^)]*)\)"
    main = F.regexp_replace(c, inner, " ")
    extra = F.regexp_extract_all(c, F.lit(inner), F.lit(1))
    seeds = F.concat(F.array(main), extra)
    chunks = F.flatten(F.transform(seeds, lambda s: F.split(s, rf"(?i)(?:^|(?<= )){FEAT}")))
    pieces = F.flatten(F.transform(chunks, lambda s: F.split(s, r";|(?<=\s)/|/(?=\s)")))
    return distinct_folded(F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != ""))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]+$", 1)


def is_disc_folder(name: Column) -> Column:
    return F.trim(name).rlike(r"(?i)^(disc|disk|cd)[ _.-]*[0-9]+$")


def disc_number(folder: Column) -> Column:
    """The number of a disc folder, else null."""
    return F.when(is_disc_folder(folder), F.regexp_replace(folder, "[^0-9]", "").cast("int"))


def book_dir(path: Column) -> Column:
    """The directory of a file with trailing disc folders taken off."""
    return F.regexp_replace(parent_dir(path), r"(?i)(/(disc|disk|cd)[ _.-]*[0-9]+\s*)+$", "")


def tidy(c: Column) -> Column:
    """Trimmed of white space and of dashes and underscores at the ends; null if nothing is left."""
    return bound(F.regexp_replace(F.trim(c), "^[-_]+|[-_]+$", ""), blank_to_null)


def merge_field(tag: Column, folder: Column) -> Column:
    return F.coalesce(tidy(tag), folder)


def parse_folder(parts: Column) -> Column:
    """Book details from the folders below the library root: narrator, series_index, year, title, author, series.

    ``Author/Series/Vol 1 - 1999 - Title {Narrator}`` and its shorter forms; null for no folders.
    """
    n = F.size(parts)
    narrated = r"(?s)^(.*)\{([^{]*)\}\s*$"
    volume = r"(?is)^(?:(?:volume|vol\.|vol|book|#)\s*([0-9][0-9.]*|\.[0-9][0-9.]*)\s*-?|([0-9][0-9.]*)\s*-)\s*(.*)$"
    year = r"(?s)^([12][0-9]{3})\s*-\s*(.*)$"

    def numbered(s):
        both = F.concat(F.regexp_extract(s, volume, 1), F.regexp_extract(s, volume, 2))
        return F.struct(F.rtrim(both, F.lit(".")).try_cast("double").alias("number"), F.regexp_extract(s, volume, 3).alias("rest"))

    def in_front(s, name):  # a volume before the year
        first = s["number"].isNotNull()
        return F.struct(s["number"].alias("number"), F.when(first, s["rest"]).otherwise(name).alias("after"))

    def dated(s):
        return F.when(s["after"].rlike(year), F.struct(F.regexp_extract(s["after"], year, 1).cast("int").alias("year"), F.regexp_extract(s["after"], year, 2).alias("then")))

    def details(last, named, front, date, behind):
        then = F.when(date.isNotNull(), date["then"]).otherwise(front["after"])
        rest = F.when(behind["number"].isNotNull(), behind["rest"]).otherwise(then)
        return F.struct(
            F.when(named["has"], tidy(F.regexp_extract(last, narrated, 2))).alias("narrator"),
            F.coalesce(front["number"], behind["number"]).alias("series_index"),
            date["year"].alias("year"),
            F.coalesce(tidy(rest), tidy(named["name"])).alias("title"),
            F.when(n > 1, tidy(F.get(parts, F.lit(0)))).alias("author"),
            F.when(n > 2, tidy(F.get(parts, n - 2))).alias("series"),
        )

    def by_date(last, named, front, date):
        return bound(F.when(front["number"].isNull() & date.isNotNull(), numbered(date["then"])), lambda behind: details(last, named, front, date, behind))

    def by_front(last, named, front):
        return bound(dated(front), lambda date: by_date(last, named, front, date))

    def by_name(last, named):
        volumes = F.when(~named["name"].rlike(year), numbered(named["name"]))
        return bound(bound(volumes, lambda s: in_front(s, named["name"])), lambda front: by_front(last, named, front))

    def by_last(last):
        has = last.rlike(narrated)
        name = F.when(has, F.rtrim(F.regexp_extract(last, narrated, 1))).otherwise(last)
        return bound(F.struct(has.alias("has"), name.alias("name")), lambda named: by_name(last, named))

    return F.when(n > 0, bound(F.trim(F.element_at(parts, -1)), by_last))


def split_title_by_author(c: Column) -> Column:
    """(title, author) of "Title by Author Name", or null where the end doesn't look like names."""
    shape = r"(?is)^(.*) by (.*?)$"
    title, author = tidy(F.regexp_extract(c, shape, 1)), tidy(F.regexp_extract(c, shape, 2))
    names = F.filter(F.transform(F.split(author, "[,&]"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: (w != "and") & (w != ""))
    good = lambda x: F.size(words(x)).between(2, 6) & F.forall(words(x), lambda w: w.rlike(r"^\p{Lu}")) & ~F.contains(x, F.lit(":"))
    return F.when(title.isNotNull() & author.isNotNull() & (F.size(names) > 0) & F.forall(names, good), F.struct(title.alias("title"), author.alias("author")))


def untangle_author(title: Column, author: Column) -> Column:
    """(title, author): taken apart where there is no author of its own."""
    real = author.isNotNull() & (ascii_lower(author) != ascii_lower(title))
    cut = split_title_by_author(title)
    whole = F.struct(title.alias("title"), author.alias("author"))
    return F.when(real, whole).otherwise(F.coalesce(cut, whole))


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value: each run without leading zeros behind its length, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def part(x):
        digits = F.ltrim(x, F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, part), "")


def genre_squash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}&]", ""))


def genre_values(c: Column) -> Column:
    """The values of a raw genre tag; none for a web address."""
    cut = F.filter(F.transform(F.split(c, r"[/;|,]| - "), lambda x: F.trim(x)), lambda x: x != "")
    url = F.contains(F.lower(c), F.lit("://")) | F.ltrim(F.lower(c)).startswith("www.")
    return F.when(url, F.array().cast("array<string>")).otherwise(cut)


def genre_clean(c: Column) -> Column:
    """Bracketed parts of any depth removed, dots and underscores read as spaces, white space collapsed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc, x):
        opens, closes = x.isin("(", "["), x.isin(")", "]")
        kept = F.when(x.isin(".", "_"), F.lit(" ")).otherwise(x)
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.when(opens | closes | (acc["depth"] > 0), acc["out"]).otherwise(F.concat(acc["out"], kept)).alias("out"))

    plain = F.translate(c, "._", "  ")
    deep = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["out"])
    return F.trim(F.regexp_replace(F.when(c.rlike(r"[()\[\]]"), deep).otherwise(plain), r"\s+", " "))


def genre_is_junk(key: Column) -> Column:
    return key.rlike(r"^$|^[0-9]+$|^genre[0-9]+$")


def genre_display(cleaned: Column) -> Column:
    """Title case for a value without capitals, else as it is."""
    words = F.transform(F.split(cleaned, " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2), F.length(w))))
    return F.when(cleaned.rlike(r"\p{Lu}"), cleaned).otherwise(F.array_join(words, " "))


def genre_words(cleaned: Column) -> Column:
    """Squashed words, then adjoining pairs: what keywords are looked up by."""
    words = F.filter(F.transform(F.split(cleaned, "[ -]"), lambda w: genre_squash(w)), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)
