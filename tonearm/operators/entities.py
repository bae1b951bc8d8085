"""Duplicates, entity resolution, search, fuzzy matching, genres, playlists and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import names

from . import fuzzy, textindex
from .changes import really_changed
from .ordering import cut, numbered


def duplicate_keepers(tracks: DataFrame, keys: list[str], id_col: str, present: Column | None = None) -> DataFrame:
    """``duplicate_of``: the least id of present rows with the same non-null keys; null for the keeper and for all others."""
    ok = present if present is not None else F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    keepers = tracks.where(ok).groupBy(*keys).agg(F.min(id_col).alias("__keep"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = tracks.join(keepers, keys, "left")
    return joined.withColumn("duplicate_of", F.when(ok & (F.col("__keep") != F.col(id_col)), F.col("__keep"))).drop("__keep")


def size_collisions(books: DataFrame, size: str) -> DataFrame:
    """Rows whose size another row has: only these need hashing."""
    return books.join(books.groupBy(size).count().where("count > 1").select(size), size, "left_semi")


def book_duplicates(parts: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, duplicate_of: books with equal ordered lists of part hashes; the last played one stays, then the least id.

    ``parts``: book_id, part_index, hash.  A book with an unhashed part is left alone.
    """
    item = F.struct("part_index", "hash")
    lists = parts.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("p"), F.max(F.col("hash").isNull()).alias("open")).where("NOT open")
    keyed = lists.select("book_id", F.sha2(F.to_json(F.col("p.hash")), 256).alias("k")).join(books, "book_id")
    best = Window.partitionBy("k").orderBy(F.desc_nulls_last("last_played"), "book_id")
    ranked = keyed.withColumn("r", F.row_number().over(best)).withColumn("keep", F.first("book_id").over(best))
    return ranked.where("r > 1").select("book_id", F.col("keep").alias("duplicate_of"))


def consolidated(albums: DataFrame, tracks: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(album_id, survivor): albums joined through (title key, artist key) or (title key, folder); the least id survives.

    ``albums``: id, title_key, artist_key; ``tracks``: album_id, folder.  Albums without tracks are left out.
    Each round lowers labels through shared keys and is stored, until nothing changes; an error if ``most_rounds`` don't suffice.
    """
    live = albums.join(tracks.select(F.col("album_id").alias("id")).distinct(), "id", "left_semi")
    by_artist = live.select("id", F.concat_ws("\x1f", F.lit("a"), "title_key", F.coalesce("artist_key", F.lit(""))).alias("k"))
    by_folder = live.join(tracks.select(F.col("album_id").alias("id"), "folder").where("folder IS NOT NULL").distinct(), "id").select("id", F.concat_ws("\x1f", F.lit("f"), "title_key", "folder").alias("k"))
    links = by_artist.unionByName(by_folder).distinct().persist()
    label = live.select("id", F.col("id").alias("root"))
    for _ in range(most_rounds):
        least = links.join(label, "id").groupBy("k").agg(F.min("root").alias("m"))
        new = links.join(least, "k").groupBy("id").agg(F.min("m").alias("root"))
        new = new.join(new.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = cut(new)
        moved = new.join(label.withColumnRenamed("root", "old"), "id").where("root <> old").isEmpty()
        label = new
        if moved:
            break
    else:
        raise RuntimeError(f"labels don't settle in {most_rounds} rounds")
    links.unpersist()
    return label.select(F.col("id").alias("album_id"), F.col("root").alias("survivor"))


def merged_fields(albums: DataFrame, survivors: DataFrame, columns: list[str], various: str = "Various Artists") -> DataFrame:
    """One row per survivor: each column's first non-null value by id; artists that differ become ``various``."""
    rows = albums.withColumnRenamed("id", "album_id").join(survivors, "album_id")
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("album_id"))).alias(c) for c in columns]
    differ = F.count_distinct(names.group_key(F.col("artist"))) > 1
    return rows.groupBy(F.col("survivor").alias("id")).agg(*first, F.when(differ, F.lit(various)).otherwise(F.min_by("artist", F.when(F.col("artist").isNotNull(), F.col("album_id")))).alias("artist"))


def resolved_album(files: DataFrame, albums: DataFrame, various: str = "Various Artists") -> DataFrame:
    """path, album_id, rule: by album artist, else same folder, else track artist, else the various-artists album; null and "new" if none.

    ``files``: path, folder, title_key, album_artist_key, artist_key; ``albums``: id, title_key, artist_key, folder.  Each rule has an
    equi-join on its whole key against the least album of that key, so a title that many albums share makes no pairs.
    """
    least = lambda c, where, out: albums.where(where).groupBy("title_key", F.col(c).alias(f"__{c}")).agg(F.min("id").alias(out))
    own = F.coalesce("album_artist_key", "artist_key")
    found = files.withColumn("__artist_key", own).withColumn("__folder", F.col("folder"))
    found = found.join(least("artist_key", F.col("artist_key").isNotNull(), "__by_artist"), ["title_key", "__artist_key"], "left")
    found = found.join(least("folder", F.col("folder").isNotNull(), "__by_folder"), ["title_key", "__folder"], "left")
    mixed = albums.where(F.col("artist_key") == various.lower()).groupBy("title_key").agg(F.min("id").alias("__mixed"))
    found = found.join(mixed, "title_key", "left")
    tagged = F.col("album_artist_key").isNotNull()
    rules = [("album_artist", tagged, "__by_artist"), ("folder", ~tagged, "__by_folder"), ("artist", ~tagged, "__by_artist"), ("various", ~tagged, "__mixed")]
    album = F.coalesce(*[F.when(when, F.col(c)) for _, when, c in rules])
    rule = F.coalesce(*[F.when(when & F.col(c).isNotNull(), name) for name, when, c in rules], F.lit("new"))
    return found.select("path", album.alias("album_id"), rule.alias("rule"))


def search(index: textindex.TextIndex, docs: DataFrame, query: str, id_col: str, keep: Column | None = None, most: int | None = 50) -> DataFrame:
    """Ids and ranks of a prefix search, best first; cut to ``most`` and only then filtered by ``keep`` over ``docs``."""
    top = textindex.search(index, query, most).withColumnRenamed("id", id_col)
    return top.join(docs.where(keep).select(id_col), id_col, "left_semi") if keep is not None else top


def release_confidence(title: Column, artist: Column, count: Column, c_title: Column, c_artist: Column, c_count: Column, c_score: Column) -> Column:
    """0.35 title + 0.25 artist + 0.25 track count + 0.15 the source's score; missing evidence counts a half."""
    t = names.similarity(names.group_key(title), names.group_key(c_title))
    a = F.when(F.coalesce(F.trim(artist), F.lit("")) != "", names.similarity(names.group_key(artist), names.group_key(F.coalesce(c_artist, F.lit(""))))).otherwise(0.5)
    known = (c_count > 0) & (count > 0)
    n = F.when(known, F.least(count, c_count) / F.greatest(count, c_count)).otherwise(0.5)
    return (0.35 * t + 0.25 * a + 0.25 * n + 0.15 * (c_score / 100.0)).cast("float")


def book_confidence(title: Column, author: Column, c_title: Column, c_authors: Column) -> Column:
    """Title similarity; the author, where known, must agree (by distance or by shared words), else 0.9."""
    t = names.similarity(names.group_key(names.main_title(title)), names.group_key(names.main_title(c_title)))
    a = names.group_key(author)
    fit = F.transform(c_authors, lambda x: F.greatest(names.similarity(a, names.group_key(x)), names.word_overlap(a, names.group_key(x))))
    best = F.least(F.array_max(fit), F.lit(1.0))
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(F.size(c_authors), F.lit(0)) > 0)
    return (t * F.when(known, 0.4 + 0.6 * best).otherwise(0.9)).cast("float")


def matched_books(books: DataFrame, catalogue: DataFrame, least: float = 0.8) -> DataFrame:
    """book_id, position and confidence of each book's surest match in a catalogue; of equals the last position.

    ``books``: book_id, title, author; ``catalogue``: position, title, authors.  A confidence never exceeds the similarity of
    main titles, so only titles that the segment index finds ``least`` alike are compared.  Books of equal title and author are matched once.
    """
    key = names.group_key(names.main_title(F.col("title")))
    asked = books.withColumn("key", key).groupBy("key", "author").agg(F.min("title").alias("title"))
    offered = catalogue.withColumn("key", key).groupBy("key", "authors").agg(F.max("position").alias("position"), F.min("title").alias("c_title"))
    pairs = cut(fuzzy.similar(asked.select(F.col("key").alias("text")), offered.select(F.col("key").alias("text")), least).select(F.col("a").alias("key"), F.col("b").alias("c_key")))
    met = asked.join(pairs, "key").join(offered.withColumnRenamed("key", "c_key"), "c_key")
    sure = met.withColumn("confidence", book_confidence(F.col("title"), F.col("author"), F.col("c_title"), F.col("authors"))).where(F.col("confidence") >= F.lit(least).cast("float"))
    best = sure.groupBy("key", "author").agg(F.max(F.struct("confidence", "position")).alias("m"))
    named = books.withColumn("key", key).alias("x").join(best.alias("y"), (F.col("x.key") == F.col("y.key")) & F.col("x.author").eqNullSafe(F.col("y.author")))
    return named.select("x.book_id", "m.position", "m.confidence")


def best_match(candidates: DataFrame, key: str, confidence: Column, position: str, least: float) -> DataFrame:
    """Per key the surest candidate at or above ``least``; of equals the last one offered."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc(position))
    return candidates.withColumn("confidence", confidence).where(F.col("confidence") >= F.lit(least).cast("float")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def genre_map(raws: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """raw, genre, how of each distinct raw tag. ``aliases``: key, genre; ``keywords``: word, genre.

    Works on distinct raw tags, so the lookups stay small however many tracks there are.
    """
    values = raws.select("raw").distinct().select("raw", F.posexplode(names.genre_values(F.col("raw"))).alias("i", "v"))
    cleaned = values.select("raw", "i", names.genre_clean(F.col("v")).alias("clean")).withColumn("key", names.genre_squash(F.col("clean"))).where(~names.genre_is_junk(F.col("key")))
    by_alias = cleaned.join(aliases.withColumnRenamed("genre", "g"), "key", "left")
    alias = by_alias.where("g IS NOT NULL").select("raw", "i", F.lit(0).alias("j"), F.col("g").alias("genre"), F.lit("alias").alias("how"))
    rest = by_alias.where("g IS NULL").select("raw", "i", "clean")
    words = rest.select("raw", "i", "clean", F.posexplode_outer(names.genre_words(F.col("clean"))).alias("j", "word"))
    found = words.join(keywords.withColumnRenamed("genre", "g"), "word", "left")
    keyword = found.where("g IS NOT NULL").select("raw", "i", "j", F.col("g").alias("genre"), F.lit("keyword").alias("how"))
    none = found.groupBy("raw", "i", "clean").agg(F.count("g").alias("n")).where("n = 0").select("raw", "i", F.lit(0).alias("j"), names.genre_display(F.col("clean")).alias("genre"), F.lit("unmapped").alias("how"))
    every = alias.unionByName(keyword).unionByName(none)
    return every.groupBy("raw", "genre").agg(F.min_by("how", F.struct("i", "j")).alias("how"), F.min(F.struct("i", "j")).alias("at"))


def track_genres(tracks: DataFrame, mapped: DataFrame) -> DataFrame:
    """(id, genre) links of present tracks that aren't copies. ``tracks``: id, raw, missing, duplicate_of."""
    live = tracks.where(~F.col("missing") & F.col("duplicate_of").isNull())
    return live.select("id", "raw").join(mapped.select("raw", "genre"), "raw").select("id", "genre").distinct()


def genre_report(tracks: DataFrame, mapped: DataFrame, how: str, most: int = 200) -> DataFrame:
    """The most frequent raw tags found by one way, with their genres ("ignored": tags that gave none)."""
    counts = tracks.where(~F.col("missing") & F.col("raw").isNotNull()).groupBy("raw").count()
    lists = mapped.groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "genre", "how"))), lambda x: x["genre"]).alias("genres"), F.max("how").alias("how"))
    joined = counts.join(lists, "raw", "left").withColumn("how", F.coalesce("how", F.lit("ignored")))
    return joined.where(F.col("how") == how).select("raw", "count", F.coalesce("genres", F.array().cast("array<string>")).alias("genres")).orderBy(F.desc("count"), "raw").limit(most)


def playlist_import(entries: DataFrame, roots: list[str], tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched entries with dense positions, unmatched ones)."""
    from .relational import best_path_match

    found = best_path_match(entries, roots, tracks)
    matched = found.where("track_id IS NOT NULL")
    return numbered(matched, ["pos"], "position").select("position", "track_id"), found.where("track_id IS NULL").select("pos", "raw")


def created_playlist(playlists: DataFrame, entries: DataFrame, name: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists (id, name) and entries (playlist_id, position, track_id) with a new one of the given items (ord, track_id)."""
    new = (playlists.agg(F.max("id")).first()[0] or 0) + 1
    spark = playlists.sparkSession
    own = numbered(items.select("ord", "track_id"), ["ord", "track_id"], "position").select(F.lit(new).cast("long").alias("playlist_id"), "position", "track_id")
    return playlists.unionByName(spark.createDataFrame([(new, name)], "id long, name string")), entries.unionByName(own)


def renamed_playlist(playlists: DataFrame, playlist: int, name: str) -> DataFrame:
    """The name without white space around it; an empty one, or a playlist that isn't there, is an error."""
    name = name.strip()
    if not name:
        raise ValueError("playlist name must not be empty")
    if playlists.where(F.col("id") == playlist).isEmpty():
        raise KeyError(f"playlist {playlist}")
    return playlists.withColumn("name", F.when(F.col("id") == playlist, name).otherwise(F.col("name")))


def refreshed_keys(albums: DataFrame) -> DataFrame:
    """id, title_key and artist_key of albums whose stored keys aren't those of their names; all others need no write."""
    now = albums.select("id", names.group_key(F.col("title")).alias("title_key"), names.group_key(F.col("artist")).alias("artist_key"))
    return really_changed(albums.select("id", "title_key", "artist_key"), now, "id", ["title_key", "artist_key"])


def appended(playlist: DataFrame, items: DataFrame) -> DataFrame:
    """Playlist rows (playlist_id, position, track_id) with items (playlist_id, ord, track_id) after them, positions dense from 0."""
    both = playlist.select("playlist_id", F.lit(0).alias("s"), F.col("position").alias("o"), "track_id").unionByName(items.select("playlist_id", F.lit(1).alias("s"), F.col("ord").alias("o"), "track_id"))
    return both.select("playlist_id", (F.row_number().over(Window.partitionBy("playlist_id").orderBy("s", "o", "track_id")) - 1).alias("position"), "track_id")


def _repositioned(queue: DataFrame, key: Column) -> DataFrame:
    return queue.withColumn("__k", key).withColumn("position", F.row_number().over(Window.partitionBy("queue_id").orderBy("__k", "position")) - 1).drop("__k")


def queue_inserted(queue: DataFrame, items: DataFrame, at: int) -> DataFrame:
    """Items (queue_id, ord, track_id) before position ``at`` of each queue (queue_id, position, track_id)."""
    old = queue.select("queue_id", "position", "track_id", F.when(F.col("position") < at, 0).otherwise(2).alias("g"))
    new = items.select("queue_id", F.col("ord").alias("position"), "track_id", F.lit(1).alias("g"))
    return _repositioned(old.unionByName(new), F.col("g")).drop("g")


def queue_moved(queue: DataFrame, source: int, target: int) -> DataFrame:
    """The item at ``source`` ends up at ``target``."""
    p = F.col("position")
    key = F.when(p == source, target + (0.5 if target > source else -0.5)).otherwise(p.cast("double"))
    return _repositioned(queue, key)


def queue_removed(queue: DataFrame, at: int) -> DataFrame:
    return _repositioned(queue.where(F.col("position") != at), F.lit(0))
