"""Benchmark decontamination: prefix-filtered set join of benchmark windows with documents, then exact containment.

A window is ``window`` consecutive words of an item (a shorter item is one window). It occurs in a document only if all
of its words do, so the one rarest word of a window is a sufficient prefix: a document without it cannot hold it.

1. Words of the benchmark are ordered by rarity: at how many word positions of all documents each occurs.
2. Every distinct window keeps its rarest word and that word's place in it (ties: the smallest word, the first place).
3. Document word positions meet windows on the prefix word. The place gives where the window would start; the length
   bound 0 <= start <= words - length must hold.
4. The window is compared exactly, word for word, with the document's words from that start on.

While the windows' size, which is checked, stays within a limit they are broadcast, and a position is compared where its
document is read: nothing but true occurrences is shuffled. Beyond the limit positions and windows meet in a shuffle, the
starts that remain come back to the documents by id and text hash, and the comparison is made there.

Cases: null text has no words; an item without words has no window; items with equal windows all count; rows that repeat
an id are matched row by row (told apart by a hash of the text); null ids of documents are allowed; an empty table of
documents gives an empty result and an empty benchmark clean documents; extra columns pass through
``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import BROADCAST_LIMIT, ascii_lower, materialize

# Fixed value: what separates words (every ASCII character other than digits and a-z, after lower-casing).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def item_words(text: Column) -> Column:
    """Words of ``text``: runs of digits, a-z (A-Z lower-cased) and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window_id, words, items): each distinct window with the items that have it."""
    split = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), item_words(F.col(f"`{text_col}`")).alias("ws"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    rows = split.filter(F.size("ws") > 0).select("item", "ws", F.explode(starts).alias("at")).select(
        "item", F.slice("ws", F.col("at"), F.lit(window)).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("words").alias("window_id"), "words", "items")


def _bounded(df: DataFrame, nbytes: int, limit: int) -> DataFrame:
    return F.broadcast(df) if nbytes <= limit else df


def _bytes(df: DataFrame, width: Column) -> int:
    return df.agg(F.sum(width)).first()[0] or 0


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(id, text_hash, hits): per document with occurring windows an array of (start, length, items), starts from 0."""
    benchmark = materialize(windows_of(items, item_id_col, item_text_col, window), "windows")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                         item_words(F.col(f"`{text_col}`")).alias("ws"))

    # 1. rarity of the benchmark's words over all documents
    vocabulary = materialize(benchmark.select(F.explode("words").alias("v")).distinct(), "vocabulary")
    known = _bounded(vocabulary, _bytes(vocabulary, F.octet_length("v") + 32), limit)
    # (outer: the filter on empty arrays that Spark adds otherwise would split every text twice)
    found = narrow.select(F.explode_outer("ws").alias("word")).join(known, F.col("word") == F.col("v"), "left_semi")
    counts = materialize(found.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences")), "rarity")

    # 2. the rarest word of each window, and its place
    placed = benchmark.select("window_id", "words", "items", F.posexplode("words").alias("place", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("window_id", "words", "items").agg(
        F.min(F.struct(F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "word", "place")).alias("prefix"))
    prefixes = ranked.filter(F.col("prefix.occurrences") > 0).select(
        "window_id", "words", "items", F.col("prefix.word").alias("prefix_word"), F.col("prefix.place").alias("place"))
    prefixes = materialize(prefixes, "prefixes")
    size = _bytes(prefixes, 2 * F.octet_length(F.array_join("words", " ")) + 32 * F.size("items") + 256)

    start = F.col("pos") - F.col("place")
    inside = (start >= 0) & (start <= F.size("ws") - F.size("words"))
    same = F.slice(F.col("ws"), start + 1, F.size("words")) == F.col("words")
    if size <= limit:  # 3 and 4 where the documents are read
        positions = narrow.select("id", "text_hash", "ws", F.posexplode_outer("ws").alias("pos", "word"))
        hits = positions.join(F.broadcast(prefixes), F.col("word") == F.col("prefix_word")).filter(inside & same).select(
            "id", "text_hash", F.struct(start.alias("start"), F.size("words").alias("length"), "items").alias("hit"))
        return hits.groupBy("id", "text_hash").agg(F.collect_set("hit").alias("hits"))

    positions = narrow.select("id", "text_hash", F.size("ws").alias("n"), F.posexplode_outer("ws").alias("pos", "word"))
    keys = prefixes.select("prefix_word", "window_id", "place", F.size("words").alias("length"))
    candidates = positions.join(keys, F.col("word") == F.col("prefix_word")).filter(
        (start >= 0) & (start <= F.col("n") - F.col("length"))).select("id", "text_hash", "window_id", start.alias("start"))
    tries = candidates.join(prefixes.select("window_id", "words", "items"), "window_id").groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("start", "words", "items")).alias("tries"))
    tries = materialize(tries.select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"), "tries"), "tries")
    joined = narrow.join(tries, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")))
    fits = lambda t: F.slice(F.col("ws"), t["start"] + 1, F.size(t["words"])) == t["words"]
    hits = F.transform(F.filter("tries", fits), lambda t: F.struct(
        t["start"].alias("start"), F.size(t["words"]).alias("length"), t["items"].alias("items")))
    return joined.select("id", "text_hash", hits.alias("hits")).filter(F.size("hits") > 0).distinct()


def covered(hits: Column) -> Column:
    """How many word positions the hits cover."""
    spans = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(spans))).cast("long")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per document: its id, n_words, n_hit (words inside an occurrence), the item ids found (sorted as strings)
    and contaminated."""
    found = materialize(matches(docs, items, id_col, text_col, item_id_col, item_text_col, window, limit), "matches")
    found = found.select(
        F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"), covered(F.col("hits")).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                       F.size(item_words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs."""
    found = matches(docs, items, id_col, text_col, item_id_col, item_text_col, window, limit)
    found = materialize(found.select(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash")).distinct(), "matched")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = (F.col("row")[id_col].eqNullSafe(F.col("m_id"))
          & (F.xxhash64(F.col("row")[text_col]) == F.col("m_hash")))
    out = rows.join(_bounded(found, found.count() * 48, limit), on, "left_anti")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
