"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of 13 words has nine 5-word grams; the smallest of their hashes is its fingerprint, so an equal window has an
equal fingerprint: no shared span of 13 words is missed. Texts and benchmark items meet on distinct fingerprints.
In the texts that met one, each window with such a fingerprint is compared word by word with the items' windows, and
overlapping hits extend to maximal spans. Up to ``BROADCAST_ROWS`` distinct fingerprints (counted first) are broadcast, and
a text's fingerprints then carry the words of their windows, so that no text is shuffled; more are joined by a shuffle of
fingerprints, and only the texts that met one are read again. Benchmark items of fewer words are one window; their fingerprint is the
smallest word hash. One pass over the texts winnows for all lengths that occur (12 short ones at most).

Nulls and texts without words have no windows: counts of 0, not contaminated. Repeated benchmark items all count; repeated
text rows need distinct ids to be told apart. Texts of any length are read whole: over ``LONG`` bytes in pieces of
``PIECE`` words, each with the words of the next that its last windows reach into, as the arrays of a run's words take
about a kilobyte a word. An empty benchmark or an empty text table gives clean or no rows. Columns named like an output are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored

WINDOW, GRAM = 13, 5
BROADCAST_ROWS = 500_000
#: Bytes of text that are winnowed at once, and the words of a piece of a longer one.
LONG, PIECE = 65_536, 4096
#: The characters of words in a text of any case, and those between them.
IN, OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")


def item_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def words_up_to(n: int) -> str:
    """A pattern for ``n`` words, or as many as follow: from a word to a word, possessive, so that no stack grows."""
    return f"{IN}++(?:{OUT}++{IN}++){{0,{n - 1}}}+"


def pieces_of(text: Column) -> Column:
    """The text in an array, or the pieces of ``PIECE`` words (the last may have fewer) of a long one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) <= LONG, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(words_up_to(PIECE)), F.lit(0)))


def count_words(text: Column) -> Column:
    last = lambda p: F.coalesce(F.size(item_words(F.get(p, F.size(p) - 1))), F.lit(0))
    return let(pieces_of(text), lambda p: F.greatest(F.size(p) - 1, F.lit(0)).cast("long") * PIECE + last(p))


def in_pieces(docs: DataFrame) -> DataFrame:
    """Rows (__id, k, __t) of the pieces of texts, each with the ``WINDOW`` - 1 words that follow; word i of piece k is word k * ``PIECE`` + i of the text."""
    each = docs.select("__id", F.posexplode(let(pieces_of(F.col("__t")), lambda p: F.transform(p, lambda x, k: F.struct(x.alias("own"), F.get(p, k + 1).alias("next"))))).alias("k", "x"))
    head = F.regexp_extract(F.coalesce("x.next", F.lit("")), "^" + words_up_to(WINDOW - 1), 0)
    return each.select("__id", "k", F.when(F.col("x.next").isNull(), F.col("x.own")).otherwise(F.concat_ws(" ", "x.own", head)).alias("__t"))


def fingerprints(words: Column, size: int, gram: int) -> Column:
    """The fingerprint of each window of ``size`` words, by its start: the smallest hash of its grams of ``gram`` words."""
    none = F.array().cast("array<bigint>")

    def grams(hashes: Column) -> Column:
        if gram == 1:
            return hashes
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - gram), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(gram)]))

    span = size - gram + 1
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*[F.get(g, i + j) for j in range(span)]) if span > 1 else F.get(g, i))
    return F.when(F.size(words) < size, none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), least)))


def window_text(words: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def windows_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each distinct window of the items: size, window, fingerprint and the items that have it."""
    items = benchmark.select(F.col(item_id).alias("item"), item_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    long_, short = items.where(F.size("w") >= WINDOW), items.where(F.size("w") < WINDOW)
    starts = long_.select("item", "w", F.posexplode(fingerprints(F.col("w"), WINDOW, GRAM)).alias("i", "fp"))
    rows = starts.select("item", F.lit(WINDOW).alias("size"), window_text(F.col("w"), F.col("i"), WINDOW).alias("window"), "fp")
    rest = short.select("item", size.alias("size"), F.array_join("w", " ").alias("window"), F.array_min(F.transform("w", lambda x: F.xxhash64(x))).alias("fp"))
    both = rows.unionByName(rest)
    return both.groupBy("size", "window", "fp").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))


def prints_of(words: Column, sizes: list[int]) -> Column:
    """Structs (size, fp, i) of all window sizes: where a fingerprint begins, or the windows that share one would outgrow a run."""

    def starts(prints: Column, size: int, gram: int) -> Column:
        span = size - gram + 1
        at = F.transform(prints, lambda f, i: F.when((i % span == 0) | (f != F.get(prints, i - 1)), F.struct(F.lit(size).alias("size"), f.alias("fp"), i.alias("i"))))
        return F.filter(at, lambda x: x.isNotNull())

    def of(n: int) -> Column:
        return let(fingerprints(words, n, gram_of(n)), lambda f: starts(f, n, gram_of(n)))

    return F.concat(*[of(n) for n in sizes])


def gram_of(size: int) -> int:
    return GRAM if size == WINDOW else 1


def windows_in(w: Column, size: Column, at: Column) -> Column:
    """The texts of the windows of ``size`` words that a run has, with their places; ``w``: the words of the run."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda j: F.struct((at + j).alias("i"), F.array_join(F.slice(w, j + 1, size), " ").alias("window")))


def run_words(words: Column, x: Column) -> Column:
    """The words of a run: its first window and those that may share its fingerprint."""
    span = x["size"] - F.when(x["size"] == WINDOW, GRAM).otherwise(1) + 1
    return F.slice(words, x["i"] + 1, x["size"] + span - 1)


def hits_by_broadcast(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Window starts that equal an item's window: (__id, i, n, items), from one pass over the texts. Fingerprints are broadcast."""
    rows = in_pieces(docs).select("__id", "k", item_words(F.col("__t")).alias("w"))
    cut = lambda w: F.transform(prints_of(w, sizes), lambda x: F.struct(x["size"].alias("size"), x["fp"].alias("fp"), x["i"].alias("i"), run_words(w, x).alias("w")))
    rows = rows.select("__id", "k", F.explode(let(F.col("w"), cut)).alias("x")).select("__id", "k", "x.*")
    met = rows.join(F.broadcast(windows.select("size", "fp").distinct()), ["size", "fp"], "left_semi")
    return equal_windows(met.withColumn("i", F.col("i") + F.col("k") * PIECE), windows)


def hits_by_shuffle(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """As ``hits_by_broadcast``, for fingerprints of any number: ids, places and fingerprints are shuffled, and only pieces that met one are tokenised again.

    Rows that share an id share their places: a place past the end of a shorter text has no window there.
    """
    pieces = in_pieces(docs)
    at = pieces.select("__id", "k", F.explode(let(item_words(F.col("__t")), lambda w: prints_of(w, sizes))).alias("x")).select("__id", "k", "x.*")
    met = at.join(windows.select("size", "fp").distinct(), ["size", "fp"], "left_semi").groupBy("__id", "k").agg(F.collect_list(F.struct("size", "i")).alias("at"))
    near = pieces.join(met, ["__id", "k"]).select("__id", "k", "at", item_words(F.col("__t")).alias("w"))
    cut = lambda w: F.transform("at", lambda x: F.struct(x["size"].alias("size"), (x["i"] + F.col("k") * PIECE).alias("i"), run_words(w, x).alias("w")))
    runs = near.select("__id", F.explode(let(F.col("w"), cut)).alias("x")).select("__id", "x.*")
    return equal_windows(runs.where(F.size("w") >= F.col("size")), windows)


def equal_windows(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows of runs (__id, size, i, w) that equal an item's, word by word."""
    cut = runs.select("__id", "size", F.explode(windows_in(F.col("w"), F.col("size"), F.col("i"))).alias("x"))
    hit = cut.select("__id", "size", "x.i", "x.window").join(windows.select("size", "window", "items"), ["size", "window"])
    return hit.select("__id", "i", F.col("size").alias("n"), "items").distinct()


def find_hits(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each text with a hit: its id, the maximal hit spans [(start, length)] in words, n_hit and the item ids."""
    windows = stored(windows_of(benchmark, item_id, item_text), "windows")
    counts = [(r[0], r[1]) for r in windows.groupBy("size").agg(F.countDistinct("fp")).collect()]  # 13 rows at most
    docs = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__id is not null")
    found = None
    if counts:
        way = hits_by_broadcast if sum(n for _, n in counts) <= broadcast_rows else hits_by_shuffle
        found = way(docs, windows, sorted(n for n, _ in counts))
    if found is None:
        found = docs.select("__id", F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items")).where("false")
    each = found.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("at"), F.collect_set("items").alias("sets"))
    grow = lambda runs, x: F.when(
        (F.size(runs) > 0) & (x["i"] <= F.element_at(runs, -1)["start"] + F.element_at(runs, -1)["length"]),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(F.element_at(runs, -1)["start"].alias("start"), F.greatest(F.element_at(runs, -1)["length"], x["i"] + x["n"] - F.element_at(runs, -1)["start"]).alias("length")))),
    ).otherwise(F.concat(runs, F.array(F.struct(x["i"].alias("start"), x["n"].alias("length")))))
    spans = F.aggregate("at", F.array().cast("array<struct<start:int,length:int>>"), grow)
    out = each.select(F.col("__id"), spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten("sets"))).alias("item_ids"))
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]))


def apply_decontamination(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", one_in: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add n_words, n_hit, n_items, item_ids, spans and contaminated (hit words are 1 in ``one_in`` at least) to every row."""
    df = df.drop(*OUTPUTS)
    hits = find_hits(df, benchmark, doc_id, text, item_id, item_text, broadcast_rows)
    df = df.withColumn("n_words", count_words(F.col(text)))
    out = df.join(hits.withColumnRenamed("__id", doc_id), doc_id, "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))})
    return out.withColumns({
        "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")),
    })
