"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules, which look at its shape and at fixed phrases:

* symbols: three or more of ``#*$%&<>`` (or of ``!``) that are over an eighth of its characters;
* separators: items between ``| · • » ›`` or lone ``>``, of three words or fewer on average (a leading bullet is none);
* titles: four words or more, four in five of them capitalised, and no mark of a sentence at the end;
* openings: two to six words without such a mark, and four lines of the document begin with the same two words;
* stutter: a third of its four or more words repeat the word before;
* boilerplate: phrases of licences, rights, cookies and sign-ups in four languages, and dated copyright lines.

Failing lines go; a document that loses more than ``max_lost`` of its characters is rejected, as is one that fails the
base rules (too few words, or too many words in repeated five-word windows).

Nulls and empty texts have no words: all counts are 0 and they are rejected. Repeated rows are judged alike, each on
its own. Very long texts are judged whole, in one row. An empty table gives an empty result. Other columns pass through
``apply_quality_rules`` untouched; columns that have the names of its outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, let, words_of

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "uses cookies", "use of cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our",
    "sign up for", "click here", "skip to content", "powered by",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "verwendet cookies", "verwendung von cookies", "newsletter abonnieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "bajo la licencia", "condiciones de uso", "política de privacidad", "utiliza cookies", "uso de cookies", "haga clic aquí", "ir al contenido",
)
COPYRIGHT = r"^[^a-zA-Z0-9]*(?:[cC][oO][pP][yY][rR][iI][gG][hH][tT]|©|\([cC]\)).*(?:19|20)[0-9][0-9]"
#: A word that follows itself.
TWICE = r"(?:^|[ \x09-\x0D])([^ \x09-\x0D]++)[ \x09-\x0D]++\1(?![^ \x09-\x0D])"
SEPARATORS = "|·•»›"
END_MARKS = ".!?…:;,。！？)]\"'”’»"
#: Pieces of the phrases: every phrase has one.
STEMS = (
    "cookie", "licen", "lizenz", "terms of", "privac", "javascript", "reserv", "réserv", "vorbehalten", "lorem ipsum", "subscribe to", "sign up for", "click here", "skip to c", "powered by",
    "nutzungsbed", "newsletter ab", "hier klicken", "zum inhalt", "conditions d'", "confidentialit", "cliquez", "aller au c", "condiciones de", "haga clic", "ir al cont",
)
SYMBOLS = "#*$%&|<>"
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share", "clean_text")


def count_of(line: Column, chars: str) -> Column:
    """How many characters of the regex class ``chars`` the line has."""
    return F.length(F.regexp_replace(line, f"[^{chars}]+", ""))


def line_fails(line: Column, phrases: Column | None = None) -> Column:
    """Whether a line is navigation, boilerplate, or mostly punctuation; ``phrases``: whether its document has one at all.

    What a rule cannot do without is looked for first, so that few lines are counted or cut into words.
    """
    dense = lambda n: (n >= 3) & (8 * n > F.length(line))
    only = lambda needed, rule: F.when(needed, rule).otherwise(F.lit(False))
    boilerplate = only(has_phrase(line) if phrases is None else phrases, F.lower(line).rlike("|".join(BOILERPLATE)))
    return (
        only(line.rlike("[#*$%&<>!]"), dense(count_of(line, "#*$%&<>")) | dense(count_of(line, "!")))
        | only(line.rlike(f"[{SEPARATORS}>]"), separated(line))
        | boilerplate
        | line.rlike(COPYRIGHT)
        | only(~ended(line), let(words_of(line), titled))
        | only(line.rlike(TWICE), let(words_of(line), stutters))
    )


def has_phrase(text: Column) -> Column:
    """Whether a piece of a boilerplate phrase occurs anywhere in the text."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in STEMS]))


def ended(line: Column) -> Column:
    """Whether the line ends with the mark of a sentence or a part of one."""
    return let(F.rtrim(line, F.lit(WHITE)), lambda x: reduce(lambda a, b: a | b, [x.endswith(m) for m in END_MARKS]))


def separated(line: Column) -> Column:
    """Short items between separators."""
    bare = F.regexp_replace(line, f"^[ \\x09-\\x0D>{SEPARATORS}]+", "")
    bare = F.regexp_replace(bare, r"[ \x09-\x0D]>(?=[ \x09-\x0D])", " |")
    marks = count_of(bare, SEPARATORS)
    words = F.size(words_of(F.translate(bare, SEPARATORS, " " * len(SEPARATORS))))
    return F.when(bare.rlike(f"[{SEPARATORS}]"), words <= 3 * (marks + 1)).otherwise(F.lit(False))


def titled(words: Column) -> Column:
    """Capitalised words."""
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(words) >= 4) & (5 * capitals >= 4 * F.size(words))


def stutters(words: Column) -> Column:
    """A third of the words repeat the one before."""
    again = F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))
    return (F.size(words) >= 4) & (3 * F.size(again) >= F.size(words))


def without_openings(lines: Column) -> Column:
    """The lines but for short unfinished ones of which four or more begin with the same two words."""

    def opening(line: Column) -> Column:
        of = lambda w: F.when(F.size(w).between(2, 6), F.concat(w[0], F.lit(" "), w[1]))
        return F.when(~ended(line), let(words_of(line), of))

    def rest(pairs: Column) -> Column:
        near = lambda j, a: F.get(pairs, j + a)["o"]
        four = lambda p, j: F.coalesce(near(j, -3) == p["o"], F.lit(False)) | F.coalesce(near(j, -2) == near(j, 1), F.lit(False)) | F.coalesce(near(j, -1) == near(j, 2), F.lit(False)) | F.coalesce(near(j, 3) == p["o"], F.lit(False))
        bad = F.transform(F.filter(pairs, four), lambda p: p["i"])
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), bad), lambda i: F.get(lines, i))

    pairs = F.filter(F.transform(lines, lambda x, i: F.struct(opening(x).alias("o"), i.alias("i"))), lambda p: p["o"].isNotNull())
    return F.when(F.size(lines) < 4, lines).otherwise(let(F.sort_array(pairs), lambda p: F.when(F.size(p) < 4, lines).otherwise(rest(p))))


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hashes of their word hashes. Only a text that has a repeat sorts its windows.
    """
    zero = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        def starts(pairs: Column) -> Column:
            twin = lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"])
            return F.sort_array(F.transform(F.filter(pairs, lambda p, j: F.coalesce(twin(p, j), F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False))), lambda p: p["i"]))

        def spread(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - p, F.lit(5))))
            return F.aggregate(steps, zero, lambda a, x: a + x)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(starts(p), spread))

    def judged(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 5)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(5)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(zero))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 6, zero).otherwise(judged(h)))


def apply_quality_rules(df: DataFrame, text: str = "text", max_lost: float = 0.3) -> DataFrame:
    """Add the base counts, ``base_failed``, ``lost_share``, ``clean_text`` and ``kept`` to every row of ``df``."""
    df = df.select("*") if not (clash := [c for c in OUTPUTS if c in df.columns]) else df.drop(*clash)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WHITE_CLASS.replace("[", "[^")))
    df = df.withColumn("__words", words_of(F.col(text))).withColumn("__lines", lines)
    # bound values, so that no rewriting of the plan moves a document's work into the loop over its lines
    good = lambda ls: let(has_phrase(body), lambda phrases: F.filter(without_openings(ls), lambda x: ~line_fails(x, phrases)))
    df = df.withColumn("__good", let(F.col("__lines"), good))
    size = lambda c: F.length(F.array_join(c, ""))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": size("__words").cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
        "lost_share": F.coalesce(F.try_divide(size("__lines") - size("__good"), size("__lines")), F.lit(0.0)),
        "clean_text": F.array_join("__good", "\n"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_share") <= max_lost))
    return df.drop("__words", "__lines", "__good")
