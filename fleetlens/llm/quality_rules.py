"""Line-first quality rules.

Each line of a text is judged on its own (punctuation, navigation, boilerplate,
symbols, repetition); failing lines are removed, and a document that loses too
much of its text that way, or fails the base rules, is rejected. Everything is
in-row SQL: no shuffle, no Python.

Edge cases: NULL and empty texts have no words, fail the base rules and clean to
''. Other columns are ignored, repeated rows are judged alike, an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_chars_in, n_word_chars, n_words_of, words_of

SYMBOLS = "#*$%&|<>"
#: Marks that stand between the entries of a navigation line.
NAVIGATION_MARKS = "|>»·"
#: Marks that can end a sentence or a quoted or listed one.
END_MARKS = ".!?…:;\"')]»”’。！？"
#: Phrases of page furniture (lower case).
BOILERPLATE = (
    "lorem ipsum",
    "enable javascript",
    "javascript is disabled",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "all rights reserved",
    "click here",
    "read more",
    "sign in",
    "log in",
    "sign up",
    "subscribe to our",
    "share this",
    "follow us on",
    "skip to content",
    "back to top",
    "powered by",
)


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails when more than this share of its tokens are navigation marks.
    max_navigation_percent: int = 25
    #: A line fails when more than this share of its characters are symbols.
    max_symbol_percent: int = 20
    #: A line without an end mark fails when it has fewer words than this.
    min_fragment_words: int = 4
    #: A boilerplate phrase fails a line of at most this many words.
    max_boilerplate_words: int = 30
    #: A document is rejected when it loses more than this share of its characters.
    max_lost_percent: int = 40


def n_repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    ``hashes`` has a 64-bit hash of each window. Only where two are equal are
    they sorted together with their positions, so equal windows are
    neighbours, and compared word by word: n log n in one row, no shuffle."""

    def same(x: Column, y: Column) -> Column:
        return (
            (x["h"] == y["h"])
            & (words[x["i"]] == words[y["i"]])
            & (words[x["i"] + 1] == words[y["i"] + 1])
            & (words[x["i"] + 2] == words[y["i"] + 2])
        )

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: F.coalesce(((k > 0) & same(x, F.get(s, k - 1))) | same(x, F.get(s, k + 1)), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # array(x) -> transform binds the sorted windows to one variable
    counted = F.transform(F.array(placed), repeated)[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted).cast("long")


def _has_boilerplate(lower_text: Column) -> Column:
    found = lower_text.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        found = found | lower_text.contains(phrase)
    return found


def _line_fails(line: Column, n_words: Column, text_has_phrase: Column, cfg: QualityConfig) -> Column:
    marks = n_chars_in(line, NAVIGATION_MARKS)
    tokens = F.greatest(n_words, F.lit(1))
    chars = n_word_chars(line)
    phrase = text_has_phrase & _has_boilerplate(F.lower(line))
    no_end = ~F.substring(F.rtrim(line), -1, 1).isin(list(END_MARKS))
    return (
        (marks * 100 > tokens * cfg.max_navigation_percent)
        | (n_chars_in(line, SYMBOLS) * 100 > chars * cfg.max_symbol_percent)
        | (no_end & (n_words < cfg.min_fragment_words))
        | (phrase & (n_words <= cfg.max_boilerplate_words))
    )


def quality_rules(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` columns, the base counts, ``base_failed``,
    ``kept``, ``n_lines`` (lines with a word), ``n_lines_removed``,
    ``lost_chars`` and ``clean_text`` (the lines that pass, joined by a newline)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*[F.col(c) for c in keep], text.alias("_text"))
    d = d.withColumn("_words", words_of(F.col("_text")))
    t, words, n = F.col("_text"), F.col("_words"), F.size("_words")
    d = d.withColumn("_lower", F.lower("_text"))
    windows = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    d = d.withColumn("_hashes", F.transform(windows, lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2])))
    d = d.select(
        *keep,
        "_text",
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        _has_boilerplate(F.col("_lower")).alias("_phrase"),
        n.cast("long").alias("n_words"),
        n_word_chars(t).alias("word_chars"),
        n_chars_in(t, SYMBOLS).alias("n_symbols"),
        n_repeat_words(words, F.col("_hashes")).alias("n_repeat_words"),
    )
    lines = F.col("_lines")
    d = d.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(lines).cast("long").alias("n_lines"),
        # the first of equal lines stays, later ones are boilerplate
        F.filter(
            F.transform(F.array_distinct(lines), lambda x: F.struct(x.alias("line"), n_words_of(x).alias("n"))),
            lambda x: ~_line_fails(x["line"], x["n"], F.col("_phrase"), cfg),
        )["line"].alias("_good"),
    )
    base_failed = (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words"))
    left = n_word_chars(F.array_join("_good", "\n"))
    d = d.withColumns({"base_failed": base_failed, "lost_chars": (F.col("word_chars") - left).cast("long")})
    return d.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * cfg.max_lost_percent)).alias("kept"),
        "n_lines",
        (F.col("n_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
        "lost_chars",
        F.array_join("_good", "\n").alias("clean_text"),
    )


def keep_documents(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Pipeline form: rejected documents go, kept ones continue with their
    cleaned text, in the columns of ``docs`` (``n_chars`` follows the text). The
    written verdicts (``_llm_reads``) may be discarded once the result is written."""
    columns = docs.columns
    # the row travels as a struct, so its columns cannot clash with those made
    # here; verdicts are written before they are filtered on, as a filter would
    # be pushed below the projections and repeat their work
    judged = materialize(quality_rules(docs.select(F.struct(*columns).alias("_row"), "text"), cfg, keep=("_row",)), "judged")
    out = {c: F.col("_row").getField(c).alias(c) for c in columns}
    out["text"] = F.col("clean_text").alias("text")
    if "n_chars" in columns:
        out["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    kept = judged.filter("kept").select(*[out[c] for c in columns])
    kept._llm_reads = judged
    return kept
