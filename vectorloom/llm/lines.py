"""Line-first cleaning: rules per line, failing lines go, then losing documents go.

DataFrame functions only; the texts are neither shuffled nor exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of web page furniture, stand-alone separators, ends of sentences.
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "sign up", "subscribe to")
SEPARATORS = ("|", "\u00bb", "\u203a", "\u00b7", "\u2022", "::")
TERMINAL = tuple(".!?:;\"')]\u2026\u3002\uff01\uff1f\u2019\u201d\u00bb")
SYMBOLS = "[#*$%&|<>]"
BLANKS = "\t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row, however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column, size: int) -> Column:
    """Words inside runs of ``size`` words that stand twice or more in the array."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of_sorted(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i).getField("h") == x.h, F.lit(False))
        twice = F.transform(s, lambda x, k: F.when(F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1), x.i))
        return let(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), covered)

    def of_grams(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(grams, of_grams))

    return let(words, of_words)


def _count(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def line_fails(line: Column, text: Column) -> Column:
    """Whether a line (blanks as spaces) breaks the punctuation, navigation or boilerplate rule.

    Punctuation: it does not end like a sentence, or it has a run of symbols or a
    doubled mark for every second word.  Navigation: a separator stands alone for
    every sixth word.  Boilerplate: it holds a stock phrase of web pages.
    ``text`` says what the whole text holds at all (symbols, bars, doubled,
    stock), which spares most texts a look for it in every line.  A line without
    a word does not fail.
    """

    def of_trimmed(t: Column) -> Column:
        n = _count(t, " ") + 1
        doubled = F.when(text.doubled, F.regexp_count(t, F.lit("[!?]{2,}"))).otherwise(0)
        symbols = F.when(text.symbols, F.regexp_count(t, F.lit(SYMBOLS + "+"))).otherwise(0)
        noisy = F.when(text.doubled | text.symbols, 2 * (doubled + symbols) >= n).otherwise(False)
        bars = sum((_count(F.concat(F.lit(" "), t, F.lit(" ")), f" {c} ") for c in SEPARATORS), F.lit(0))
        barred = F.when(text.bars, 6 * bars >= n).otherwise(False)
        stock = F.when(text.stock, _any(F.lower(t), BOILERPLATE)).otherwise(False)
        return F.when(t == "", False).otherwise(~F.substring(t, -1, 1).isin(*TERMINAL) | noisy | barred | stock)

    return let(F.trim(line), of_trimmed)


def clean_lines(docs: DataFrame, max_lost_percent: int = 50, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Cleans every document by lines and says which documents stay.

    Returns per row: doc_id, text (without failing lines), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, lost_chars (of words in removed
    lines), base_failed and kept.  A document stays if base_failed is false and
    removed lines hold at most ``max_lost_percent`` of its word characters.

    A null or empty text has no words, so it fails.  Repeated rows give repeated
    results; a null doc_id stays; other columns are ignored; an empty table gives
    an empty result.  Lines without a word neither fail nor count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = text
    for c in BLANKS.replace("\n", ""):
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    ink = lambda line: F.length(F.replace(line, F.lit(" "), F.lit("")))
    staged = docs.select("doc_id", text.alias("text"), plain.alias("plain"), F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"))
    holds = F.struct(
        (F.col("n_symbols") > 0).alias("symbols"),
        _any(F.col("text"), SEPARATORS).alias("bars"),
        _any(F.col("text"), ("!!", "??", "!?", "?!")).alias("doubled"),
        _any(F.lower("text"), BOILERPLATE).alias("stock"),
    )
    flat = F.replace(F.col("plain"), F.lit("\n"), F.lit(" "))
    words = F.filter(F.split(flat, " "), lambda w: w != "")

    def of_lines(lines: Column) -> Column:
        marked = let(holds, lambda h: F.transform(lines, lambda x: line_fails(x, h)))

        def result(fails: Column) -> Column:
            raw = F.split(F.col("text"), "\n")
            some = F.array_contains(fails, True)
            rest = let(raw, lambda r: F.array_join(F.filter(r, lambda _, i: ~F.get(fails, i)), "\n"))
            lost = F.aggregate(F.filter(lines, lambda _, i: F.get(fails, i)), F.lit(0), lambda a, x: a + ink(x))
            solid = let(raw, lambda r: F.filter(r, lambda _, i: F.trim(F.get(lines, i)) != ""))
            return F.struct(
                F.when(some, rest).otherwise(F.col("text")).alias("text"),
                F.when(some, lost).otherwise(0).cast("bigint").alias("lost"),
                let(solid, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("dups"),
            )

        return let(marked, result)

    counted = staged.select(
        "doc_id",
        "n_symbols",
        let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w, 5).alias("repeats"))).alias("w"),
        let(F.split(F.col("plain"), "\n"), of_lines).alias("l"),
        ink(flat).cast("bigint").alias("word_chars"),
    )
    n, repeats = F.col("w.n").cast("bigint"), F.col("w.repeats").cast("bigint")
    failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
    return counted.select(
        "doc_id",
        F.col("l.text").alias("text"),
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dups").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.col("l.lost").alias("lost_chars"),
        failed.alias("base_failed"),
        (~failed & (100 * F.col("l.lost") <= max_lost_percent * F.col("word_chars"))).alias("kept"),
    )
