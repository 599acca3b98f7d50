"""Quality rules, lines first: each line is judged by its punctuation, by the marks of navigation and by boilerplate
phrases; failing lines go, and a document that loses too much of its text goes with them.

DataFrame functions only, one pass over the scan, no shuffle.

Defined cases: a null text counts as empty and is not kept; a text without words has zeros everywhere; repeated rows are
judged once each; of equal lines all but the first are repeated, and lines fail or pass alike; texts of any length are judged whole, in one row; a text
that loses just MAX_LOST is kept; other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, let, words_by

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: Lines of no more words may lack a full stop at their end (titles, list items), and so may longer ones whose last stop stands behind their middle.
SHORT_LINE = 4
#: Share of a document's words that failing lines may take.
MAX_LOST = 0.5
BOILERPLATE = (
    r"(?i)\blicensed under\b|\ball rights reserved\b|\bcopyright\b|©|\bterms of (use|service)\b|\bprivacy policy\b"
    r"|\bcookies?\b|\bjavascript\b|\bsubscribe\b|\bsign (in|up)\b|\blog ?in\b|\bclick here\b|\bread more\b|\blorem ipsum\b"
)


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def occurrences(text: Column, mark: str) -> Column:
    """How often a mark of one or more characters stands in the text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first included."""
    n_windows = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        """found: the sorted starts of repeated windows. Each covers its window or up to the next start."""
        step = F.transform(found, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(found, i + 1), p + WINDOW) - p))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def starts(by_hash: Column) -> Column:
        """by_hash: (hash, start) sorted, so that equal windows are neighbours."""
        same = lambda i, j: F.coalesce(F.get(by_hash, i)["h"] == F.get(by_hash, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(by_hash, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["p"]))

    def some(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(starts(s), covered)))

    return F.when(n_windows >= 2, let(hashes, some)).otherwise(F.lit(0))


def bad_line(line: Column) -> Column:
    """Does the line fail a rule? Cheap tests stand first; the rest is evaluated only where they leave a doubt."""
    n_words = F.size(F.split(F.trim(line), BLANK))
    bars = occurrences(line, "|")
    navigation = (bars >= 2) & (bars * 5 >= n_words)
    symbols = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&<>]+", ""))
    symbolic = line.rlike(r"[#*$%&<>]{2}") & (symbols * 2 >= n_words)
    shouted = (line == F.upper(line)) & (line != F.lower(line)) & (n_words >= 3) | (occurrences(line, "!!") * 5 >= n_words)
    stuttered = line.rlike(r"(?:^|[ \t])(\S+)(?:[ \t]+\1){3}(?:[ \t]|$)")
    # what follows the last mark; the leading run is greedy, so that the match begins at the line's end
    tail = F.regexp_replace(line, r"(?s)^.*[.!?…:;。！？]", "")
    unpunctuated = (n_words > SHORT_LINE) & (2 * F.size(F.split(F.trim(tail), BLANK)) > n_words)
    return navigation | symbolic | shouted | unpunctuated | stuttered | line.rlike(BOILERPLATE)


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Per document the base counts, cleaned (the text of the lines that pass) and the verdict."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = F.length(without_blanks(F.col("text")))
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))
    facts = let(
        lines_of(F.col("text")),
        lambda lines: F.struct((F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.array_join(F.filter(lines, lambda x: ~bad_line(x)), "\n").alias("cleaned")),
    )
    counts = let(words_by(F.col("text"), BLANK), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = own.select("key", chars.alias("word_chars"), symbols.alias("n_symbols"), facts.alias("lines"), counts.alias("counts"))
    long = lambda c: c.cast("long")
    out = out.select(
        F.col("key").alias(key),
        long(F.col("counts.n_words")).alias("n_words"),
        long(F.col("word_chars")).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"),
        long(F.col("lines.n_dup_lines")).alias("n_dup_lines"),
        long(F.col("counts.n_repeat_words")).alias("n_repeat_words"),
        F.col("lines.cleaned").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.length(without_blanks(F.col("cleaned")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= (1 - max_lost) * F.col("word_chars")))
