"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The measures of a document are columns. A rule rejects by a condition on
measures or on the text. The base rules stand in front, whatever they cost; for
the others a bounded sample of the rows gives each rule's share of rejections
and its time, and they are tried in the order of rejection per cost, each only
on documents that no earlier rule rejected. The measures are part of the result
and are computed for every row, so what a rejection saves is the work of the
rules that read the text or its words. The order changes the work, never the
verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects where the SQL condition holds (null: it does not)."""

    name: str
    rejects: str


#: Over the measures and the text, as ``text_`` and ``words_``.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("words_without_letters", r"10 * size(filter(words_, w -> not w rlike '\\p{L}')) > 3 * n_words"),
    Rule("bullets", r"10 * regexp_count(text_, '(?m)^[ \\t]*[\\-*•]') > 9 * n_lines"),
    Rule("cut_lines", r"10 * regexp_count(text_, '(?m)(\\.\\.\\.|…)[ \\t]*$') > 3 * n_lines"),
)
BASE = ("few_words", "repeated_windows")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the text as ``text_`` (null: empty), its words as ``words_`` and the counts that rules use.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines``, ``n_repeat_words``: longs, 0 for empty texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # transform(array(x), v -> ...)[0] binds x to v: were x read in the inner
    # lambda itself, a pushed-down filter would work it out for every element.
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text_"))
        .withColumn("words_", F.array_remove(F.split("text_", _BLANKS, -1), ""))
        .withColumn("lines_", F.filter(F.split("text_", "\n", -1), lambda x: x.rlike(_WORD)))
        # Three-word windows by hash and place, sorted: equal windows stand side by side.
        .withColumn("windows_", F.expr(
            "transform(array(words_), v -> sort_array(transform(slice(v, 1, greatest(size(v) - 2, 0)),"
            " (w, i) -> struct(xxhash64(w, v[i + 1], v[i + 2]) as h, i as i))))[0]"))
        .withColumn("repeated_", F.expr(
            "transform(array(windows_), v -> sort_array(transform(filter(v,"
            " (x, k) -> x.h = get(v, k - 1).h or x.h = get(v, k + 1).h), x -> x.i)))[0]"))
        .select(
            "doc_id", "text_", "words_",
            F.size("words_").cast("long").alias("n_words"),
            F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
            F.regexp_count("text_", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines_").cast("long").alias("n_lines"),
            (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
            # A word counts once however many repeated windows cover it.
            F.expr(
                "transform(array(repeated_), v -> aggregate(transform(v,"
                " (p, k) -> least(3, coalesce(get(v, k + 1) - p, 3))), 0L, (a, x) -> a + x))[0]").alias("n_repeat_words"),
        )
    )


def _holds(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects), F.lit(False))


def seconds_a_row(sample: DataFrame, rules: tuple[Rule, ...], clear: float = 0.2, most_copies: int = 1024) -> dict[str, float]:
    """Seconds that each rule takes for a row of ``sample``, beyond those of a rule that does nothing.

    A job has a cost of its own, so the rows are repeated in the job until the
    rule takes ``clear`` seconds more than the empty rule does, or ``most_copies``
    times: a rule that stays under that costs next to nothing. Of two runs the
    shorter counts.
    """
    n_rows = sample.count()

    def run(condition: Column, copies: int) -> float:
        repeated = sample.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            repeated.agg(F.count_if(condition)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    empty: dict[int, float] = {}
    found = {}
    for rule in rules:
        copies = 1
        while True:
            if copies not in empty:
                empty[copies] = run(F.col("copy_") < 0, copies)
            beyond = run(_holds(rule), copies) - empty[copies]
            if beyond >= clear or copies >= most_copies:
                break
            copies *= 8 if beyond < clear / 8 else 2
            copies = min(copies, most_copies)
        found[rule.name] = max(beyond, 1e-6) / (max(n_rows, 1) * copies)
    return found


def order_rules(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules by rejections per second on a sample of measured rows."""
    if not rules:
        return []
    sample = sample.cache()
    try:
        shares = sample.agg(*(F.avg(_holds(r).cast("int")).alias(r.name) for r in rules)).first()
        cost = seconds_a_row(sample, rules)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: (-(shares[r.name] or 0.0) / cost[r.name], r.name))


def cascade(measured: DataFrame, ordered: list[Rule]) -> DataFrame:
    """``measured`` with ``failed_rule``: the first rule in this order that rejects, null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(_holds(rule), F.lit(rule.name)).otherwise(verdict)
    return measured.withColumn("failed_rule", verdict)


def spread_sample(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About ``rows`` rows, and no more, chosen over the whole table by a hash of id and text; all rows of a small table."""
    total = docs.count()
    if total > rows:
        place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(total))
        docs = docs.filter(place < rows)
    return docs.limit(rows)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document.

    ``kept`` is false where a base rule or any other rule rejects; the base
    rules are tried first, the others in the order that the sample gives. One output
    row for each input row; null and empty texts have no words and are
    rejected by the rule on few words; ids may be null or repeat; other columns
    are not read; an empty table gives an empty table.
    """
    measured = measures(docs, id_col, text_col)
    base = [r for r in rules if r.name in BASE]
    # The sample only orders the rules; its size bounds the work of that.
    sample = measures(spread_sample(docs, sample_rows, id_col, text_col), id_col, text_col)
    ordered = base + order_rules(sample, tuple(r for r in rules if r.name not in BASE))
    failed = cascade(measured, ordered)
    return failed.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce(F.col("failed_rule").isin(*BASE), F.lit(False)).alias("base_failed"),
        F.col("failed_rule").isNull().alias("kept"),
    )
