"""Answer texts: normalising, spans, token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count in answers.
ARTICLES = ("a", "an", "the")


def answer_tokens(c: Column) -> Column:
    """Lower case, anything but letters, digits and underscores to spaces, split, articles dropped; repeats stay."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_]+", " ")), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES))


def answer_span(c: Column) -> Column:
    """Left-trimmed, up to the first line end, "Question:" or "Answer:"."""
    return F.trim(F.regexp_extract(F.regexp_replace(c, r"^\s+", ""), r"(?s)^(.*?)(?:\n|Question:|Answer:|$)", 1))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space if there is one."""
    cut = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.transform(F.array_distinct(a), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, x: s + x)


def token_f1(pred: Column, gold: Column) -> Column:
    """2PR / (P + R) over token multisets; two empty answers agree, one empty answer doesn't."""
    same, n, m = token_overlap(pred, gold), F.size(pred), F.size(gold)
    return F.when((n == 0) | (m == 0), F.when(n == m, 1.0).otherwise(0.0)).when(same == 0, 0.0).otherwise(2.0 * same / (n + m))


def contains_tokens(pred: Column, gold: Column) -> Column:
    """Whether gold's tokens occur in pred's, next to each other; never if gold is empty."""
    wrap = lambda xs: F.concat(F.lit(" "), F.array_join(xs, " "), F.lit(" "))
    return (F.size(gold) > 0) & F.contains(wrap(pred), wrap(gold))


def _per_alias(pred: Column, aliases: Column, of, nothing: Column) -> Column:
    """The greatest of a score over all aliases (array<string>); null without aliases."""
    best = F.array_max(F.transform(aliases, lambda a: of(pred, answer_tokens(a))))
    return F.when(aliases.isNull() | (F.size(aliases) == 0), F.lit(None)).otherwise(F.coalesce(best, nothing))


def f1_aliases(pred: Column, aliases: Column) -> Column:
    """``pred`` is a token array, ``aliases`` texts; so for the next two."""
    return _per_alias(pred, aliases, token_f1, F.lit(0.0))


def em_strict(pred: Column, aliases: Column) -> Column:
    """1 if the tokens equal those of an alias that has some."""
    return _per_alias(pred, aliases, lambda p, g: F.when((F.size(g) > 0) & (p == g), 1.0).otherwise(0.0), F.lit(0.0))


def em_contains(pred: Column, aliases: Column) -> Column:
    """1 if the tokens of an alias that has some occur next to each other."""
    return _per_alias(pred, aliases, lambda p, g: F.when(contains_tokens(p, g), 1.0).otherwise(0.0), F.lit(0.0))


def prompt(question: Column, passages: Column, most: int = 500) -> Column:
    """The question with numbered passages (array<string>), each cut at ``most`` characters; without passages the plain form."""
    #: The wording of both prompts.
    head = "Answer the question using only the context below. Reply with a short factual answer (one phrase).\n\nContext:\n"
    plain = "Answer the question with a short factual phrase (one line).\n"
    lines = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(p, 1, most), F.lit("\n"))), "")
    full = F.concat(F.lit(head), lines, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))
    return F.when(F.coalesce(F.size(passages), F.lit(0)) > 0, full).otherwise(F.concat(F.lit(plain + "Question: "), question, F.lit("\nAnswer:")))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)
