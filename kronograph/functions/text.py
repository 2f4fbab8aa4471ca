"""Text functions (F1-F8, F29-F34) as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark code relevance, stop words of capitalised entities, and technical terms.
ENTITY_STOP_WORDS = ("The", "This", "That", "These", "Those", "And", "But", "For", "With", "From", "They", "When", "Where")


def words(text: Column) -> Column:
    """Words between white space (F1)."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def end_trimmed(word: Column) -> Column:
    """A word without trailing . , ! ? ; : quotes (F2)."""
    return F.regexp_replace(word, "[.,!?;:\"']+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / bytes of the longer, case folded; equal strings 1."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(x == y, 1.0).when(longest == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two lower-cased texts; 0 where there are none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def collection_name(path: Column) -> Column:
    """First 8 digits of the md5 (F8)."""
    return F.substring(F.md5(path), 1, 8)


def chunk_id(text: Column) -> Column:
    """chunk_ and the first 16 digits of the md5 (F8)."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(text), 1, 16))


def place(key: Column) -> Column:
    """Place of a key on a ring of 2^60: the first 15 digits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def shard(key: Column, shards: int = 16) -> Column:
    """Shard of a key: the first byte of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("bigint") % shards


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda made, rule: made.when(*rule), rules[1:], F.when(*rules[0])).otherwise(default)


def any_of(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether a text contains any of some terms."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def workflow_stage(text: Column) -> Column:
    """Ordered keywords: test, review, deploy, fix, refactor, implement, else planning."""
    t = F.lower(text)
    rules = [("test", "Testing"), ("review", "CodeReview"), ("deploy", "Deployment"), ("bug", "BugFix"), ("fix", "BugFix"), ("refactor", "Refactoring"), ("implement", "Implementation")]
    return first_match([(t.contains(k), v) for k, v in rules], "Planning")


def memory_type(text: Column) -> Column:
    """Kind of memory from keywords, first match wins (F32)."""
    t = F.lower(text)
    rules = [(("bug", "fix", "error"), "bug_fix"), (("decid", "decision", "choose"), "decision"), (("learn", "discover"), "learning"), (("plan", "todo", "task"), "planning")]
    return first_match([(any_of(t, k), v) for k, v in rules], "general")


def complexity(code: Column) -> Column:
    """1 for each if or elif line, 2 for each loop or match line, 1 for each try line, 10 at most."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.trim(x))
    score = F.aggregate(
        lines, F.lit(0),
        lambda n, x: n + F.when(x.rlike(r"^(if|elif|else if)\b"), 1).otherwise(0) + F.when(x.rlike(r"^(for|while|loop)\b"), 2).otherwise(0) + F.when(x.rlike(r"^(match|switch)\b"), 2).otherwise(0) + F.when(x.rlike(r"^try\b"), 1).otherwise(0),
    )
    return F.least(score, F.lit(10)).cast("bigint")


def access_probability(count: Column, recency_hours: Column, age_hours: Column) -> Column:
    """0.4 ln(n) / 10 + 0.4 e^(-recency/24) + 0.2 e^(-age/168), 1 at most."""
    return F.least(F.lit(1.0), 0.4 * F.log(count) / 10 + 0.4 * F.exp(-recency_hours / 24) + 0.2 * F.exp(-age_hours / 168))


def retry_delay(attempt: Column, base_ms: int = 100, cap_ms: int = 30000) -> Column:
    """base * 2^k, capped (F19, without jitter)."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), attempt), F.lit(float(cap_ms)))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob (P17): ** spans folders, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c), k + 1
    return f"^{out}$"


def monitored(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Include and exclude globs: exclusion wins, default is no."""
    some = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return some(include) & ~some(exclude)
