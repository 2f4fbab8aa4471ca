"""Scores, priors and heuristics of code knowledge as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that speak of code, and signs of a language's syntax.
INDICATORS = (
    "function", "class", "method", "api", "endpoint", "database", "algorithm", "pattern", "architecture", "design",
    "implementation", "bug", "fix", "test", "deploy", "refactor", "optimize",
)
SYNTAX = {"rust": ("fn ", "struct ", "impl "), "python": ("def ", "class ", "import "), "javascript": ("function ", "const ", "async "), "typescript": ("function ", "const ", "async ")}
#: Entity types by the words that name them, in code processing and at the service.
CODE_TYPES = {
    "class": "Class", "struct": "Class", "function": "Function", "method": "Function", "module": "Module", "package": "Module", "api": "Api", "endpoint": "Api",
    "datamodel": "DataModel", "model": "DataModel", "config": "Configuration", "configuration": "Configuration", "test": "TestCase", "testcase": "TestCase", "doc": "Documentation", "documentation": "Documentation",
}
SERVICE_TYPES = {"function": "Function", "class": "Class", "module": "Module", "api": "Api"}
#: Fixed values: (pattern, confidence, words that must all occur, languages or none for any).
PATTERNS = (
    ("Observer Pattern", 0.8, ("observer", "notify"), ()),
    ("Singleton Pattern", 0.75, ("singleton", "instance"), ()),
    ("Factory Pattern", 0.7, ("factory", "create"), ()),
    ("MVC Architecture", 0.6, ("controller", "service"), ()),
    ("REST API Pattern", 0.65, ("api", "endpoint"), ()),
    ("Rust Trait Pattern", 0.8, ("trait", "impl"), ("rust",)),
    ("Async/Await Pattern", 0.85, ("async", "await"), ("rust",)),
    ("Python Class Pattern", 0.7, ("__init__", "self"), ("python",)),
    ("Promise Pattern", 0.75, ("promise", "then"), ("javascript", "typescript")),
)


def _any(text: Column, words) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def relevance(content: Column, language: str | None = None, framework: str | None = None) -> Column:
    """Multiplier of a search hit: language, its syntax, framework, words that speak of code; 2 at most."""
    text, out = F.lower(content), F.lit(1.0)
    if language:
        out = out * F.when(text.contains(language.lower()), 1.5).otherwise(1.0)
        if signs := SYNTAX.get(language.lower()):
            out = out * F.when(_any(text, signs), 1.3).otherwise(1.0)
    if framework:
        out = out * F.when(text.contains(framework.lower()), 1.4).otherwise(1.0)
    spoken = sum((text.contains(w).cast("int") for w in INDICATORS), F.lit(0))
    return F.least(F.lit(2.0), out * (1 + spoken * 0.1))


def code_type(name: Column, known: dict[str, str] = CODE_TYPES) -> Column:
    """Entity type that a word names, whatever its case; Function for any other."""
    kinds = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(name)), F.lit("Function"))


def complexity_prior(kind: Column, lines: Column) -> Column:
    """5, more for classes, modules, APIs and long spans; 10 at most (F31). lines: null where unknown."""
    by_kind = F.when(kind == "Class", 2).when(kind.isin("Module", "Api"), 1).otherwise(0)
    return F.least(F.lit(10), 5 + by_kind + F.when(lines > 100, 2).when(lines > 50, 1).otherwise(0))


def importance_prior(kind: Column, name: Column, accesses: Column) -> Column:
    """5, more for APIs, services, controllers, modules and what was opened over three times of late; 10 at most."""
    by_kind = F.when(kind == "Api", 3).when((kind == "Class") & _any(name, ("Service", "Controller")), 2).when(kind == "Module", 1).otherwise(0)
    return F.least(F.lit(10), 5 + by_kind + F.when(accesses > 3, 1).otherwise(0))


def edit_fixes_bug(old: Column, new: Column) -> Column:
    """Whether an edit reads like a bug fix, by its words."""
    a, b = F.lower(old), F.lower(new)
    return a.contains("bug") | b.contains("fix") | (a.contains("error") & ~b.contains("error")) | (b.contains("handle") & ~a.contains("handle"))


def code_fixes_bug(old: Column, new: Column) -> Column:
    """Whether changed code reads like a bug fix: null or undefined gone, a check or handler new."""
    a, b = F.lower(old), F.lower(new)
    gone = [a.contains(w) & ~b.contains(w) for w in ("null", "undefined")]
    new_ = [b.contains(w) & ~a.contains(w) for w in ("handle", "check")]
    return reduce(or_, [*gone, b.contains("fix"), *new_])


def patterns(content: Column, language: Column, least: float = 0.7) -> Column:
    """Array of (pattern, confidence) that a piece of code shows with that confidence at least."""
    text, lang, found = F.lower(content), F.lower(F.coalesce(language, F.lit(""))), []
    for name, confidence, words, languages in PATTERNS:
        if confidence < least:
            continue
        hit = reduce(lambda x, y: x & y, (text.contains(w) for w in words))
        if languages:
            hit = hit & lang.isin(*languages)
        found.append(F.when(hit, F.struct(F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def architecture(kind: Column) -> Column:
    """Aggregate over the types of a unit's entities: the patterns they make."""
    api = F.when(F.bool_or(kind == "Api") & F.bool_or(kind == "DataModel"), F.lit("API-Data Pattern"))
    classes = F.when(F.count_if(kind == "Class") >= 3, F.lit("Multi-Class Design"))
    return F.array_compact(F.array(api, classes))
