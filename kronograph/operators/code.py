"""Code intelligence (C1-C9, N10-N12, A11, P15-P16): chunks, symbols, references and project facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, and symbol patterns by language.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "html": "html", "md": "markdown"}
SYMBOLS = {
    "function": r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|function)\s+([A-Za-z_]\w*)",
    "class": r"^\s*(?:export\s+)?class\s+([A-Za-z_]\w*)",
    "struct": r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)",
}


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(df: DataFrame, path_col: str, text_col: str, size: int, stride: int, drop_blank: bool = False) -> DataFrame:
    """(path, start_line, end_line, content): windows of lines, while a start leaves more than the overlap."""
    split = df.select(F.col(path_col).alias("path"), lines(F.col(text_col)).alias("l"))
    n = F.size("l")
    starts = F.filter(F.sequence(F.lit(0), n, F.lit(stride)), lambda s: (s == 0) | (s < n - (size - stride)))
    out = split.select("path", "l", F.explode(starts).alias("s")).select(
        "path", (F.col("s") + 1).cast("bigint").alias("start_line"), F.least(F.col("s") + size, n).cast("bigint").alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, size), "\n").alias("content")
    )
    return out.filter(F.trim("content") != "") if drop_blank else out


def language(path: Column) -> Column:
    """Language of a path's extension."""
    m = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("other"))


def numbered(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line, text) of every line."""
    return df.select(F.col(path_col).alias("path"), F.posexplode(lines(F.col(text_col))).alias("line", "text")).select("path", (F.col("line") + 1).cast("bigint").alias("line"), "text")


def symbols(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, line, kind, name) of definitions."""
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", rule, 1).alias("name")) for kind, rule in SYMBOLS.items()))
    return numbered(files, path_col, text_col).select("path", "line", F.explode(found).alias("s")).select("path", "line", "s.*").filter("name <> ''")


def references(files: DataFrame, name: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, line) where a name occurs as a word."""
    return numbered(files, path_col, text_col).filter(F.col("text").rlike(rf"\b{name}\b")).select("path", "line")


def grep(files: DataFrame, pattern: str, path_col: str, text_col: str) -> DataFrame:
    """(path, line, preview) of lines with a substring."""
    return numbered(files, path_col, text_col).filter(F.col("text").contains(pattern)).select("path", "line", F.substring("text", 1, 200).alias("preview"))


def enclosing(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, name) of the innermost symbol around each position (J10): an equi-join on the path, then the shortest range."""
    joined = positions.join(ranges, "path").filter(F.col("line").between(F.col("start"), F.col("end")))
    return joined.groupBy("path", "line").agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), "name")).alias("name"))


def symbol_edges(files: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship): files contain symbols, symbols refer to the definitions of words in their lines.

    A symbol reaches to the line before the next one in its file; words meet
    definitions in an equi-join on the name, never line by line.
    """
    from pyspark.sql import Window

    found = symbols(files).withColumn("id", F.concat_ws("#", "path", "name"))
    contains = found.select(F.col("path").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("relationship"))
    by = Window.partitionBy("path").orderBy("line")
    start = numbered(files, "path", "content").join(found.select("path", "line", "id"), ["path", "line"], "left")
    owned = start.withColumn("owner", F.last("id", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("owner is not null")
    used = owned.select("path", "owner", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), 0))).alias("name")).distinct()
    refers = used.join(found.select("path", "name", "id"), ["path", "name"]).filter("owner <> id").select(F.col("owner").alias("source_id"), F.col("id").alias("target_id"), F.lit("REFERENCES").alias("relationship"))
    return contains.unionByName(refers.distinct())


def project_kind(files: DataFrame, project: str, path: str) -> DataFrame:
    """(project, kind) by the first manifest found."""
    has = lambda name: F.bool_or(F.col(path).endswith(name))
    kind = F.when(has("Cargo.toml"), "Rust").when(has("package.json"), F.when(has("tsconfig.json"), "TypeScript").otherwise("JavaScript"))
    kind = kind.when(has("pyproject.toml") | has("setup.py"), "Python").when(has("go.mod"), "Go").when(has("pom.xml"), "Java").otherwise("Mixed")
    return files.groupBy(project).agg(kind.alias("kind"))
