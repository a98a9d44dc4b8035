"""Dependencies and frameworks out of manifest files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import paths

_NPM_SCHEMA = ("dependencies map<string,string>, devDependencies map<string,string>, _corrupt_record string")


def _base() -> Column:
    return paths.base_name(F.col("path"))


def _parsed_npm(content: Column) -> Column:
    return F.from_json(content, _NPM_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _entries(parsed: Column) -> Column:
    """Dependency entries; a development entry replaces the one of the same name."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    deps = F.coalesce(parsed.getField("dependencies"), empty)
    dev = F.coalesce(parsed.getField("devDependencies"), empty)
    return F.concat(F.filter(F.map_entries(deps), lambda e: ~F.map_contains_key(dev, e["key"])), F.map_entries(dev))


def npm_deps(files: DataFrame) -> DataFrame:
    """(repo, path, name, version) of every package.json that is valid JSON."""
    return (files.where(_base() == "package.json")
            .select("repo", "path", F.explode(_entries(_parsed_npm(F.col("content")))).alias("e"))
            .select("repo", "path", F.col("e.key").alias("name"), F.col("e.value").alias("version")))


def npm_fallback(files: DataFrame) -> DataFrame:
    """Quoted pattern names in a package.json that is not valid JSON."""
    patterns = dims.MANIFEST_PATTERNS["package.json"]
    quoted = F.array(*[F.when(F.col("content").contains(f'"{p}"'), F.lit(p)) for p in patterns])
    broken = _parsed_npm(F.col("content")).getField("_corrupt_record").isNotNull()
    return (files.where((_base() == "package.json") & broken)
            .select("repo", "path", F.explode(F.array_compact(quoted)).alias("pattern")))


def _pip_names(content: Column) -> Column:
    """Package names, one per line that is neither blank nor a comment."""
    trimmed = F.transform(F.split(content, "\n"), lambda l: F.btrim(l, F.lit(" \t\r")))
    kept = F.filter(trimmed, lambda l: (l != "") & ~l.startswith("#"))
    return F.transform(kept, lambda l: F.btrim(F.regexp_extract(l, r"^(.*?)(?:==|>=|<=|$)", 1), F.lit(" \t\r")))


def pip_deps(files: DataFrame) -> DataFrame:
    """(repo, path, name, framework, category) for every known package of a requirements.txt."""
    names = (files.where(_base() == "requirements.txt")
             .select("repo", "path", F.explode(_pip_names(F.col("content"))).alias("name")))
    spark = files.sparkSession
    return (match_deps(names, patterns_frame(spark, "requirements.txt"), fold_case=True)
            .withColumn("category", F.when(F.col("framework").isin(*dims.DATABASE_NAMES), "database")
                        .otherwise("framework")))


def maven_hits(files: DataFrame) -> DataFrame:
    """(repo, path, framework, category) for every known text in a pom.xml."""
    hits = _text_hits(F.col("content"), "pom.xml", fold_case=False)
    return (files.where(_base() == "pom.xml").select("repo", "path", F.explode(hits).alias("framework"))
            .withColumn("category", F.when(F.col("framework").isin(*dims.SECURITY_FRAMEWORK_NAMES), "security")
                        .otherwise("framework")))


def manifest_hits(files: DataFrame) -> DataFrame:
    """(repo, path, framework) for go.mod, Gemfile and composer.json, ignoring case."""
    names = ("go.mod", "Gemfile", "composer.json")
    case = F.when(_base() == names[0], _text_hits(F.col("content"), names[0], True))
    for name in names[1:]:
        case = case.when(_base() == name, _text_hits(F.col("content"), name, True))
    return files.where(_base().isin(*names)).select("repo", "path", F.explode(case).alias("framework"))


def go_deps(files: DataFrame) -> DataFrame:
    """(repo, path, name, version): first two fields of the lines that name a requirement or a hosted module."""
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    fields = F.split(line, r"\s+")
    return (files.where(_base() == "go.mod")
            .select("repo", "path", F.explode(F.split("content", "\n")).alias("line"))
            .where((line.contains("require") | line.contains("github.com/")) & (F.size(fields) >= 2))
            .select("repo", "path", F.get(fields, F.lit(0)).alias("name"), F.get(fields, F.lit(1)).alias("version")))


def patterns_frame(spark: SparkSession, manifest: str) -> DataFrame:
    rows = list(dims.MANIFEST_PATTERNS[manifest].items())
    return spark.createDataFrame(rows, "pattern string, framework string")


def match_deps(deps: DataFrame, patterns: DataFrame, fold_case: bool = False) -> DataFrame:
    """Dependencies times patterns where the name contains the pattern.

    The tables above have a dozen rows, which Spark sees and broadcasts by itself; a larger one is left to its size check.
    """
    name, pattern = F.col("name"), F.col("pattern")
    if fold_case:
        name, pattern = F.lower(name), F.lower(pattern)
    return deps.join(patterns, name.contains(pattern))


def classify_deps(deps: DataFrame) -> DataFrame:
    """Class flags of each dependency by words in its name."""
    low = F.lower(F.col("name"))
    any_of = lambda words: low.rlike("|".join(re.escape(w) for w in words))
    return deps.select(
        "*", any_of(dims.SECURITY_LIBRARY_WORDS).alias("is_security"), any_of(dims.DATABASE_WORDS).alias("is_database"),
        any_of(dims.WEB_FRAMEWORK_WORDS).alias("is_web"), any_of(dims.BUILD_TOOL_WORDS).alias("is_build"))


def dependency_stack(deps: DataFrame) -> DataFrame:
    """One row per (repo, class, item): library, security (`name@version`), database, web, build.

    Long form, so that a repository with very many dependencies is never collected into one row.
    """
    tagged = classify_deps(deps)
    name = F.col("name")
    items = F.array(
        F.struct(F.lit("library").alias("class"), name.alias("item")),
        F.when(F.col("is_security"), F.struct(F.lit("security").alias("class"),
                                              F.concat(name, F.lit("@"), F.col("version")).alias("item"))),
        F.when(F.col("is_database"), F.struct(F.lit("database").alias("class"), name.alias("item"))),
        F.when(F.col("is_web"), F.struct(F.lit("web").alias("class"), name.alias("item"))),
        F.when(F.col("is_build"), F.struct(F.lit("build").alias("class"), name.alias("item"))))
    return (tagged.select("repo", F.explode(F.array_compact(items)).alias("i"))
            .select("repo", "i.class", "i.item").distinct())


def stack_framework(deps: DataFrame) -> DataFrame:
    """The web framework of a repository: the alphabetically first web dependency."""
    return classify_deps(deps).where("is_web").groupBy("repo").agg(F.min("name").alias("framework"))


def security_patterns(stack: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Known mitigations (repo, pattern, description, confidence) from framework and security libraries."""
    fields = ("pattern", "description", "confidence")
    make = lambda m: F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, m[1:])])
    by_framework = F.array(*[F.when(F.lower("framework") == m[0], make(m)) for m in dims.FRAMEWORK_MITIGATIONS])
    by_library = F.array(*[F.when(F.col("item").contains(m[0]), make(m)) for m in dims.LIBRARY_MITIGATIONS])
    left = frameworks.select("repo", F.explode(F.array_compact(by_framework)).alias("m"))
    right = (stack.where(F.col("class") == "security")
             .select("repo", F.explode(F.array_compact(by_library)).alias("m")))
    return left.unionByName(right).select("repo", "m.*")


def _text_hits(content: Column, manifest: str, fold_case: bool) -> Column:
    """Frameworks whose pattern occurs in the text, one entry per pattern."""
    hay = F.lower(content) if fold_case else content
    return F.array_compact(F.array(*[
        F.when(hay.contains(p.lower() if fold_case else p), F.lit(fw))
        for p, fw in dims.MANIFEST_PATTERNS[manifest].items()]))


def _name_hits(names: Column, manifest: str, fold_case: bool) -> Column:
    """Frameworks matched by a list of names, one entry per (name, pattern)."""
    def one(name):
        hay = F.lower(name) if fold_case else name
        return F.array_compact(F.array(*[
            F.when(hay.contains(p.lower() if fold_case else p), F.lit(fw))
            for p, fw in dims.MANIFEST_PATTERNS[manifest].items()]))
    return F.flatten(F.transform(names, one))


def match_paths(files: DataFrame) -> DataFrame:
    """(repo, path, framework): each path pattern counts once per file, anywhere in the path."""
    return files.select("repo", "path", F.explode(_path_hits(_base())).alias("framework"))


def _path_hits(base: Column) -> Column:
    path = F.col("path")
    return F.array_compact(F.array(*[
        F.when(path.contains(p) | (base == p), F.lit(fw))
        for fw, patterns in dims.FRAMEWORK_PATH_PATTERNS.items() for p in patterns]))


def framework_hits(files: DataFrame) -> DataFrame:
    """Every framework hit (repo, path, framework, category, manifest): by path for all files, by content for manifests.

    Two branches, so that contents are only used of files whose name says manifest.
    """
    listed = files.where(F.col("type") == "file").select("repo", "path", _base().alias("_base"))
    by_path = listed.select("repo", "path", F.explode(_path_hits(F.col("_base"))).alias("framework"), F.lit(False).alias("manifest"),
                            F.lit("framework").alias("category"))
    return by_path.unionByName(_manifest_hits(files)).select("repo", "path", "framework", "manifest", "category")


def _manifest_hits(files: DataFrame) -> DataFrame:
    staged = (files.where((F.col("type") == "file") & _base().isin(*dims.MANIFEST_PATTERNS))
              .select("repo", "path", "content", _base().alias("_base"))
              .withColumn("_npm", F.when(F.col("_base") == "package.json", _parsed_npm(F.col("content")))))
    content, base, parsed = F.col("content"), F.col("_base"), F.col("_npm")
    npm_text = F.array_compact(F.array(*[
        F.when(content.contains(f'"{p}"'), F.lit(fw)) for p, fw in dims.MANIFEST_PATTERNS["package.json"].items()]))
    npm_names = F.transform(_entries(parsed), lambda e: e["key"])
    npm = F.when(parsed.getField("_corrupt_record").isNotNull(), npm_text).otherwise(
        _name_hits(npm_names, "package.json", False))
    by_manifest = (
        F.when(base == "package.json", npm)
        .when(base == "requirements.txt", _name_hits(_pip_names(content), "requirements.txt", True))
        .when(base == "pom.xml", _text_hits(content, "pom.xml", False))
        .when(base == "go.mod", _text_hits(content, "go.mod", True))
        .when(base == "Gemfile", _text_hits(content, "Gemfile", True))
        .when(base == "composer.json", _text_hits(content, "composer.json", True)))
    fw = F.col("framework")
    category = (
        F.when((base == "package.json") & fw.isin(*dims.BUILD_TOOL_NAMES), "build")
        .when((base == "requirements.txt") & fw.isin(*dims.DATABASE_NAMES), "database")
        .when((base == "pom.xml") & fw.isin(*dims.SECURITY_FRAMEWORK_NAMES), "security")
        .otherwise("framework"))
    return (staged.select("repo", "path", "_base", F.explode(by_manifest).alias("framework"))
            .select("repo", "path", "framework", F.lit(True).alias("manifest"), category.alias("category")))


def detect_frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework, category, n, manifest_hits, indicator): counts and the first file that showed it."""
    hits = framework_hits(files)
    return hits.groupBy("repo", "framework", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("manifest").alias("manifest_hits"),
        first_indicator().alias("indicator"))


def first_indicator() -> Column:
    """Aggregate: base name of the first hit file in path order."""
    return F.min_by(_base(), F.col("path"))
