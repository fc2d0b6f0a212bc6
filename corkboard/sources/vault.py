"""Folders of Markdown files as a table: a data source that walks them, and the policy that admits files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corkboard.functions.markdown import parsed

# Folders that are never entered, and the defaults that results depend on.
RESERVED = [".git", ".obsidian", ".trash", ".corkboard", "node_modules"]
MOST_BYTES = 2_000_000
FILES = "relative_path string, size long, mtime_ns long, content binary, skip_reason string"


@dataclass
class Policy:
    """What may be read. Paths and terms are compared without regard to case; unknown keys and wrong types are errors."""

    include_paths: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=lambda: [f"{d}/**" for d in RESERVED])
    deny_path_terms: list[str] = field(default_factory=list)
    deny_frontmatter: dict[str, list[str]] = field(default_factory=dict)
    max_file_bytes: int = MOST_BYTES

    def __post_init__(self) -> None:
        deny = self.deny_frontmatter
        if not isinstance(deny, dict):
            raise ValueError("deny_frontmatter must be lists of strings by key")
        lists = {"include_paths": self.include_paths, "exclude_globs": self.exclude_globs, "deny_path_terms": self.deny_path_terms} | {f"deny_frontmatter.{k}": v for k, v in deny.items()}
        for name, value in lists.items():
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{name} must be a list of strings")
        if type(self.max_file_bytes) is not int or self.max_file_bytes < 1:
            raise ValueError("max_file_bytes must be a positive integer")

    @classmethod
    def from_json(cls, text: str | bytes) -> Policy:
        told = json.loads(text.decode("utf-8-sig") if isinstance(text, bytes) else text)
        if not isinstance(told, dict):
            raise ValueError("a policy must be a JSON object")
        if unknown := sorted(set(told) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown policy keys: {', '.join(unknown)}")
        return cls(**told)


class MarkdownFolder(DataSource):
    """Options: path, a folder that all executors see, and maxFileBytes. Rows of skipped files hold the reason and no content.
    Links are never followed."""

    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("maxfilebytes", self.options.get("maxFileBytes", MOST_BYTES))))


@dataclass
class _Slice(InputPartition):
    folder: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most = os.path.realpath(root), most

    def partitions(self) -> list[_Slice]:
        """One task for the files of the root and of each folder in it, and one for all below each second folder."""
        out = [_Slice(self.root, False)]
        for first in self._folders(self.root):
            out.append(_Slice(first, False))
            out += [_Slice(second, True) for second in self._folders(first)]
        return out

    @staticmethod
    def _folders(folder: str) -> list[str]:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name.casefold() not in RESERVED)

    def read(self, part: _Slice):
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                yield self._row(folder, None, None, None, "unreadable_path")
                continue
            for e in entries:
                if e.is_symlink():
                    if e.name.casefold().endswith(".md") or e.is_dir():
                        yield self._row(e.path, None, None, None, "symlink")
                elif e.is_dir(follow_symlinks=False):
                    if part.deep and e.name.casefold() not in RESERVED:
                        todo.append(e.path)
                elif e.name.casefold().endswith(".md"):
                    yield self._file(e.path)

    def _file(self, path: str) -> tuple:
        try:
            s = os.stat(path, follow_symlinks=False)
            if s.st_nlink > 1:
                return self._row(path, s.st_size, s.st_mtime_ns, None, "hardlink")
            if s.st_size > self.most:
                return self._row(path, s.st_size, s.st_mtime_ns, None, None)  # the policy names the reason, in its order
            with open(path, "rb") as f:
                return self._row(path, s.st_size, s.st_mtime_ns, f.read(), None)
        except OSError:
            return self._row(path, None, None, None, "unreadable_path")

    def _row(self, path: str, *rest) -> tuple:
        return (os.path.relpath(path, self.root).replace(os.sep, "/"), *rest)


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression of the JVM; * crosses folders."""
    out = re.sub(r"\[(!?)(\]?[^\]]*)\]|\*+|\?|[^\[*?]+|\[", _glob_part, glob.lower())
    return f"(?s)^{out}\\z"


def _glob_part(m: re.Match) -> str:
    t = m[0]
    if t[0] == "*":
        return ".*"
    if t == "?":
        return "."
    if t[0] == "[" and len(t) > 1:
        return f"[{'^' if m[1] else ''}{re.sub(r'([\\[\]^&])', r'\\\1', m[2])}]"
    return re.sub(r"([^\w\s/])", r"\\\1", t)


def path_reason(path: Column, size: Column, policy: Policy) -> Column:
    """Why a path isn't admitted, the first reason in this order, or null."""
    folded = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    never = F.lit(False)
    globs = [folded.rlike(glob_pattern(g)) for g in policy.exclude_globs]
    terms = [folded.contains(t.casefold()) for t in policy.deny_path_terms]
    reserved = F.arrays_overlap(F.slice(F.split(folded, "/"), 1, F.greatest(F.size(F.split(folded, "/")) - 1, F.lit(0))), F.array(*map(F.lit, RESERVED)))
    rules = {
        "not_allowlisted": ~folded.isin([p.replace("\\", "/").casefold() for p in policy.include_paths]) if policy.include_paths else never,
        "file_too_large": size > policy.max_file_bytes,
        "excluded_directory": reserved,
        "excluded_glob": F.greatest(never, never, *globs),
        "denied_path_term": F.greatest(never, never, *terms),
    }
    return F.coalesce(*[F.when(rule, name) for name, rule in rules.items()])


def frontmatter_reason(values: Column, valid: Column, policy: Policy) -> Column:
    """Why frontmatter isn't admitted: any rule and frontmatter that can't be read, or a denied value; else null."""
    if not policy.deny_frontmatter:
        return F.lit(None).cast("string")
    out = [F.when(~valid, "unparseable_frontmatter")]
    for key, denied in policy.deny_frontmatter.items():
        told = F.flatten(F.transform(F.filter(F.element_at(values, F.lit(key.casefold())), lambda v: v.isNotNull()), lambda v: F.split(v, ",")))
        told = F.transform(told, lambda v: F.lower(F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", "")))
        out.append(F.when(F.arrays_overlap(told, F.array(*[F.lit(d.casefold()) for d in denied]).cast("array<string>")), f"denied_frontmatter:{key.casefold()}"))
    return F.coalesce(*out)


def files(spark: SparkSession, folder: str, policy: Policy | None = None) -> DataFrame:
    spark.dataSource.register(MarkdownFolder)
    return spark.read.format("markdown_folder").option("path", folder).option("maxFileBytes", (policy or Policy()).max_file_bytes).load()


def anywhere(spark: SparkSession, folder: str, policy: Policy | None = None) -> DataFrame:
    """As files, of a folder on any file system that Spark reads: listed and read by its tasks, many files each, however the folders
    are nested. Contents of files beyond the policy's size aren't read; reserved folders are left out. Nothing is known here of
    links, which such stores don't have, or follow."""
    policy = policy or Policy()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(folder)
    relative = F.substr(F.col("path"), F.lit(len(root) + 2))
    told = [relative.alias("relative_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")]
    inside = ~F.arrays_overlap(F.split(F.lower(F.col("relative_path")), "/"), F.array(*map(F.lit, RESERVED)))
    fits = F.col("length") <= policy.max_file_bytes
    small = found.filter(fits).select(*told, "content")
    large = found.filter(~fits).select(*told, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).filter(inside).withColumn("skip_reason", F.lit(None).cast("string"))


def admitted(found: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Each file with what was parsed of it and skip_reason, null where it is admitted. Only bytes of admitted paths are parsed."""
    policy = policy or Policy()
    by_path = F.coalesce("skip_reason", path_reason(F.col("relative_path"), F.col("size"), policy))
    kept = found.withColumn("skip_reason", by_path).withColumn("content", F.when(F.col("skip_reason").isNull(), F.col("content")))
    read = kept.withColumn("p", parsed(F.col("relative_path"), F.col("content"))).select("relative_path", "size", "mtime_ns", "skip_reason", "p.*")
    reason = F.coalesce("skip_reason", "problem", frontmatter_reason(F.col("frontmatter"), F.col("valid"), policy))
    return read.withColumn("skip_reason", reason).drop("problem")


def skips(read: DataFrame) -> DataFrame:
    return read.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("files"))


def sections(read: DataFrame) -> DataFrame:
    """(relative_path, ordinal, heading, line_start, line_end, text) of admitted notes."""
    each = read.filter("skip_reason IS NULL").select("relative_path", F.posexplode("sections").alias("ordinal", "s"))
    return each.select("relative_path", "ordinal", "s.*")
