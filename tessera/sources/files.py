"""Source trees as DataFrames of files, pruned before their content is read."""

from __future__ import annotations

import os
import re
import stat as st
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as tx
from tessera.session import scratch_path
from tessera.sources.globs import glob_regex

#: Bytes above which a file is skipped, and files that a workspace is cut to.
MOST_BYTES = 2048 * 1024
MOST_FILES = 5000
#: Bytes of a git revision that the driver holds at once.
GIT_BYTES = 64 << 20

# Folders and files that never declare a project's own schema.
EXCLUDED_FOLDERS = (
    ".cache", ".dart_tool", ".elixir_ls", ".git", ".gradle", ".hg", ".idea", ".mypy_cache", ".next", ".nuxt", ".output", ".pnpm-store", ".pytest_cache",
    ".svelte-kit", ".svn", ".terraform", ".tox", ".turbo", ".venv", ".vercel", ".vs", ".vscode-test", ".yarn", "DerivedData", "Pods", "__fixtures__",
    "__mocks__", "__pycache__", "__snapshots__", "__tests__", "_build", "bin", "bower_components", "build", "coverage", "deps", "dist", "fixtures",
    "jspm_packages", "node_modules", "obj", "out", "site-packages", "spec", "src/test", "storage/framework", "target", "test", "testdata", "tests", "vendor", "venv",
)
EXCLUDED_FILES = ("*.Designer.cs", "*.bundle.js", "*.down.sql", "*.map", "*.min.js", "*.spec.*", "*.test.*", "down.sql")
EXCLUDED = [f"**/{name}/**" for name in EXCLUDED_FOLDERS] + [f"**/{name}" for name in EXCLUDED_FILES]

# Names and folders that tell of a schema, and folders that speak against one.
SCRIPTS = "{,c,m}{js,ts}{,x}"
STRONG_NAMES = (
    "*.cql", "*.dbml", "*.prisma", f"*.entity.{SCRIPTS}", f"*.model.{SCRIPTS}", f"*.schema.{SCRIPTS}", "*dbcontext.cs", "*modelsnapshot.cs",
    "models.py", "schema.{,c,m}{js,ts}", "schema.rb", "schema.rs", "schema.sql", "structure.sql",
)
HINT_FOLDERS = (
    "alembic", "database", "databases", "db", "ddl", "domain", "drizzle", "entities", "entity", "migrate", "migration", "migrations", "model", "models",
    "orm", "persistence", "prisma", "repo", "schema", "schemas", "sql",
)
LOW_FOLDERS = (
    "__fixtures__", "__mocks__", "__tests__", "benchmark", "benchmarks", "demo", "doc", "docs", "e2e", "example", "examples", "fixture", "fixtures",
    "sample", "samples", "spec", "specs", "test", "testdata", "tests",
)
# Files and folders that are looked for on their own, so that a huge tree doesn't hide them.
FIRST_NAMES = ("*.dbml", "*.prisma", "*.sql", "*.{entity,model,schema}.{cjs,cts,js,mjs,mts,ts}", "*DbContext.cs", "*ModelSnapshot.cs", "models.py", "schema.{js,ts}", "schema.rb", "schema.rs")
FIRST_FOLDERS = (
    "alembic", "database", "db", "domain", "drizzle", "entities", "entity", "migrate", "migrations", "model", "models", "persistence", "prisma", "schema", "schemas",
)


def priority(path: Column) -> Column:
    """How likely a path declares a schema: a strong name, SQL, a telling folder; tests and examples count less."""
    folders = tx.path_segments(tx.dir_name(path))
    among = lambda names: F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    score = F.when(tx.base_name(path).rlike(glob_regex(list(STRONG_NAMES))), 10).otherwise(0) + F.when(tx.extension(path) == ".sql", 3).otherwise(0)
    return score + F.when(among(HINT_FOLDERS), 5).otherwise(0) - F.when(among(LOW_FOLDERS), 6).otherwise(0)


def first_regex(include: str) -> str:
    """Paths among those of ``include`` that are searched for on their own."""
    told = glob_regex([f"**/{n}" for n in FIRST_NAMES] + [f"**/{{{','.join(FIRST_FOLDERS)}}}/**"])
    return f"(?=.*(?:{include}))(?:{told})"


def excluded_regex(patterns: list[str]) -> str:
    """What the patterns name, and all below it."""
    return glob_regex([q for p in patterns for q in ([p] if p.endswith("/**") else [p, f"{p}/**"])])


def wanted(files: DataFrame, include: str, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files of (path, length) that may be read; ``exclude`` adds to the default exclusions."""
    kept = files.where(F.col("path").rlike(include) & ~F.col("path").rlike(excluded_regex(EXCLUDED + (exclude or []))))
    return kept.where(F.col("length") <= most_bytes)


def search_cap(most_files: int) -> int:
    """Files that each of the two searches of a workspace may give."""
    return min(max(4 * most_files, 2000), 200_000)


def candidates(files: DataFrame, include: str, most_files: int = MOST_FILES) -> DataFrame:
    """The ``most_files`` files of each workspace that are likeliest to declare a schema, as (workspace, path, ...).

    Two searches, one for telling paths alone, give so many files as
    ``search_cap`` says, by path; of both, the highest priorities stay.  Adds
    ``priority`` and ``truncated``, whether the workspace has more than are
    left.  Spark keeps the first rows of each workspace before it shuffles.
    """
    cap = search_cap(most_files)
    rows = files.withColumns({"priority": priority(F.col("path")), "telling": F.col("path").rlike(first_regex(include))})
    by_path = F.row_number().over(Window.partitionBy("workspace", "telling").orderBy("path"))
    # One more than the cap, to know of it: telling paths have both searches, others what those leave of the second.
    rows = rows.withColumn("nth", by_path).where(F.col("nth") <= cap + 1)
    order = Window.partitionBy("workspace").orderBy(F.desc("priority"), "path")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_files + 1)
    most = F.max("place").over(Window.partitionBy("workspace"))
    return rows.withColumn("truncated", most > most_files).where(F.col("place") <= most_files).drop("telling", "nth", "place")


def truncation_warnings(chosen: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """A warning for each workspace that was cut: (workspace, message)."""
    message = f"The workspace has more than {most_files} candidate files; only the {most_files} most relevant were scanned."
    return chosen.where("truncated").select("workspace").distinct().select("workspace", F.lit(message).alias("message"))


def _zeros(content: Column, even: bool) -> Column:
    """Zero bytes at the even or odd places of the first 4,096."""
    pairs = F.regexp_replace(F.hex(F.substring(content, 1, 4096)), "(..)(..)", "$1 " if even else "$2 ")
    return F.regexp_count(pairs, F.lit("00 "))


def text_encoding(content: Column) -> Column:
    """The encoding of bytes: by mark, else UTF-8, else UTF-16 if zeros stand on one side of the pairs; null for binary content."""
    head = F.hex(F.substring(content, 1, 2))
    pairs = F.least(F.floor(F.length(content) / 2), F.lit(2048))
    even, odd = _zeros(content, True), _zeros(content, False)
    clear = F.position(F.lit(bytearray(b"\0")), content) == 0
    sided = lambda a, b: (pairs >= 4) & (a > pairs * 0.7) & (b < pairs * 0.3)
    return F.when(head == "FFFE", "utf-16-le").when(head == "FEFF", "utf-16-be").when(clear, "utf-8").when(sided(odd, even), "utf-16-le").when(sided(even, odd), "utf-16-be")


@F.pandas_udf(StringType())
def _wide(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode(e, "replace").removeprefix("﻿") for c, e in zip(content, encoding)], dtype=object)


def decode_text(content: Column) -> Column:
    """Text of bytes, bad places as replacement characters; null for binary content.

    UTF-8 is decoded by Spark; Python gets the few files in UTF-16 alone.
    """
    encoding = text_encoding(content)
    narrow = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
    wide = _wide(F.when(encoding != "utf-8", content), encoding)
    text = F.when(encoding == "utf-8", narrow).when(encoding.isNotNull(), wide)
    return F.when(~text.contains("\u0000"), text)


def list_tree(spark: SparkSession, root: str, include: str, *, workspace: str | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What of a folder may be read, without content: (workspace, path, size, mtime, location)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    named = found.select(relative.alias("path"), "length", F.col("modificationTime").alias("mtime"), F.col("path").alias("location"))
    kept = wanted(named, include, exclude, most_bytes)
    return kept.select(F.lit(workspace or os.path.basename(base)).alias("workspace"), "path", F.col("length").alias("size"), "mtime", "location")


def read_files(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """The text of listed files of a folder: (workspace, path, size, mtime, text); binary files are left out.

    Up to MOST_FILES places are handed to the reader by name, so that no other
    file is opened; longer listings are joined to the folder.
    """
    places = listing.select("location").limit(MOST_FILES + 1).collect()
    if not places:
        content = spark.createDataFrame([], "location string, content binary")
    else:
        reader = spark.read.format("binaryFile")
        # Names with glob characters would be taken as patterns.
        named = len(places) <= MOST_FILES and not any(re.search(r"[{}\[\]*?\\]", r.location) for r in places)
        found = reader.load([r.location for r in places]) if named else reader.option("recursiveFileLookup", "true").load(root)
        content = found.select(F.col("path").alias("location"), "content")
    out = listing.join(content, "location").select("workspace", "path", "size", "mtime", decode_text(F.col("content")).alias("text"))
    return out.where("text IS NOT NULL")


def read_tree(
    spark: SparkSession, root: str, include: str, *, workspace: str | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES
) -> DataFrame:
    """Files of a folder that Spark can read: (workspace, path, size, mtime, text).

    Paths and sizes are filtered on the listing, the likeliest files are chosen, and only those are opened.
    """
    listed = list_tree(spark, root, include, workspace=workspace, exclude=exclude, most_bytes=most_bytes)
    return read_files(spark, root, candidates(listed, include, most_files))


def _same_file(rows: DataFrame) -> DataFrame:
    return rows.select("workspace", "path", "size", "mtime").distinct()


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose path, size or time differ from what was parsed before."""
    return files.join(_same_file(cached), ["workspace", "path", "size", "mtime"], "left_anti")


def unchanged(cached: DataFrame, files: DataFrame) -> DataFrame:
    """What was parsed before of files that are still the same: after a scan, this leaves out those that changed meanwhile."""
    return cached.join(_same_file(files), ["workspace", "path", "size", "mtime"], "left_semi")


def _git(repository: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True).stdout


def _blobs(repository: str, names: list[tuple[str, str]]) -> Iterator[tuple[str, bytes]]:
    """Path and content of each (object, path), by one git process."""
    with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
        for blob, path in names:
            git.stdin.write(f"{blob}\n".encode())
            git.stdin.flush()
            head = git.stdout.readline().split()
            if len(head) == 3:
                content = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield path, content


def git_files(
    spark: SparkSession, repository: str, ref: str, include: str, workspace: str | None = None, *, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """Files of a git revision, those included that have been changed, moved or deleted since.

    The driver, which has the repository, reads the wanted blobs through one
    git process and hands them on in parts of GIT_BYTES, by a table in the shared folder.
    """
    keep, drop = re.compile(include), re.compile(excluded_regex(EXCLUDED + (exclude or [])))
    names = []
    for line in _git(repository, "ls-tree", "-r", "-z", "-l", ref).decode("utf-8", "surrogateescape").split("\0"):
        meta, _, path = line.partition("\t")
        fields = meta.split()
        if len(fields) == 4 and fields[1] == "blob" and keep.search(path) and not drop.search(path) and int(fields[3]) <= most_bytes:
            names.append((fields[2], path))
    where, held, size = scratch_path(spark, "revision"), [], 0
    schema = "path string, content binary"
    spark.createDataFrame([], schema).write.parquet(where)
    for i, (path, content) in enumerate(_blobs(repository, names), 1):
        held.append((path, content))
        size += len(content)
        if size >= GIT_BYTES or i == len(names):
            spark.createDataFrame(held, schema).write.mode("append").parquet(where)
            held, size = [], 0
    read = spark.read.schema(schema).parquet(where)
    out = read.select(F.lit(workspace or os.path.basename(repository.rstrip("/"))).alias("workspace"), "path", F.length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), decode_text(F.col("content")).alias("text"))
    return out.where("text IS NOT NULL")


def is_tree(path: str) -> bool:
    return os.path.exists(path) and st.S_ISDIR(os.stat(path).st_mode)
