"""Files as documents: walks, listings and readers.

A listing is made on the driver and holds paths alone; contents are read on
the executors by Spark's own binaryFile source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import BINARY, decoded, editor_text
from .ignore import Ignore, ignored_column, to_regex
from .stores import Local, Store, store_of
from .stores import plain as located

STDIN = "<stdin>"
# What an editor's listing leaves out, in any folder: folders, names, paths, and extensions that hold no text.
FOLDERS = """
.git .hg .svn
node_modules bower_components jspm_packages .pnpm-store .yarn vendor site-packages Pods Carthage
dist build out target _build _site dist-newstyle zig-out storybook-static cdk.out DerivedData CMakeFiles
.next .nuxt .output .svelte-kit .angular .astro .docusaurus .vuepress .expo .turbo .parcel-cache .cache .sass-cache .jekyll-cache
.dart_tool .pub-cache .gradle .kotlin .cxx .externalNativeBuild captures ephemeral .symlinks .swiftpm .build .bundle .stack-work .zig-cache .godot elm-stuff
.vercel .netlify .serverless .aws-sam .terraform
.venv venv __pycache__ .tox .nox .mypy_cache .pytest_cache .ruff_cache .ipynb_checkpoints .eggs *.egg-info
coverage htmlcov .nyc_output .vscode-test .idea .vs xcuserdata
""".split()
NAMES = """
*.min.js *.min.css *.map *.snap *.lock package-lock.json pnpm-lock.yaml npm-shrinkwrap.json go.sum
*.pbxproj *.iml local.properties output-metadata.json .flutter-plugins .flutter-plugins-dependencies .packages
Generated.xcconfig flutter_export_environment.sh GeneratedPluginRegistrant.*
""".split()
PATHS = ("fastlane/report.xml", "fastlane/test_output/**", "doc/api/**")
BINARIES = """
png jpg jpeg gif webp bmp ico icns tiff avif heic psd
pdf zip gz tgz bz2 xz 7z rar tar jar war dmg iso
woff woff2 ttf otf eot mp3 mp4 mov avi mkv webm wav ogg flac
exe dll so dylib bin o a class pyc wasm db sqlite
""".split()
MOST_FILES = 5000


@dataclass(frozen=True)
class Walk:
    hidden: bool = False
    respect_ignore: bool = True
    user_excludes: str | None = None


def path_key(path: str) -> tuple[bytes, ...]:
    """Paths sort part by part, by bytes."""
    return tuple(p.encode() for p in path.split("/"))


def tree(store: Store, root: str, enter) -> Iterator[tuple[str, str]]:
    """(path below the root, kind) of what a tree holds; enter(path) tells whether to go into a folder."""
    open_ = [""]
    while open_:
        below = open_.pop()
        for name, kind in store.entries(f"{root}/{below}".rstrip("/")):
            path = below + name
            if kind == "folder":
                if enter(path):
                    open_.append(f"{path}/")
            else:
                yield path, kind


def walk(root: str, options: Walk = Walk(), spark: SparkSession | None = None) -> list[str]:
    """Files under a folder of any store, links not followed, sorted."""
    store = store_of(spark, root)
    rules = Ignore(root, user=options.user_excludes, store=store) if options.respect_ignore else None

    def stays(path: str, folder: bool) -> bool:
        return (options.hidden or not path.rpartition("/")[2].startswith(".")) and not (rules and rules.ignored(path, folder))

    top = root.rstrip("/") or "/"
    found = [f"{top}/{p}" for p, kind in tree(store, top, lambda p: stays(p, True)) if kind == "file" and stays(p, False)]
    return sorted(found, key=path_key)


def collect(inputs: list[str], options: Walk = Walk(), spark: SparkSession | None = None) -> list[str]:
    """Named files, whatever the rules say, and the files of named folders; sorted, each once. An input that is not there is an error."""
    out = []
    for path in inputs:
        store = store_of(spark, path)
        if store.is_folder(path):
            out += walk(path, options, spark)
        elif store.exists(path):
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return sorted(set(out), key=path_key)


@dataclass(frozen=True)
class Listing:
    files: list[str]
    limit_reached: bool
    ignored: int


def _any(globs) -> re.Pattern | None:
    return re.compile("|".join(f"(?:{to_regex(g)})" for g in globs)) if globs else None


def left_out(excludes=(), default_excludes: bool = True, skip_binary: bool = True) -> list[str]:
    """The globs of an editor's listing that leave files out."""
    out = [*excludes]
    if default_excludes:
        out += [f"**/{f}/**" for f in FOLDERS] + [f"**/{n}" for n in (*NAMES, *PATHS)]
    if skip_binary:
        out += [f"**/*.{e}" for e in BINARIES]
    return out


def listing(
    root: str, patterns: tuple[str, ...] = ("**/*",), excludes: tuple[str, ...] = (), always: tuple[str, ...] = (), most: int = MOST_FILES,
    default_excludes: bool = True, skip_binary: bool = True, respect_ignore: bool = True, spark: SparkSession | None = None,
) -> Listing:
    """An editor's listing, sorted by path. The cap comes after the rules; `always` brings back what they leave out, and uncounts it."""
    asked, out, back = _any(patterns), _any(left_out(excludes, default_excludes, skip_binary)), _any(always)
    store, top = store_of(spark, root), root.rstrip("/") or "/"
    rules = Ignore(root, names=(".gitignore",), fallback=(), store=store) if respect_ignore else None
    found, ignored = [], 0
    for path, _ in tree(store, top, lambda p: bool(back) or not (out and out.fullmatch(f"{p}/x"))):
        wanted = bool(back and back.fullmatch(path))
        seen = bool(asked and asked.fullmatch(path)) and not (out and out.fullmatch(path))
        hidden = seen and bool(rules and rules.ignored(path))
        ignored += hidden and not wanted
        if wanted or seen and not hidden:
            found.append(path)
    found.sort(key=lambda p: p.encode("utf-16-be", "surrogatepass"))
    return Listing([f"{top}/{f}" for f in found[:most]], len(found) > most, ignored)


def listed(
    paths: DataFrame, path_col: str = "path", patterns: tuple[str, ...] = ("**/*",), excludes: tuple[str, ...] = (), always: tuple[str, ...] = (),
    default_excludes: bool = True, skip_binary: bool = True, rules: str = "",
) -> DataFrame:
    """The same judgement for an inventory of paths, as a table of any size: paths with `state`, listed, ignored or left-out. rules are those of the root."""

    def fits(globs) -> Column:
        return F.col(path_col).rlike("\\A(?:" + "|".join(f"(?:{to_regex(g)})" for g in globs) + ")\\z") if globs else F.lit(False)

    seen = fits(patterns) & ~fits(left_out(excludes, default_excludes, skip_binary))
    state = F.when(fits(always), "listed").when(~seen, "left-out").when(ignored_column(F.col(path_col), rules), "ignored").otherwise("listed")
    return paths.withColumn("state", state)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, text, reason, refusal) of files of any store; one that can't be opened is a refusal, not an error. Paths of files only, as collect() gives them."""
    open_, shut = _reachable(spark, paths)
    out = spark.createDataFrame([(p, None, BINARY, why) for p, why in shut], "file string, text string, reason string, refusal string")
    for part in _binary(spark, open_):
        out = decoded(part).select("file", "text", "reason", "refusal").unionByName(out)
    return out


#: Bytes of files with hidden names in a store that are read at once.
_AT_ONCE = 64 << 20


def _binary(spark: SparkSession, paths: list[str]) -> Iterator[DataFrame]:
    """Frames (file, length, content) of files, by Spark's own source.

    That one passes over names with a leading dot or underscore, even if they
    are asked for: on disks those are read by the tasks, in other stores by the
    driver, some at a time.
    """
    hidden = [p for p in paths if p.rpartition("/")[2].startswith((".", "_")) or p.endswith("._COPYING_")]
    plain = sorted(set(paths) - set(hidden))
    if plain:
        yield spark.read.format("binaryFile").load([_escaped(p) for p in plain]).select(_shown("path").alias("file"), "length", "content")
    local = [p for p in hidden if isinstance(store_of(spark, p), Local)]
    if local:

        def opened(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with open(path, "rb") as f:
                        content = f.read()
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["file", "length", "content"])

        names = spark.createDataFrame([(os.path.abspath(located(p)),) for p in local], "file string")
        yield names.repartition(max(1, len(local) // 64 + 1)).mapInArrow(opened, "file string, length long, content binary")
    rows, size = [], 0
    for path in sorted(set(hidden) - set(local)):
        content = store_of(spark, path).content(path)
        rows.append((path, len(content), bytearray(content)))
        size += len(content)
        if size > _AT_ONCE:
            yield spark.createDataFrame(rows, "file string, length long, content binary")
            rows, size = [], 0
    if rows:
        yield spark.createDataFrame(rows, "file string, length long, content binary")


def _reachable(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Paths that can be opened, and (path, why not) of the others."""
    why = [(p, store_of(spark, p).why_not(p)) for p in paths]
    return [p for p, w in why if w is None], [(p, w) for p, w in why if w is not None]


def _shown(path: str) -> Column:
    """A local file by its path, any other by its URI."""
    return F.regexp_replace(path, "^file:/*", "/")


def _escaped(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def read_folder(spark: SparkSession, path: str, glob: str | None = None, options: Walk | None = None) -> DataFrame:
    """The same for a folder in any store: listed and read by Spark; with options, walked under the rules of its ignore files."""
    if options is not None:
        return read_files(spark, walk(path, options, spark))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return decoded(reader.load(path).select(F.col("path").alias("file"), "content")).select("file", "text", "reason", "refusal")


def read_for_editor(spark: SparkSession, paths: list[str], most_bytes: int) -> DataFrame:
    """(file, text, state): read, too-large, not-text or unreadable; contents beyond the limit are never loaded."""
    open_, shut = _reachable(spark, paths)
    out = spark.createDataFrame([(p, None, "unreadable") for p, _ in shut], "file string, text string, state string")
    for found in _binary(spark, open_):
        out = editor_states(found, most_bytes).unionByName(out)
    return out


def editor_states(found: DataFrame, most_bytes: int) -> DataFrame:
    """(file, text, state) of (file, length, content): read, too-large or not-text. What is too large is told by its length, and its content not asked for."""
    small = found.where(F.col("length") <= most_bytes).select("file", editor_text(F.col("content")).alias("text"))
    small = small.withColumn("state", F.when(F.col("text").isNull(), "not-text").otherwise("read"))
    large = found.where(F.col("length") > most_bytes).select("file", F.lit(None).cast("string").alias("text"), F.lit("too-large").alias("state"))
    return small.unionByName(large)


def stdin(spark: SparkSession, content: bytes) -> DataFrame:
    """One document of bytes from a pipe."""
    return decoded(spark.createDataFrame([(STDIN, bytearray(content))], "file string, content binary")).select("file", "text", "reason", "refusal")
