"""Listing a repository: ignore rules, skipped names, size limit, fingerprints, version-control differences."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from tessera.functions.text import language_of
from tessera.session import ship

# Fixed values.
SKIP_NAMES = ("node_modules", "venv", "__pycache__", "coverage", "vendor", "out")
MAX_FILE_BYTES = 5 * 1024 * 1024
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    base: str  # folder of the ignore file, relative, "" for the root
    pattern: re.Pattern
    negated: bool
    only_dirs: bool


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse_rules(text: str, base: str = "") -> list[Rule]:
    """Rules of an ignore file in gitignore syntax."""
    rules = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line[1:] if line.startswith("!") else line
        only_dirs, line = line.endswith("/"), line.rstrip("/").lstrip("\\")
        anchored = "/" in line
        body = _translate(line.lstrip("/"))
        rules.append(Rule(base, re.compile(body if anchored else f"(?:.*/)?{body}"), negated, only_dirs))
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that matches this relative path ignores it."""
    out = False
    for rule in rules:
        if rule.base and not path.startswith(rule.base + "/"):
            continue
        local = path[len(rule.base) + 1 :] if rule.base else path
        if (is_dir or not rule.only_dirs) and rule.pattern.fullmatch(local):
            out = not rule.negated
    return out


def list_files(
    root: str, exclude: tuple[str, ...] = (), ignore_file: str | None = None, max_bytes: int = MAX_FILE_BYTES, under: str = "", levels: int | None = None
) -> list[tuple[str, int, int]]:
    """(relative path, bytes, modification time) of the files of a folder, in order; subtrees that are ignored, hidden or
    of a skipped name are not entered. `under` lists one folder of the root, by the same rules; with `levels`, that many
    folders below it are entered, and those that are not are rows of -1 bytes."""
    out, skip = [], {*SKIP_NAMES, *exclude}
    start = under.split("/") if under else []

    def enter(folder: str, rules: list[Rule]) -> None:
        full = os.path.join(root, folder)
        depth = folder.count("/") + 1 if folder else 0
        names = sorted(os.listdir(full))
        for name in [*IGNORE_FILES, *([ignore_file] if ignore_file and not folder else [])]:
            if name in names or name == ignore_file and os.path.isfile(os.path.join(full, name)):
                with open(os.path.join(full, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, *parse_rules(f.read(), folder)]
        for name in names if depth >= len(start) else [n for n in names if n == start[depth]]:
            path = f"{folder}/{name}" if folder else name
            where = os.path.join(full, name)
            is_dir = os.path.isdir(where)
            if name.startswith(".") or name in skip or os.path.islink(where) or ignored(path, is_dir, rules):
                continue
            if is_dir and levels is not None and depth >= len(start) + levels:
                out.append((path, -1, 0))
            elif is_dir:
                enter(path, rules)
            elif depth >= len(start):
                info = os.stat(where)
                if info.st_size <= max_bytes:
                    out.append((path, info.st_size, int(info.st_mtime)))

    enter("", [])
    return out


def scan(spark: SparkSession, root: str, alias: str, **options) -> DataFrame:
    """path (alias/relative), repo, size, modified, content, hash, language. The driver lists, executors read the contents
    (so the root must be a folder that they see)."""
    return read_files(spark, root, alias, list_files(root, **options))


def list_one(root: str, relative: str, max_bytes: int = MAX_FILE_BYTES) -> list[tuple[str, int, int]]:
    """The same for one file, without a look at the others: empty if it is gone, hidden, skipped, ignored or too large."""
    where, parts, rules = os.path.join(root, relative), relative.split("/"), []
    if any(p.startswith(".") or p in SKIP_NAMES for p in parts) or not os.path.isfile(where) or os.path.islink(where):
        return []
    for n, part in enumerate(parts):
        folder = "/".join(parts[:n])
        for name in IGNORE_FILES:
            if os.path.isfile(os.path.join(root, folder, name)):
                with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                    rules += parse_rules(f.read(), folder)
        if ignored("/".join(parts[: n + 1]), n + 1 < len(parts), rules):
            return []
    info = os.stat(where)
    return [(relative, info.st_size, int(info.st_mtime))] if info.st_size <= max_bytes else []


def read_files(spark: SparkSession, root: str, alias: str, listed: list[tuple[str, int, int]]) -> DataFrame:
    """Contents of listed files, read by the executors."""
    ship(spark)
    names = spark.createDataFrame([(alias, p, s, t) for p, s, t in listed], "repo string, relative string, size long, modified long")
    names = names.repartition(max(1, min(len(listed) // 64 + 1, 10_000)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            data = []
            for p in batch.column("relative").to_pylist():
                with open(os.path.join(root, p), "rb") as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])

    files = names.mapInArrow(read, "repo string, relative string, size long, modified long, content binary")
    path = F.concat("repo", F.lit("/"), "relative")
    return files.select(path.alias("path"), "repo", "size", "modified", "content", F.sha2("content", 256).alias("hash"), language_of(F.col("relative")).alias("language"))


def skipped(path: Column, exclude: tuple[str, ...] = (), history: str | None = None) -> Column:
    """Whether a single relative path is hidden or under a skipped name; what begins with `history`, the folder of the
    interaction log, is not."""
    path = F.regexp_replace(path, r"\\", "/")
    banned = F.array(*map(F.lit, (*SKIP_NAMES, *exclude)))
    parts = F.split(path, "/")
    found = F.exists(parts, lambda s: s.startswith(".")) | F.arrays_overlap(parts, banned)
    return found & ~path.startswith(history) if history else found


def change_set(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) with change new, changed, unchanged or deleted, from two tables of (path, hash)."""
    old = before.select("path", F.col("hash").alias("old_hash"))
    new = now.select("path", F.col("hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)


def uncommitted(root: str) -> set[str]:
    """Paths that differ from the last commit; empty if that cannot be told."""
    try:
        done = _git(root, "diff", "HEAD", "--name-only")
    except (OSError, subprocess.SubprocessError):
        return set()
    return {x for x in done.stdout.split("\n") if x} if done.returncode == 0 else set()


def valid_ref(ref: str) -> bool:
    """No option, no white space or control characters, none of the characters that references cannot hold."""
    return bool(ref) and not ref.startswith("-") and ".." not in ref and not re.search(r"[\s\x00-\x1f\x7f?*\[\\:]", ref)


def changed_since(root: str, base: str = "HEAD~1") -> list[str]:
    if not valid_ref(base):
        raise ValueError(f"not a reference: {base!r}")
    done = _git(root, "diff", base, "--name-only")
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return [x for x in done.stdout.split("\n") if x]


def safe_relative(path: str) -> str:
    """A path that stays inside its repository, with slashes."""
    clean = path.replace("\\", "/")
    if clean.startswith("/") or re.match(r"[A-Za-z]:", clean) or ".." in clean.split("/") or "\x00" in clean:
        raise ValueError(f"not inside the repository: {path!r}")
    return clean


def safe_path(path: Column) -> Column:
    """`safe_relative` of a column: the path with slashes, or null where it leaves its repository."""
    clean = F.regexp_replace(path, r"\\", "/")
    out = clean.startswith("/") | clean.rlike("^[A-Za-z]:") | F.array_contains(F.split(clean, "/"), "..") | clean.contains("\x00")
    return F.when(~out, clean)
