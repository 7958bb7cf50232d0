"""Ignore rules of folders: which files of a listing a scan passes over.

A folder's rule file holds patterns, a line each, for all that lies below the folder. Patterns become regular
expressions in SQL functions; files and their folders meet the rules of the folders above them by equal folder names, so
the work is files x depth. Folders above very many entries, and ignored folders that hold very many files, are salted by counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.shared import save

NAME = ".gitignore"
#: A folder is salted beyond COMMON entries and 1/HOT of all entries, to parts of about that number.
COMMON, HOT = 100_000, 10_000
#: What a pattern is made of: folders in between, all below, an escape, a class, stars, a mark, letters.
PART = r"(?<![^/])\*\*/|(?<![^/])\*\*$|\\[\s\S]|\[[!^]?+(?:\\.|[^\\])(?:\\.|[^\]\\])*\]|\*+|\?|[^\\*?\[]+|[\s\S]"


def _expression(pattern: Column) -> Column:
    """The regular expression of a pattern without its marks for negation, folders and places."""
    quoted = lambda p: F.regexp_replace(p, r"([^\p{L}\p{N}/_ -])", r"\\$1")
    last = lambda e: F.substring(e, -1, 1)
    start = lambda r: F.when(r.startswith("\\"), F.substring(r, 2, 1)).otherwise(F.substring(r, 1, 1))

    def one_of(p: Column) -> Column:
        body = F.regexp_extract(p, r"(?s)^\[[!^]?(.*)\]$", 1)
        letters = F.transform(F.regexp_extract_all(body, F.lit(r"\\.|[\s\S]"), F.lit(0)), lambda e: F.when(e.isin("-", "\\-"), e).otherwise(quoted(last(e))))
        reversed_ = F.exists(F.regexp_extract_all(body, F.lit(r"(?:\\.|[^\\])-(?:\\.|[^\\])"), F.lit(0)), lambda r: start(r) > last(r))
        return F.when(reversed_, "(?!)").otherwise(F.concat(F.when(p.rlike(r"^\[[!^]"), "(?!/)[^").otherwise("(?!/)["), F.array_join(letters, ""), F.lit("]")))

    part = lambda p: (
        F.when(p == "**/", "(?:.*/)?")
        .when(p == "**", ".+")
        .when(p.rlike(r"^\*+$"), "[^/]*")
        .when(p == "?", "[^/]")
        .when(p.rlike(r"^\\.$"), quoted(F.substring(p, 2, 1)))
        .when(p.rlike(r"^\[.+\]$"), one_of(p))
        .otherwise(quoted(p))
    )
    # a pair of stars that doesn't stand for whole folders is one star; PART tells them apart by what is around them
    named = F.transform(F.regexp_extract_all(pattern, F.lit(PART), F.lit(0)), part)
    return F.array_join(named, "")


def rules(files: DataFrame) -> DataFrame:
    """folder and rules (an array of regex, negated, folders_only in the order of lines) of the rule files among files (file, text).

    Blank lines and lines that begin with `#` say nothing. `!` negates, a last `/` is for folders only, a `/` elsewhere binds
    a pattern to the rule file's own folder; other patterns hold at any depth below. `*` and `?` stop at a `/`, `**/` and `/**`
    don't, `?`, `[a-z]` and `[!a]` are one character (not one byte), `\\` takes the next one as it is. Blanks at a line's end go unless
    escaped. A class with a range from high to low is met by nothing, named classes aren't known. A null text has no rules, a null file is left out. Of rows that repeat a folder the least text counts.
    """
    held = files.filter(F.col("file").rlike(r"(^|/)\.gitignore$"))
    folder = F.regexp_replace(F.regexp_replace("file", r"\.gitignore$", ""), "/$", "")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: x.rlike(r"\S") & ~x.startswith("#"))

    def rule(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?<!\\) +$", "")
        negated = bare.startswith("!")
        bare = F.regexp_replace(bare, "^!", "")
        folders = bare.endswith("/")
        bare = F.regexp_replace(bare, "/$", "")
        bound = bare.contains("/")
        regex = F.concat(F.lit("(?s)^"), F.when(bound, "").otherwise("(?:.*/)?"), _expression(F.regexp_replace(bare, "^/", "")), F.lit("$"))
        return F.struct(regex.alias("regex"), negated.alias("negated"), folders.alias("folders_only"))

    found = held.select(folder.alias("folder"), "text").groupBy("folder").agg(F.min("text").alias("text"))
    return found.select("folder", F.filter(F.transform(lines, rule), lambda r: r["regex"] != "(?s)^(?:.*/)?$").alias("rules")).filter(F.size("rules") > 0)


def _meet(entries: DataFrame, named: DataFrame) -> DataFrame:
    """entries (with a column folder) joined to the one row of named for their folder; folders of many entries are salted."""
    counts = save(entries.groupBy("folder").agg(F.count("*").alias("_n")).join(named.select("folder"), "folder", "left_semi"), "folders")
    part = max(COMMON, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT)
    large = counts.filter(F.col("_n") > part).select("folder", F.ceil(F.col("_n") / part).cast("int").alias("_salts"))  # fewer than HOT rows
    left = entries.join(F.broadcast(large), "folder", "left").withColumn("_salt", F.pmod(F.xxhash64("entry"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = named.join(F.broadcast(large), "folder", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, ["folder", "_salt"]).drop("_salt")


def _above(entry: Column) -> Column:
    """The folders above a path, the root (the empty path) first."""
    steps = F.split(entry, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def judged(files: DataFrame, ruled: DataFrame) -> DataFrame:
    """files with a column ignored: whether the rules of the folders above it, or above one of its folders, leave the file out.

    files has a column file, paths with `/` from the scan's root; ruled is of rules(). Of the rules that match an entry the
    last one in the deepest folder decides; what lies in an ignored folder is ignored, whatever other rules say. Other
    columns stay, every row is returned, repeated ones too; a null file is never ignored. A column named ignored is
    replaced.
    """
    paths = files.select("file").filter("file <> ''").distinct()
    above = paths.select("file", F.explode(_above(F.col("file"))).alias("folder"))
    entries = paths.select(F.col("file").alias("entry"), F.lit(False).alias("is_folder")).unionByName(above.filter("folder <> ''").select(F.col("folder").alias("entry"), F.lit(True).alias("is_folder")).distinct())
    asked = entries.select("entry", "is_folder", F.explode(_above(F.col("entry"))).alias("folder"))
    rest = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(folder) + 2)"))
    met = _meet(asked, ruled).withColumn("rest", rest)
    hit = F.filter("rules", lambda r: (F.col("is_folder") | ~r["folders_only"]) & F.regexp_like(F.col("rest"), r["regex"]))
    last = F.struct(F.length("folder").alias("depth"), F.element_at("hit", -1)["negated"].alias("negated"))
    verdicts = met.withColumn("hit", hit).filter(F.size("hit") > 0).groupBy("entry", "is_folder").agg(F.max(last).alias("last"))
    out = save(verdicts.filter("not last.negated").select("entry", "is_folder"), "ignored")
    under = _meet(above.withColumnRenamed("file", "entry"), out.filter("is_folder").select(F.col("entry").alias("folder"))).select("entry")
    gone = out.filter("not is_folder").select("entry").unionByName(under).distinct()
    return files.drop("ignored").join(gone.select(F.col("entry").alias("file"), F.lit(True).alias("ignored")), "file", "left").select(*[c for c in files.columns if c != "ignored"], F.coalesce("ignored", F.lit(False)).alias("ignored"))


def scan(files: DataFrame) -> DataFrame:
    """The rows of files (file, text) that the rule files among them leave in, without the rule files themselves."""
    kept = judged(files, rules(files)).filter("not ignored").drop("ignored")
    return kept.filter(~F.coalesce(F.col("file").rlike(r"(^|/)\.gitignore$"), F.lit(False)))
