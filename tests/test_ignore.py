"""Ignore rules against a plain matcher that walks a tree from its root."""

import itertools
import random
import shutil
import subprocess

import pytest

from recollect.operators import ignore


def wild(p: str, s: str) -> bool:
    """Whether a pattern without a place equals a path, letter by letter."""
    if not p:
        return not s
    if p[:3] == "**/":
        return wild(p[3:], s) or any(s[i] == "/" and wild(p[3:], s[i + 1 :]) for i in range(len(s)))
    if p == "/**":
        return len(s) > 1 and s[0] == "/"
    if p[0] == "*":
        rest = p.lstrip("*")
        return any("/" not in s[:i] and wild(rest, s[i:]) for i in range(len(s) + 1))
    if not s:
        return False
    if p[0] == "?":
        return s[0] != "/" and wild(p[1:], s[1:])
    if p[0] == "[":
        end = p.index("]", 2)
        body, no = (p[2:end], True) if p[1] in "!^" else (p[1:end], False)
        chars = set()
        for i, c in enumerate(body):
            if c == "-" and 0 < i < len(body) - 1:
                chars |= set(map(chr, range(ord(body[i - 1]), ord(body[i + 1]) + 1)))
            else:
                chars.add(c)
        return s[0] != "/" and (s[0] in chars) != no and wild(p[end + 1 :], s[1:])
    if p[0] == "\\":
        return p[1:2] == s[0] and wild(p[2:], s[1:])
    if p[0] == "/" and p[1:4] == "**/":
        return s[0] == "/" and wild(p[1:], s[1:])
    return p[0] == s[0] and wild(p[1:], s[1:])


def ignored(path: str, files: dict[str, str]) -> bool:
    steps = path.split("/")
    for n in range(1, len(steps) + 1):
        entry, is_folder, state = "/".join(steps[:n]), n < len(steps), False
        for depth in range(n):
            folder = "/".join(steps[:depth])
            text, rest = files.get(f"{folder}/.gitignore".lstrip("/"), ""), "/".join(steps[depth:n])
            for line in text.split("\n"):
                if not line.strip() or line.startswith("#"):
                    continue
                while line.endswith(" ") and not line.endswith("\\ "):
                    line = line[:-1]
                no, line = line.startswith("!"), line.removeprefix("!")
                only, line = line.endswith("/"), line.removesuffix("/")
                if only and not is_folder:
                    continue
                at = [rest] if "/" in line else ["/".join(rest.split("/")[i:]) for i in range(rest.count("/") + 1)]
                if any(wild(line.removeprefix("/"), s) for s in at):
                    state = not no
        if state:
            return True
    return False


PATTERNS = [
    "*.log", "!keep.log", "build/", "/out", "docs/*.txt", "**/tmp", "a/**/z.py", "lib/**", "!lib/b.py", "?.py", "[ab].txt", "[!a-c].log", "x y", "# note", "", "\\#odd", "\\!odd",
    "end\\ ", "trail   ", "*.p*", "!/out/b.py", "docs", "**", "***", "a**", "z.p[xy]", "a.b", "(x)", "sub/", "!sub/", "!*.log", "/*/b.py", "$x^", "*/", "{a}+",
]
NAMES = ["a", "build", "out", "docs", "lib", "sub", "tmp", "x y"]
LEAVES = ["b.py", "z.py", "keep.log", "d.log", "a.txt", "aXb", "a.b", "#odd", "!odd", "end ", "trail", "(x)", "$x^", "{a}+", "tmp", "ü.log", "-"]


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_a_tree_of_a_thousand_paths(spark, seed):
    draw = random.Random(seed)
    paths = sorted({"/".join([*draw.choices(NAMES, k=draw.randrange(4)), draw.choice(LEAVES)]) for _ in range(2600)})
    folders = sorted({"/".join(p.split("/")[:n]) for p in paths for n in range(p.count("/") + 1)})
    files = {f"{f}/.gitignore".lstrip("/"): "\n".join(draw.choices([p for p in PATTERNS if f or p not in ("**", "***", "*/", "!*.log")], k=draw.randrange(1, 5))) for f in draw.sample(folders, len(folders) // 4)}
    files[".gitignore"] = "*.log\n!keep.log\r\nbuild/\n/out\n**/tmp\n!docs/tmp\n"
    plain = {f: t.replace("\r", "") for f, t in files.items()}
    assert len(paths) >= 1000
    df = spark.createDataFrame([(p, "") for p in paths] + list(files.items()), "file string, text string")
    got = {r["file"]: r["ignored"] for r in ignore.judged(df, ignore.rules(df)).collect()}
    wrong = [p for p in [*paths, *files] if got[p] != ignored(p, plain)]
    assert not wrong and 100 < sum(got.values()) < len(paths)


def test_each_pattern_by_itself(spark):
    paths = ["/".join(p) for p in itertools.chain(itertools.product(LEAVES), itertools.product(NAMES, LEAVES), itertools.product(["a", "lib"], NAMES, ["b.py", "z.py", "tmp"]))]
    df = spark.createDataFrame([(f"{i}/{p}", "") for i in range(len(PATTERNS)) for p in paths] + [(f"{i}/.gitignore", p) for i, p in enumerate(PATTERNS)], "file string, text string")
    got = {r["file"]: r["ignored"] for r in ignore.judged(df, ignore.rules(df)).collect()}
    wrong = [(PATTERNS[i], p) for i in range(len(PATTERNS)) for p in paths if got[f"{i}/{p}"] != ignored(p, {".gitignore": PATTERNS[i]})]
    assert not wrong


def test_hot_folders_repeated_rows_nulls_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ignore, "COMMON", 5)
    rows = [(f"big/{i}.log", "t", i, 9) for i in range(60)] + [(f"{i}.py", None, i, 9) for i in range(30)] + [("0.py", "again", 1, 9), (None, "x", 2, 9), ("", "x", 2, 9)]
    rows += [(".gitignore", "big/\n3.py", 0, 9), ("none/.gitignore", None, 0, 9), (".gitignore", "zzz", 0, 9)]
    df = spark.createDataFrame(rows, "file string, text string, entry int, ignored int")
    got = ignore.judged(df, ignore.rules(df))
    assert got.columns == ["file", "text", "entry", "ignored"] and got.count() == len(rows)
    assert {r["file"] for r in got.filter("ignored").collect()} == {f"big/{i}.log" for i in range(60)} | {"3.py"}
    assert sorted(r["entry"] for r in got.filter("file = '0.py'").collect()) == [0, 1]
    assert {r["file"] for r in ignore.scan(df).collect()} == {f"{i}.py" for i in range(30) if i != 3} | {None, ""}
    none = df.limit(0)
    assert ignore.judged(none, ignore.rules(none)).collect() == [] and ignore.judged(df, ignore.rules(none)).filter("ignored").count() == 0


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_as_git_decides(spark, tmp_path):  # which takes bytes, not letters, for `?`
    draw = random.Random(5)
    paths = sorted({"/".join([*draw.choices(NAMES, k=draw.randrange(4)), draw.choice([n for n in LEAVES if n not in ("tmp", "ü.log")])]) for _ in range(1500)})
    folders = sorted({"/".join(p.split("/")[:n]) for p in paths for n in range(p.count("/") + 1)})
    files = {f"{f}/.gitignore".lstrip("/"): "\n".join(draw.choices([p for p in PATTERNS if f or p not in ("**", "***", "*/", "!*.log")], k=draw.randrange(1, 5))) for f in draw.sample(folders, len(folders) // 4)}
    for name, text in {**dict.fromkeys(paths, ""), **files}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(paths), capture_output=True, text=True).stdout
    df = spark.createDataFrame([(p, "") for p in paths] + list(files.items()), "file string, text string")
    got = {r["file"] for r in ignore.judged(df, ignore.rules(df)).filter("ignored").collect()} & set(paths)
    assert got == set(said.split("\0")) - {""}


def test_odd_classes_break_nothing(spark):
    asked = {"[z-a]": [], "[!]": ["[!]"], "[]": ["[]"], "[]a]": ["]", "a"], "[!]a]": ["b", "z", "-", "&", "\\", "["], "[\\]a]": ["]", "a"], "[a\\-c]": ["a", "c", "-"], "[": ["["], "[a&&b]": ["a", "b", "&"], "[[a]": ["[", "a"], "\\": [], "[\\d]": ["d"], "(": ["("], "[a--]": [], "a{2}": ["a{2}"]}
    names = ["a", "b", "c", "d", "z", "-", "&", "]", "[", "[]", "[!]", "\\", "(", "a{2}"]
    asked["[!]a]"] += ["c", "d", "("]
    df = spark.createDataFrame([(f"{i}/{n}", "") for i in range(len(asked)) for n in names] + [(f"{i}/.gitignore", p) for i, p in enumerate(asked)], "file string, text string")
    got = {p: set() for p in asked}
    for r in ignore.judged(df, ignore.rules(df)).filter("ignored").collect():
        i, name = r["file"].split("/", 1)
        got[list(asked)[int(i)]].add(name)
    assert {p: sorted(n - {".gitignore"}) for p, n in got.items() if p != "\\"} == {p: sorted(n) for p, n in asked.items() if p != "\\"}
