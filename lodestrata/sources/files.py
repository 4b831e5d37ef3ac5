"""Sources and sinks: source trees, build manifests, module aliases, templates, class files, Markdown and CSV reports.

Readers of one file's bytes or text are plain functions; the table readers apply them to Spark's file sources, so that
listing, splitting and retries are Spark's.
"""

from __future__ import annotations

import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: folders never read, the largest source file, and what a file's extension makes it
SKIP_DIRS = "node_modules .git .svn .hg target build dist out bin obj .gradle .idea .vscode __pycache__ venv coverage".split()
MAX_BYTES = 1_000_000
CLASSES = {"java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "html": "template", "json": "manifest", "xml": "manifest", "gradle": "manifest"}


def as_text(data: bytes) -> tuple[str, str]:
    """(text with LF line ends and no mark, how it was written)."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        form, t = "utf-16", data.decode("utf-16", "replace")
    else:
        form, t = ("utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else "utf-8"), data.decode("utf-8-sig", "replace")
    if "\r\n" in t:
        form += "+crlf"
    return t.replace("\r\n", "\n").replace("\r", "\n"), form


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, sha256, lines, form, content) of a folder's source files; build folders, dot folders and files
    over a megabyte are left out before their bytes are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    parts = F.split(rel, "/")
    bad = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(SKIP_DIRS) | p.startswith("."))
    ext = F.lower(F.regexp_extract(rel, r"\.(\w+)$", 1))
    f = f.where((F.col("length") <= MAX_BYTES) & ext.isin(list(CLASSES)) & ~bad).select(rel.alias("path"), F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])[ext].alias("language"), F.sha2("content", 256).alias("sha256"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [as_text(bytes(x)) for x in pdf["content"]]
            yield pdf.assign(lines=[t.count("\n") + bool(t and not t.endswith("\n")) for t, _ in got], form=[m for _, m in got], content=[t for t, _ in got])[["path", "language", "sha256", "lines", "form", "content"]]

    return f.mapInPandas(decode, "path string, language string, sha256 string, lines int, form string, content string")


def manifest(name: str, text: str) -> list[tuple[str, str, str, str]]:
    """(ecosystem, name, version, scope) of the dependencies a build file declares. Managed versions and plugins are none."""
    out: list[tuple[str, str, str, str]] = []
    try:
        if name.endswith("package.json"):
            d = json.loads(text)
            for key, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
                out += [("npm", k, str(v), scope) for k, v in (d.get(key) or {}).items()]
        elif name.endswith("pom.xml"):
            root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
            props = {f"${{{p.tag}}}": (p.text or "").strip() for p in root.findall("properties/*")}
            for dep in root.findall("dependencies/dependency"):
                g = lambda t, dep=dep: (dep.findtext(t) or "").strip()
                v = g("version")
                out.append(("maven", f"{g('groupId')}:{g('artifactId')}", props.get(v, v), g("scope") or "compile"))
        elif name.endswith((".gradle", ".gradle.kts")):
            pat = r"^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly))\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+)(?::([^'\"]+))?['\"]"
            out += [("maven", f"{m[2]}:{m[3]}", m[4] or "", m[1]) for m in re.finditer(pat, text, re.M)]
    except (ValueError, ET.ParseError):
        return []
    return out


def relaxed_json(text: str):
    """A JSON value in which comments may stand between tokens and a comma may follow the last item; ValueError otherwise.

    Tokens are read one by one: a string ends at its own quote, so what looks like a comment or a comma in it stays.
    """
    tokens: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c == '"':
            end = i + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            tokens.append(text[i : end + 1])
            i = end + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            i = text.find("*/", i + 2) + 2
            if i < 2:
                raise ValueError("comment does not end")
        elif c in "{}[]:,":
            if c in "}]" and tokens and tokens[-1] == ",":
                tokens.pop()
            tokens.append(c)
            i += 1
        elif c.isspace():
            i += 1
        else:
            end = i
            while end < len(text) and not text[end].isspace() and text[end] not in '{}[]:,"/':
                end += 1
            tokens.append(text[i : max(end, i + 1)])
            i = max(end, i + 1)
    return json.loads(" ".join(tokens))


def aliases(text: str) -> dict[str, list[str]]:
    """Path aliases of a compiler configuration: pattern -> folders, below the configured base folder."""
    try:
        conf = relaxed_json(text)
    except ValueError:
        return {}
    options = conf.get("compilerOptions") if isinstance(conf, dict) else None
    if not isinstance(options, dict):
        return {}
    root = [p for p in str(options.get("baseUrl") or "").split("/") if p not in ("", ".")]
    out: dict[str, list[str]] = {}
    for pattern, folders in (options.get("paths") or {}).items():
        out[pattern] = ["/".join([*root, *(p for p in f.split("/") if p not in ("", "."))]) for f in folders if isinstance(f, str)]
    return out


def template(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line): components (dashed tags), bound members and event handlers of a component template."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        out += [("component", m.group(1).lower(), n) for m in re.finditer(r"<([a-zA-Z]\w*-[\w-]+)", line)]
        for m in re.finditer(r"(\[\(?[\w.]+\)?\]|\([\w.]+\)|\*\w+)\s*=\s*\"([^\"]*)\"", line):
            out += [("handler" if m.group(1).startswith("(") else "member", w, n) for w in re.findall(r"(?<![.\w'\"])([A-Za-z_]\w*)", re.sub(r"'[^']*'", "", m.group(2))) if w not in ("let", "of", "true", "false", "null", "as", "index")]
        out += [("member", m.group(1), n) for m in re.finditer(r"\{\{\s*([A-Za-z_]\w*)", line)]
    return out


def descriptor(d: str) -> tuple[list[str], str]:
    """Parameter types and return type of a method descriptor."""
    prims = dict(zip("BCDFIJSZV", "byte char double float int long short boolean void".split(), strict=True))

    def one(i: int) -> tuple[str, int]:
        dims = 0
        while d[i] == "[":
            i, dims = i + 1, dims + 1
        if d[i] == "L":
            j = d.index(";", i)
            return d[i + 1 : j].replace("/", ".").replace("$", ".") + "[]" * dims, j + 1
        return prims[d[i]] + "[]" * dims, i + 1

    i, ps = 1, []
    while d[i] != ")":
        t, i = one(i)
        ps.append(t)
    return ps, one(i + 1)[0]


def class_file(data: bytes) -> dict | None:
    """name, super, interfaces and public or protected members of a compiled class; None if it is none."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        return None
    (count,) = struct.unpack_from(">H", data, 8)
    pos, pool, i = 10, {}, 1
    size = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
    while i < count:
        tag = data[pos]
        if tag == 1:
            (n,) = struct.unpack_from(">H", data, pos + 1)
            pool[i] = data[pos + 3 : pos + 3 + n].decode("utf-8", "replace")
            pos += 3 + n
        else:
            if tag == 7:
                (pool[i],) = struct.unpack_from(">H", data, pos + 1)
            pos += 1 + size[tag]
        i += 2 if tag in (5, 6) else 1
    named = lambda k: pool[pool[k]].replace("/", ".").replace("$", ".") if k else ""
    access, this, sup, n_if = struct.unpack_from(">HHHH", data, pos)
    pos += 8
    ifs = [named(struct.unpack_from(">H", data, pos + 2 * k)[0]) for k in range(n_if)]
    pos += 2 * n_if
    members = []
    for what in ("field", "method"):
        (n,) = struct.unpack_from(">H", data, pos)
        pos += 2
        for _ in range(n):
            flags, name, desc, n_attr = struct.unpack_from(">HHHH", data, pos)
            pos += 8
            for _ in range(n_attr):
                (ln,) = struct.unpack_from(">I", data, pos + 2)
                pos += 6 + ln
            if flags & 5 and not flags & 0x1000:
                members.append((what, pool[name], pool[desc], bool(flags & 8)))
    return {"name": named(this), "super": named(sup), "interfaces": ifs, "public": bool(access & 1), "interface": bool(access & 0x200), "members": members}


def archive_rows(data: bytes) -> Iterator[tuple[str, str, str, int, str, bool]]:
    """(qualified, kind, owner, params, returns, is_static) of the public classes in a jar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            c = class_file(z.read(n)) if n.endswith(".class") else None
            if not c or not c["public"]:
                continue
            yield c["name"], "interface" if c["interface"] else "class", "", -1, "", False
            for what, name, desc, static in c["members"]:
                ps, ret = descriptor(desc) if what == "method" else ([], descriptor(f"(){desc}")[1])
                yield f"{c['name']}#{name}", what, c["name"], len(ps) if what == "method" else -1, ret, static


def library(spark: SparkSession, paths: str) -> DataFrame:
    """Members of all jars under a path, one task per jar."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in archive_rows(bytes(c))], columns=["jar", "qualified", "kind", "owner", "params", "returns", "is_static"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").option("recursiveFileLookup", "true").load(paths)
    return f.select("path", "content").mapInPandas(read, "jar string, qualified string, kind string, owner string, params int, returns string, is_static boolean")


class HistorySource(DataSource):
    """A table over exported ``log --numstat``-like text: one partition per file of the folder in option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "commit string, author string, day string, path string, added int, removed int"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options["path"])


class _HistoryReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(f"{self.path}/*.log"))]

    def read(self, partition):
        commit = author = day = ""
        for line in open(partition.value, encoding="utf-8"):
            if line.startswith("commit\t"):
                _, commit, author, day = line.rstrip("\n").split("\t")
            elif m := re.match(r"(\d+|-)\t(\d+|-)\t(.+)$", line):
                yield commit, author, day, m[3], int(m[1]) if m[1] != "-" else None, int(m[2]) if m[2] != "-" else None


# ---- sinks


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown_rows(df: DataFrame, columns: list[str], out: str = "line") -> DataFrame:
    """One Markdown table line per row; pipes are escaped and line ends become spaces."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return df.withColumn(out, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")))


def collection_markdown(pins: DataFrame) -> DataFrame:
    """(collection_id, markdown): a collection's pins in order of adding, each with its citation and note."""
    quote = F.concat(F.lit("> "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", "\n> "))
    item = F.concat_ws("\n\n", F.concat(F.lit("**"), F.coalesce("citation", F.lit("")), F.lit("**")), quote, F.nullif(F.coalesce("note", F.lit("")), F.lit("")))
    g = pins.dropDuplicates(["pin_key"]).groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("added_at", "pin_key", item.alias("md")))).alias("xs"))
    return g.select("collection_id", F.array_join(F.transform("xs", lambda x: x["md"]), "\n\n---\n\n").alias("markdown"))


JAVA_IMPORT = r"(?m)^[ \t]*import[ \t]+(static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"
JAVA_PACKAGE = r"(?m)^[ \t]*package[ \t]+([\w.]+)[ \t]*;"
SCRIPT_FROM = r"(?m)^[ \t]*(?:import|export)\b([^;'\"()]*?)\bfrom[ \t]*['\"]([^'\"\n]+)['\"]"
SCRIPT_BARE = r"(?m)^[ \t]*import[ \t]*['\"]([^'\"\n]+)['\"]"
SCRIPT_REQUIRE = r"\brequire\([ \t]*['\"]([^'\"\n]+)['\"][ \t]*\)"


def bare_code(content: Column | str) -> Column:
    """Source text with its comments blanked, strings kept. Escapes in strings are honoured; a template literal is a string.

    The repeated groups are possessive: Java matches these in a loop and all others by recursion, which a long string overflows."""
    c = F.col(content) if isinstance(content, str) else content
    keep = r"(\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)|//[^\n]*|(?s:/\*.*?\*/)"
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), keep, "$1")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, codebase_id, form, spec, names) read from source files (file_id, codebase_id, path, content): Java imports
    (form ``type``, ``static``, ``package`` for a wildcard), script imports (``from``, ``bare``, ``require``; names is the
    import clause). Comments are no imports; repeated rows and repeated imports count once. Null content has none."""
    x = files.select("file_id", "codebase_id", "path", bare_code("content").alias("code")).where("code is not null").distinct()
    java = F.lower("path").endswith(".java")
    j = x.where(java).select("file_id", "codebase_id", F.explode(F.regexp_extract_all("code", F.lit(JAVA_IMPORT), F.lit(0))).alias("m"))
    is_static, name = F.regexp_extract("m", JAVA_IMPORT, 1) != "", F.regexp_extract("m", JAVA_IMPORT, 2)
    j = j.select("file_id", "codebase_id", F.when(is_static, "static").when(name.endswith(".*"), "package").otherwise("type").alias("form"), name.alias("spec"), F.lit("").alias("names"))
    s = x.where(F.lower("path").rlike(r"\.[cm]?[jt]sx?$"))
    f = s.select("file_id", "codebase_id", F.explode(F.regexp_extract_all("code", F.lit(SCRIPT_FROM), F.lit(0))).alias("m"))
    f = f.select("file_id", "codebase_id", F.lit("from").alias("form"), F.regexp_extract("m", SCRIPT_FROM, 2).alias("spec"), F.trim(F.regexp_replace(F.regexp_extract("m", SCRIPT_FROM, 1), r"\s+", " ")).alias("names"))
    one = lambda pat, form: s.select("file_id", "codebase_id", F.explode(F.regexp_extract_all("code", F.lit(pat), F.lit(1))).alias("spec")).select("file_id", "codebase_id", F.lit(form).alias("form"), "spec", F.lit("").alias("names"))
    return j.unionByName(f).unionByName(one(SCRIPT_BARE, "bare")).unionByName(one(SCRIPT_REQUIRE, "require")).distinct()


def link_java_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, form, spec, target_file): Java imports of a codebase's own types, by equality on the qualified name that a
    file's package clause and name give; of a static import the type before the member; null for what lies outside. Wildcards
    link to nothing: they name no file."""
    own = files.where(F.lower("path").endswith(".java")).select("codebase_id", "file_id", F.regexp_extract(bare_code("content"), JAVA_PACKAGE, 1).alias("pkg"), F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("type"))
    own = own.select(F.col("codebase_id").alias("o_base"), F.when(F.col("pkg") == "", F.col("type")).otherwise(F.concat_ws(".", "pkg", "type")).alias("o_name"), "file_id").groupBy("o_base", "o_name").agg(F.min("file_id").alias("target_file"))
    x = found.where("form in ('type', 'static')").withColumn("name", F.when(F.col("form") == "static", F.regexp_replace("spec", r"\.[^.]*$", "")).otherwise(F.col("spec")))
    return x.join(own, (F.col("codebase_id") == F.col("o_base")) & (F.col("name") == F.col("o_name")), "left").select("file_id", "form", "spec", "target_file")
