"""Symbol rules: which lines define something, by language.

The rules are data: for a language, a kind and a pattern whose first group is the name.  They
stand in for a tagger that is not part of this engine, so kinds follow these rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines

#: (language in lower case, kind, pattern), the first that fits a line wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("go", "func", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    ("go", "type", r"^type\s+([A-Za-z_]\w*)"),
    ("python", "class", r"^\s*class\s+([A-Za-z_]\w*)"),
    ("python", "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("javascript", "class", r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("java", "class", r"^\s*(?:public\s+|abstract\s+|final\s+)*class\s+([A-Za-z_]\w*)"),
    ("java", "interface", r"^\s*(?:public\s+)?interface\s+([A-Za-z_]\w*)"),
    ("rust", "function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"),
    ("rust", "struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"),
    ("rust", "trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)"),
    ("rust", "enum", r"^\s*(?:pub\s+)?enum\s+([A-Za-z_]\w*)"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "alias", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"),
    ("c", "macro", r"^\s*#\s*define\s+([A-Za-z_]\w*)"),
    ("c", "struct", r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+([A-Za-z_]\w*)\s*\{?$"),
    ("c", "function", r"^[A-Za-z_][\w \t*]*[ \t*]([A-Za-z_]\w*)\s*\([^;]*$"),
    ("c++", "macro", r"^\s*#\s*define\s+([A-Za-z_]\w*)"),
    ("c++", "namespace", r"^\s*namespace\s+([A-Za-z_]\w*)"),
    ("c++", "class", r"^\s*(?:class|struct|union|enum(?:\s+class)?)\s+([A-Za-z_]\w*)[^;]*$"),
    ("c++", "function", r"^[A-Za-z_][\w \t*&:<>,]*[ \t*&]((?:[A-Za-z_]\w*::)?~?[A-Za-z_]\w*)\s*\([^;]*$"),
    ("c#", "namespace", r"^\s*namespace\s+([A-Za-z_][\w.]*)"),
    ("c#", "class", r"^\s*(?:[a-z]+\s+)*(?:class|struct|record)\s+([A-Za-z_]\w*)"),
    ("c#", "interface", r"^\s*(?:[a-z]+\s+)*interface\s+([A-Za-z_]\w*)"),
    ("c#", "enum", r"^\s*(?:[a-z]+\s+)*enum\s+([A-Za-z_]\w*)"),
    ("c#", "method", r"^\s*(?:public|private|protected|internal)\s[\w<>\[\], ?]*\s([A-Za-z_]\w*)\s*\("),
    ("ruby", "module", r"^\s*module\s+([A-Z]\w*)"),
    ("ruby", "class", r"^\s*class\s+([A-Z]\w*)"),
    ("ruby", "method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"),
    ("php", "class", r"^\s*(?:abstract\s+|final\s+)?(?:class|trait)\s+([A-Za-z_]\w*)"),
    ("php", "interface", r"^\s*interface\s+([A-Za-z_]\w*)"),
    ("php", "function", r"^\s*(?:[a-z]+\s+)*function\s+&?([A-Za-z_]\w*)"),
    ("kotlin", "class", r"^\s*(?:[a-z]+\s+)*(?:class|object|interface)\s+([A-Za-z_]\w*)"),
    ("kotlin", "function", r"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)"),
    ("swift", "type", r"^\s*(?:[a-z]+\s+)*(?:class|struct|enum|protocol|extension)\s+([A-Za-z_]\w*)"),
    ("swift", "function", r"^\s*(?:@?[a-z]+\s+)*func\s+([A-Za-z_]\w*)"),
    ("scala", "class", r"^\s*(?:[a-z]+\s+)*(?:class|trait|object)\s+([A-Za-z_]\w*)"),
    ("scala", "function", r"^\s*(?:[a-z]+\s+)*def\s+([A-Za-z_]\w*)"),
    ("shell", "function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)"),
    ("sql", "table", r"^\s*(?i:create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?)([A-Za-z_][\w.]*)"),
    ("markdown", "section", r"^#{1,6}\s+(.*\S)"),
    ("html", "title", r"<title>([^<]*)</title>"),
    ("html", "h1", r"<h1[^>]*>([^<]*)</h1>"),
    ("html", "h2", r"<h2[^>]*>([^<]*)</h2>"),
    ("html", "a", r"<a [^>]*>([^<]*)</a>"),
    ("en", "heading", r"^([A-Z][a-z]+)"),
    ("fr", "heading", r"^([A-Z][a-z]+)"),
    ("de", "heading", r"^([A-Z][a-z]+)"),
    ("es", "heading", r"^([A-Z][a-z]+)"),
    ("unknown", "heading", r"^([A-Z][a-z]+)"),
)

#: Languages by file ending, for corpora that come without a language.
ENDINGS: tuple[tuple[str, str], ...] = (
    (".go", "Go"), (".py", "Python"), (".js", "JavaScript"), (".ts", "TypeScript"), (".java", "Java"), (".rs", "Rust"),
    (".c", "C"), (".h", "C"), (".cpp", "C++"), (".cs", "C#"), (".rb", "Ruby"), (".php", "PHP"), (".sh", "Shell"),
    (".html", "HTML"), (".css", "CSS"), (".json", "JSON"), (".yaml", "YAML"), (".yml", "YAML"), (".toml", "TOML"),
    (".tsx", "TypeScript"), (".jsx", "JavaScript"), (".mjs", "JavaScript"), (".cc", "C++"), (".cxx", "C++"), (".hpp", "C++"),
    (".hh", "C++"), (".m", "Objective-C"), (".lua", "Lua"), (".pl", "Perl"), (".r", "R"), (".jl", "Julia"), (".dart", "Dart"),
    (".ex", "Elixir"), (".exs", "Elixir"), (".erl", "Erlang"), (".hs", "Haskell"), (".ml", "OCaml"), (".clj", "Clojure"),
    (".groovy", "Groovy"), (".proto", "Protocol Buffer"), (".tf", "HCL"), (".xml", "XML"), (".bash", "Shell"), (".zsh", "Shell"),
    (".ps1", "PowerShell"), (".vue", "Vue"), (".zig", "Zig"), (".mk", "Makefile"), (".cmake", "CMake"), (".bzl", "Starlark"),
    (".scss", "SCSS"), (".ini", "INI"), (".csv", "CSV"), (".rst", "reStructuredText"), (".tex", "TeX"),
    (".md", "Markdown"), (".sql", "SQL"), (".scala", "Scala"), (".kt", "Kotlin"), (".swift", "Swift"), (".txt", "Text"),
)


#: Languages of files that go by their name alone, in lower case.
NAMES: tuple[tuple[str, str], ...] = (
    ("makefile", "Makefile"), ("gnumakefile", "Makefile"), ("dockerfile", "Dockerfile"), ("cmakelists.txt", "CMake"),
    ("rakefile", "Ruby"), ("gemfile", "Ruby"), ("jenkinsfile", "Groovy"), ("build.bazel", "Starlark"), ("go.mod", "Go Module"),
    (".bashrc", "Shell"), (".profile", "Shell"), (".gitignore", "Ignore List"),
)

#: Languages by the program that a script's first line names.
PROGRAMS: tuple[tuple[str, str], ...] = (
    ("python", "Python"), ("bash", "Shell"), ("zsh", "Shell"), ("sh", "Shell"), ("node", "JavaScript"), ("ruby", "Ruby"),
    ("perl", "Perl"), ("php", "PHP"), ("lua", "Lua"), ("rscript", "R"),
)


def language_of(path: Column, content: Column | None = None) -> Column:
    """Language by the file's name, the ending of the path, or the program that ``content`` begins by
    naming; null if they tell nothing."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    by_name = [F.when(name == own, F.lit(lang)) for own, lang in NAMES]
    by_end = [F.when(low.endswith(end), F.lit(lang)) for end, lang in ENDINGS]
    by_first = []
    if content is not None:
        first = F.lower(F.substring_index(F.substring(content, 1, 200), "\n", 1))
        program = F.regexp_extract(first, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*(?:\S*/)?)?([a-z]+)", 1)
        by_first = [F.when(program == own, F.lit(lang)) for own, lang in PROGRAMS]
    return F.coalesce(*by_name, *by_end, *by_first, F.lit(None).cast("string"))


def symbol_of(line: Column, lang: Column) -> Column:
    """Struct (name, kind) of the symbol that a line defines, or null."""
    key = F.lower(lang)
    by_lang: dict[str, list[tuple[str, str]]] = {}
    for own, kind, pattern in RULES:
        by_lang.setdefault(own, []).append((kind, pattern))
    none = F.lit(None).cast("struct<name:string,kind:string>")

    def first_rule(rules: list[tuple[str, str]]) -> Column:
        made = [
            F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("name"), F.lit(k).alias("kind")))
            for k, p in rules
        ]
        return F.coalesce(*made, none)

    return reduce(lambda rest, own: F.when(key == own, first_rule(by_lang[own])).otherwise(rest), by_lang, none)


def symbols(corpus: DataFrame) -> DataFrame:
    """``(path, repo, line_number, name, kind)``: one row for each line that defines a symbol."""
    lines = corpus.select("path", "repo", "lang", F.posexplode(split_lines(F.col("content"))).alias("pos", "line"))
    found = lines.withColumn("s", symbol_of(F.col("line"), F.coalesce("lang", F.lit("unknown")))).where("s is not null")
    return found.select("path", "repo", (F.col("pos") + 1).alias("line_number"), "s.name", "s.kind")
