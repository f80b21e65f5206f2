"""Language names, skip lists, boundary patterns, repository states.

These tables decide results, so they are written out as text. Patterns use only syntax that the
Java and RE2 regex dialects share (no look-around, no \\w or \\s).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.text import as_column, suffix

# File suffix -> language.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".rb": "ruby",
}

# Directories that are never entered (as is every directory starting with a dot).
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".pytest_cache", "vendor", "dist", "build", ".next",
    ".nuxt", "coverage", ".venv", "venv", "env", ".mypy_cache", ".ruff_cache", "target", "bin",
    "obj", ".gradle", ".idea", ".vscode",
]

# Lock files by exact name; generated files by pattern.
SKIP_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "go.sum",
]
SKIP_GLOBS = ["*.min.js", "*.min.css", "*.map"]

# Life cycle of a repository.
STATES = ["queued", "cloning", "chunking", "embedding", "ready", "failed"]

# Accepted repository address.
REPO_URL = r"^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$"
REPO_HOST = "github.com/"

ID = r"[\p{L}_$][\p{L}\p{N}_$]*"
CONTROL = (r"^[ \t]*(?:if|else|for|while|do|switch|case|catch|try|with|return|throw|new|await"
           r"|typedef|using|goto|delete|function|class|import|export|package)(?:[^\p{L}\p{N}_$]|$)")


@dataclass(frozen=True)
class Boundary:
    """A line that opens a unit: its type, the pattern (group 1 = name), and an exclusion."""

    type: str
    pattern: str
    unless: str | None = None


_JS_METHOD = (r"^[ \t]+(?:(?:public|private|protected|static|readonly|override|async|get|set)[ \t]+)*"
              rf"[*#]?({ID})[ \t]*(?:<[^>]*>)?\(.*\{{[ \t]*$")
_JS_VALUE = rf"^[ \t]*(?:const|let|var)[ \t]+({ID})[^=]*=[ \t]*"
_JS_COMMON = [
    Boundary("export_statement", r"^[ \t]*export(?:[ \t{*]|$)"),
    Boundary("class_declaration", rf"^[ \t]*class[ \t]+({ID})"),
    Boundary("function_declaration", rf"^[ \t]*(?:async[ \t]+)?function[ \t]+({ID})"),
    Boundary("arrow_function",
             _JS_VALUE + rf"(?:async[ \t]*)?(?:<[^>]*>)?(?:\(.*\)[^=]*|{ID}[ \t]*)=>"),
    Boundary("function_expression", _JS_VALUE + r"(?:async[ \t]+)?function(?:[^\p{L}\p{N}_$]|$)"),
    Boundary("class_expression", _JS_VALUE + r"class(?:[^\p{L}\p{N}_$]|$)"),
    Boundary("method_definition", _JS_METHOD, CONTROL),
]
_TS_TYPES = [
    Boundary("interface_declaration", rf"^[ \t]*interface[ \t]+({ID})"),
    Boundary("type_alias_declaration", rf"^[ \t]*type[ \t]+({ID})[^=]*="),
]
_RUST_VIS = r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?"
_JAVA_MODS = (r"(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native"
              r"|default|strictfp)[ \t]+)*")

# Per language, the lines that open a unit, tried in order.
BOUNDARIES: dict[str, list[Boundary]] = {
    "python": [
        Boundary("class_definition", rf"^[ \t]*class[ \t]+({ID})"),
        Boundary("function_definition", rf"^[ \t]*def[ \t]+({ID})"),
        Boundary("async_function_definition", rf"^[ \t]*async[ \t]+def[ \t]+({ID})"),
    ],
    "typescript": [
        _JS_COMMON[0], *_TS_TYPES,
        Boundary("enum_declaration", rf"^[ \t]*(?:const[ \t]+)?enum[ \t]+({ID})"),
        *_JS_COMMON[1:],
    ],
    "tsx": [
        _JS_COMMON[0], *_TS_TYPES, *_JS_COMMON[1:],
        Boundary("jsx_element", r"^[ \t]*<([A-Za-z][A-Za-z0-9_.]*)(?:[ \t][^>]*)?>?[ \t]*$"),
    ],
    "javascript": list(_JS_COMMON),
    "go": [
        Boundary("function_declaration", rf"^func[ \t]+({ID})"),
        Boundary("method_declaration", rf"^func[ \t]*\([^)]*\)[ \t]*({ID})"),
        Boundary("type_declaration", rf"^[ \t]*type[ \t]+(?:({ID})|\()"),
        Boundary("const_declaration", rf"^[ \t]*const[ \t]+(?:({ID})|\()"),
        Boundary("var_declaration", rf"^[ \t]*var[ \t]+(?:({ID})|\()"),
    ],
    "rust": [
        Boundary("function_item",
                 _RUST_VIS + r"(?:(?:const|async|unsafe|default)[ \t]+)*"
                 rf'(?:extern[ \t]+(?:"[^"]*"[ \t]+)?)?fn[ \t]+({ID})'),
        Boundary("impl_item", rf"^[ \t]*(?:unsafe[ \t]+)?impl(?:<[^>]*>)?[ \t]+({ID})"),
        Boundary("struct_item", _RUST_VIS + rf"struct[ \t]+({ID})"),
        Boundary("enum_item", _RUST_VIS + rf"enum[ \t]+({ID})"),
        Boundary("trait_item", _RUST_VIS + rf"(?:unsafe[ \t]+)?trait[ \t]+({ID})"),
        Boundary("mod_item", _RUST_VIS + rf"mod[ \t]+({ID})"),
        Boundary("use_declaration", _RUST_VIS + r"use[ \t]+"),
        Boundary("type_item", _RUST_VIS + rf"type[ \t]+({ID})"),
        Boundary("const_item", _RUST_VIS + rf"const[ \t]+({ID})[ \t]*:"),
    ],
    "java": [
        Boundary("class_declaration", rf"^[ \t]*{_JAVA_MODS}class[ \t]+({ID})"),
        Boundary("interface_declaration", rf"^[ \t]*{_JAVA_MODS}interface[ \t]+({ID})"),
        Boundary("enum_declaration", rf"^[ \t]*{_JAVA_MODS}enum[ \t]+({ID})"),
        Boundary("constructor_declaration",
                 r"^[ \t]+(?:(?:public|protected|private)[ \t]+)?"
                 r"(\p{Lu}[\p{L}\p{N}_$]*)[ \t]*\([^;]*$", CONTROL),
        Boundary("method_declaration",
                 rf"^[ \t]+{_JAVA_MODS}(?:<[^>]*>[ \t]+)?[\p{{L}}_][\p{{L}}\p{{N}}_.<>\[\], ?]*[ \t]+"
                 rf"({ID})[ \t]*\([^;]*$", CONTROL),
    ],
    "cpp": [
        Boundary("class_specifier", rf"^[ \t]*class[ \t]+({ID})[^;]*$"),
        Boundary("struct_specifier", rf"^[ \t]*struct[ \t]+({ID})?[^;(]*$"),
        Boundary("namespace_definition", rf"^[ \t]*(?:inline[ \t]+)?namespace(?:[ \t]+({ID}))?"),
        Boundary("function_definition",
                 r"^[ \t]*(?:[\p{L}_][\p{L}\p{N}_:<>,*& \t]*[ \t*&])?"
                 r"([\p{L}_~][\p{L}\p{N}_:~]*)[ \t]*\([^;]*$", CONTROL),
    ],
    "c": [
        Boundary("struct_specifier",
                 rf"^[ \t]*(?:(?:typedef|static|const)[ \t]+)*struct(?:[ \t]+({ID}))?[ \t]*\{{?[ \t]*$"),
        Boundary("function_definition",
                 rf"^[\p{{L}}_][\p{{L}}\p{{N}}_* \t]*[ \t*]({ID})[ \t]*\([^;]*$", CONTROL),
    ],
    "ruby": [
        Boundary("singleton_method", r"^[ \t]*def[ \t]+self\.([\p{L}_][\p{L}\p{N}_]*[?!=]?)"),
        Boundary("method", r"^[ \t]*def[ \t]+([\p{L}_][\p{L}\p{N}_]*[?!=]?)"),
        Boundary("class", r"^[ \t]*class[ \t]+([\p{L}_][\p{L}\p{N}_:]*)"),
        Boundary("module", r"^[ \t]*module[ \t]+([\p{L}_][\p{L}\p{N}_:]*)"),
    ],
}

# Top-level lines that make up the context header.
IMPORTS: dict[str, str] = {
    "python": r"^(?:import|from)[ \t]",
    "typescript": r"^import[ \t{*\"']",
    "tsx": r"^import[ \t{*\"']",
    "javascript": r"^import[ \t{*\"']",
    "go": r"^(?:import|package)[ \t(]",
    "rust": r"^(?:(?:pub(?:\([^)]*\))?[ \t]+)?use|extern[ \t]+crate)[ \t]",
    "java": r"^(?:import|package)[ \t]",
    "cpp": r"^(?:#[ \t]*include|using)[ \t<\"]",
    "c": r"^#[ \t]*include[ \t<\"]",
    "ruby": r"^(?:require|require_relative)[ \t(]",
}

# Comment lines, which neither end a unit nor count as its last line.
COMMENTS: dict[str, str] = {
    "python": r"^[ \t]*#",
    "ruby": r"^[ \t]*#",
    "c": r"^[ \t]*(?:#|//)",
    "cpp": r"^[ \t]*(?:#|//)",
    "typescript": r"^[ \t]*//",
    "tsx": r"^[ \t]*//",
    "javascript": r"^[ \t]*//",
    "go": r"^[ \t]*//",
    "rust": r"^[ \t]*//",
    "java": r"^[ \t]*//",
}

# Lines that close a unit, and lines that continue its signature.
CLOSER = r"^[ \t]*(?:\}|</|end(?:[^\p{L}\p{N}_]|$))"
CONTINUATION = r"^[ \t]*(?:[)\]{]|/?>|(?:public|private|protected)[ \t]*:)"
DECORATOR = r"^[ \t]*@"

# What decorator lines directly above a unit do. "wrap" adds an outer unit of type
# decorated_definition, "pull" moves the start of the unit up.
DECORATED_WRAP = {"python": ["class_definition", "function_definition", "async_function_definition"]}
DECORATED_PULL = {
    "typescript": ["class_declaration", "export_statement"],
    "tsx": ["class_declaration", "export_statement"],
    "javascript": ["class_declaration", "export_statement"],
    "java": ["class_declaration", "interface_declaration", "enum_declaration",
             "constructor_declaration", "method_declaration"],
}
WRAPPED_TYPE = "decorated_definition"
IMPORT_TYPE = "import"

# Unit types whose name is the start of their first line.
UNNAMED_TYPES = ["decorated_definition", "export_statement", "use_declaration"]

# Substrings of a unit type -> node type, tried in order.
NODE_TYPES = [
    (["class", "struct", "impl"], "class"),
    (["function", "method", "arrow"], "function"),
    (["interface", "trait"], "interface"),
    (["type", "enum"], "type"),
]


def classify(unit_type: Column | str) -> Column:
    """Unit type -> class, function, interface, type or other (first matching substring wins)."""
    value = as_column(unit_type)
    result = None
    for needles, name in NODE_TYPES:
        hit = value.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | value.contains(needle)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("other")


def language_table(spark: SparkSession) -> DataFrame:
    """The suffix dimension as a table, for joins and reports."""
    return spark.createDataFrame(list(LANGUAGES.items()), "suffix string, language string")


def detect_language(path: Column | str) -> Column:
    """Language by suffix; null when unsupported."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix(path))
