import random

import pytest
import regex
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.limits import Limits
from sourceloom.operators import chunks
from sourceloom.operators.vectors import chunk_text

SCHEMA = "repo_id string, path string, content string, language string"
ANY_SIZE = Limits(min_tokens=1)

PYTHON = '''# heading
"""Module text
on two lines"""
import os
from x import (
    a,
)

@deco(
    1
)
@other
class A:
    x = 1

    def one(self):
        return 1
# left comment

    @property
    def two(
        self,
    ):
        return 2

async def three():
    pass
def four(): return 4
'''
TYPESCRIPT = '''import { A } from "b";
import {
  C,
} from "d";

interface P {
    a: number;
}

@Inject()
export class Proc {
    constructor(private readonly h: H) {}

    async run(o: P): Promise<S> {
        if (o.a <= 0) {
            throw new Error("x");
        }
        return "x";
    }
}
const f = async (a) => {
  return a;
};
'''
GO = '''package p

import (
\t"errors"
)

type T struct {
\tID string
}

func New(
\ta int,
) *T {
\treturn nil
}

func (p *T) Do() error {
\tif p == nil {
\t\treturn nil
\t}
\treturn nil
}
'''
RUBY = '''require 'x'
module M
  class B < C
    def self.go!(x)
      x
    end

    def ok?
      true
    end
  end
end
'''
JAVA = '''package a.b;
import java.util.List;

@Entity
public class Foo<T> extends Bar {
    public Foo(int a) {
        this.x = a;
    }

    @Override
    public List<String> run(int a,
                            int b) throws E {
        return go(a);
    }
}
'''
CPP = '''#include <vector>
using namespace std;
class Foo : public Bar
{
public:
    int run(int a)
    {
        return a;
    }
private:
    int x;
};
static int helper(int a, char *b)
{
    return foo(a);
}
'''
RUST = '''use std::io;
extern crate foo;

#[derive(Debug)]
pub struct P<T> {
    a: T,
}

impl<T> P<T> {
    pub fn new(a: T) -> Self {
        P { a }
    }
}
'''
C = '''#include <stdio.h>
typedef struct bar
{
    int b;
} bar_t;
int main(int argc,
         char **argv)
{
    printf("x");
    return 0;
}
'''
TSX = '''export const Foo = () => {
  return (
    <div className="a">
      <p>
        hello
      </p>
    </div>
  );
};
'''


def frame(spark, content, language, path="a.x"):
    return spark.createDataFrame([("r", path, content, language)], SCHEMA)


def blocks(spark, content, language):
    rows = chunks.code_blocks(frame(spark, content, language)).collect()
    return {(r.boundary_type, r.start_line, r.end_line) for r in rows}


def emitted(spark, content, language, limits=ANY_SIZE):
    rows = chunks.chunk_files(frame(spark, content, language), limits).collect()
    return [(r.node_type, r.node_name, r.start_line, r.end_line) for r in rows]


def header(spark, content, language):
    return chunks.context_headers(frame(spark, content, language)).first().context_header


def test_python_units(spark):
    assert blocks(spark, PYTHON, "python") == {
        ("decorated_definition", 9, 24), ("class_definition", 13, 24), ("function_definition", 16, 17),
        ("decorated_definition", 20, 24), ("function_definition", 21, 24),
        ("async_function_definition", 26, 27), ("function_definition", 28, 28)}
    assert emitted(spark, PYTHON, "python") == [
        ("other", "@deco(", 9, 24), ("function", "three", 26, 27), ("function", "four", 28, 28)]
    assert header(spark, PYTHON, "python") == (
        '"""Module text\non two lines"""\nimport os\nfrom x import (\n    a,\n)')


@pytest.mark.parametrize("content,language,expected", [
    (TYPESCRIPT, "typescript", {("interface_declaration", 6, 8), ("export_statement", 10, 20),
                                ("method_definition", 14, 19), ("arrow_function", 21, 23)}),
    (GO, "go", {("type_declaration", 7, 9), ("function_declaration", 11, 15),
                ("method_declaration", 17, 22)}),
    (RUBY, "ruby", {("module", 2, 12), ("class", 3, 11), ("singleton_method", 4, 6), ("method", 8, 10)}),
    (JAVA, "java", {("class_declaration", 4, 15), ("constructor_declaration", 6, 8),
                    ("method_declaration", 10, 14)}),
    (CPP, "cpp", {("class_specifier", 3, 12), ("function_definition", 6, 9),
                  ("function_definition", 13, 16)}),
    (RUST, "rust", {("use_declaration", 1, 1), ("struct_item", 5, 7), ("impl_item", 9, 13),
                    ("function_item", 10, 12)}),
    (C, "c", {("struct_specifier", 2, 5), ("function_definition", 6, 11)}),
    (TSX, "tsx", {("export_statement", 1, 9), ("jsx_element", 3, 7), ("jsx_element", 4, 6)}),
])
def test_units_of_other_languages(spark, content, language, expected):
    assert blocks(spark, content, language) == expected


@pytest.mark.parametrize("content,language,expected", [
    (TYPESCRIPT, "typescript", 'import { A } from "b";\nimport {\n  C,\n} from "d";'),
    (GO, "go", 'package p\nimport (\n\t"errors"\n)'),
    (RUBY, "ruby", "require 'x'"),
    (JAVA, "java", "package a.b;\nimport java.util.List;"),
    (CPP, "cpp", "#include <vector>\nusing namespace std;"),
    (RUST, "rust", "use std::io;\nextern crate foo;"),
    (C, "c", "#include <stdio.h>"),
    ("x = 1\n", "python", ""),
])
def test_headers(spark, content, language, expected):
    assert header(spark, content, language) == expected


def test_header_keeps_the_line_that_crosses_the_budget(spark):
    content = "".join(f"import m{i}\n" for i in range(300))      # two tokens per line
    assert header(spark, content, "python").count("\n") + 1 == 151


def test_names(spark):
    names = {n for _, n, _, _ in emitted(spark, GO, "go")}
    assert names == {"T", "New", "Do"}
    assert [n for _, n, _, _ in emitted(spark, JAVA, "java")] == ["Foo"]
    assert [n for _, n, _, _ in emitted(spark, C, "c")] == ["bar", "main"]


def test_large_units_are_descended_into_and_small_ones_dropped(spark):
    body = "\n".join(f"        v{i} = {i}" for i in range(30))                   # 3 tokens per line
    method = "    def m{}(self):\n" + body + "\n"
    content = "class Big:\n" + method.format(1) + method.format(2) + "    def tiny(self): pass\n"
    got = emitted(spark, content, "python", Limits(min_tokens=50, max_tokens=120))
    assert [(t, n) for t, n, _, _ in got] == [("function", "m1"), ("function", "m2")]
    whole = emitted(spark, content, "python")
    assert [(t, n) for t, n, _, _ in whole] == [("class", "Big")]


def test_content_is_whole_lines_without_outer_indent(spark):
    rows = chunks.chunk_files(frame(spark, "class A:\n  x = 1\n  def f(self):\n    return 1\n", "python"),
                              Limits(min_tokens=5, max_tokens=8)).collect()
    assert [r.content for r in rows] == ["def f(self):\n    return 1"]


def test_depth_guard(spark):
    content = "".join(" " * i + f"def f{i}():\n" for i in range(14))
    rows = chunks.code_blocks(frame(spark, content, "python"), Limits(max_depth=10)).collect()
    assert max(r.indent for r in rows) == 10 and len(rows) == 11
    assert chunks.code_blocks(frame(spark, content, "python")).count() == 14


def test_files_without_units_fall_back(spark):
    assert emitted(spark, "SELECT 1;\nSELECT 2;\n", None) == [("module", "a.x", 1, 3)]
    assert emitted(spark, "def f(): pass", "python", Limits()) == [("module", "a.x", 1, 1)]
    assert emitted(spark, "", "python") == []


@pytest.mark.parametrize("n,expected", [
    (1, [(1, 1)]), (80, [(1, 80)]), (81, [(1, 80), (61, 81)]), (140, [(1, 80), (61, 140)]),
    (141, [(1, 80), (61, 140), (121, 141)]),
])
def test_window_offsets(spark, n, expected):
    limits = Limits(max_tokens=0)
    content = "\n".join(f"l{i}" for i in range(1, n + 1))
    rows = chunks.fallback_chunks(frame(spark, content, None, "d/a.txt"), limits).collect()
    assert [(r.start_line, r.end_line) for r in rows] == expected
    assert [r.node_name for r in rows] == [f"a.txt:L{s}-L{e}" for s, e in expected]
    for r in rows:
        assert r.content.split("\n") == [f"l{i}" for i in range(r.start_line, r.end_line + 1)]
        assert r.token_count == r.end_line - r.start_line + 1


def test_classification_order(spark):
    types = {"constructor_declaration": "class", "impl_item": "class", "method": "function",
             "arrow_function": "function", "trait_item": "interface", "type_alias_declaration": "type",
             "enum_item": "type", "decorated_definition": "other", "module": "other"}
    df = spark.createDataFrame([(t,) for t in types], "t string")
    assert {r.t: r.n for r in df.select("t", rules.classify("t").alias("n")).collect()} == types


def test_embedding_text(spark):
    df = spark.createDataFrame([("h", "function", "f", "body"), ("", "module", "m", "body")],
                               "context_header string, node_type string, node_name string, content string")
    assert [r.t for r in df.select(chunk_text().alias("t")).collect()] == [
        "h\n\n# function: f\n\nbody", "# module: m\n\nbody"]


def test_chunking_adds_no_shuffle_and_no_python(spark, sf_dir):
    from suite import corpus

    files = corpus.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), F.col("lang").alias("path"), F.col("text").alias("content"),
        F.lit("python").alias("language"))
    plan = chunks.chunk_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("Generate explode") == 1


# Units by definition, one at a time -----------------------------------------------------------

SNIPPETS = {
    "python": ["import os", "from a import b", "class K{n}:", "def go{n}(a):", "async def w{n}():", "@first", "@second(", ")",
               "    pass", "v = {n}", "# note", "", "return {n}", "'''text'''"],
    "java": ["package q;", "import r;", "@Mark", "public class K{n} {", "  private int v{n};", "public void go{n}(int a) {", "}",
             "@Override", "// note", "", "Make{n}(int a) {", "interface J{n} {", ") {"],
    "cpp": ["#include <q>", "class K{n} {", "public:", "private: Make{n}(int a) {", "int go{n}(int b) {", "}", "{", "v = 1;",
            "namespace s{n} {", "};", ""],
    "typescript": ["import q from 'r';", "export class K{n} {", "@Mark()", "@Other(", "interface J{n} {", "go{n}(a) {", "}",
                   "const w{n} = (a) => {", "};", "function u{n}() {", "", "v;", ") {"],
    "ruby": ["require 'q'", "module S{n}", "class K{n}", "def go{n}", "end", "def self.w{n}", "v = 1", "", "# note"],
}


def random_files(seed, count, longest=50):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        language = rng.choice(list(SNIPPETS))
        lines, indent = [], 0
        for j in range(rng.randint(1, longest)):
            indent = max(0, indent + rng.choice([-4, -2, 0, 0, 2, 4]))
            at = indent if rng.random() < 0.8 else rng.choice([0, 2, 4])
            lines.append(" " * at + rng.choice(SNIPPETS[language]).replace("{n}", str(j)))
        rows.append(("r", f"f{i}", "\n".join(lines), language))
    return rows


def plain_units(content, language):
    """(start, end, type, indent, depth) of every unit, from the definition."""
    def kind(line):
        for b in rules.BOUNDARIES[language]:
            if regex.search(b.pattern, line) and not (b.unless and regex.search(b.unless, line)):
                return b.type
        return rules.IMPORT_TYPE if regex.search(rules.IMPORTS[language], line) else None

    marks = []
    for no, line in enumerate(content.split("\n"), 1):
        unit = kind(line)
        if line.strip(" \t") and (unit or not regex.search(rules.COMMENTS[language], line)):
            marks.append((no, len(line) - len(line.lstrip(" \t")), unit, *[
                bool(regex.search(p, line)) for p in (rules.CLOSER, rules.CONTINUATION, rules.DECORATOR)]))
    units, stops = [], []
    for i, (no, indent, unit, *_) in enumerate(marks):
        if unit is None:
            continue
        stop = next((j for j in range(i + 1, len(marks)) if marks[j][1] <= indent and not marks[j][4]), None)
        end = (marks[-1][0] if stop is None else
               marks[stop][0] if marks[stop][3] and marks[stop][1] == indent else marks[stop - 1][0])
        deco = None
        for m in reversed(marks[:i]):
            if m[1] <= indent and not m[4]:
                if not (m[5] and m[1] == indent):
                    break
                deco = m[0]
        wrap = deco and unit in rules.DECORATED_WRAP.get(language, [])
        depth = sum(1 + w for (at, w) in stops if at is None or at > no)
        stops.append((None if stop is None else marks[stop][0], 1 if wrap else 0))
        if wrap:
            units.append((deco, end, rules.WRAPPED_TYPE, indent, depth))
        pull = deco and unit in rules.DECORATED_PULL.get(language, [])
        units.append((deco if pull else no, end, unit, indent, depth + (1 if wrap else 0)))
    return sorted(units, key=lambda u: (u[0], -u[1]))


@pytest.mark.parametrize("seed,limits", [(1, ANY_SIZE), (2, Limits(min_tokens=3, max_tokens=40, max_depth=3)),
                                         (3, Limits(min_tokens=8, max_tokens=25))])
def test_units_and_chunks_of_random_files_equal_the_definition(spark, seed, limits):
    rows = random_files(seed, 250)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    tokens = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]")
    blocks_wanted, chunks_wanted = set(), set()
    for _, path, content, language in rows:
        count = [len(tokens.findall(line)) for line in content.split("\n")]
        covered, kept = 0, []
        for start, end, unit, indent, depth in plain_units(content, language):
            if unit == rules.IMPORT_TYPE or (limits.max_depth is not None and depth > limits.max_depth):
                continue
            size = sum(count[start - 1:end])
            blocks_wanted.add((path, unit, indent, start, end, size))
            if start > covered and limits.min_tokens <= size <= limits.max_tokens:
                kept.append((path, start, end, size))
                covered = end
        chunks_wanted |= set(kept)
    got = chunks.code_blocks(df, limits).collect()
    assert {(r.path, r.boundary_type, r.indent, r.start_line, r.end_line, r.token_count) for r in got} == blocks_wanted
    found = {(r.file_path, r.start_line, r.end_line, r.token_count) for r in chunks.chunk_files(df, limits).collect()}
    with_units = {c[0] for c in chunks_wanted}
    assert {f for f in found if f[0] in with_units} == chunks_wanted and chunks_wanted


def test_token_sums_over_many_lines(spark):
    from sourceloom.functions.text import let

    content = "\n".join("a " * (i % 5) for i in range(1000))
    spans = [(1, 1000), (1, 128), (128, 256), (129, 900), (500, 500), (872, 1000), (1, 129), (384, 512)]
    sums = [chunks._token_sum(F.col("t"), F.lit(a), F.lit(b)).alias(f"s{i}") for i, (a, b) in enumerate(spans)]
    lines = F.split("content", "\n", -1)
    got = frame(spark, content, None).select(let(lines, chunks._token_sums).alias("t")).select(*sums).first()
    assert list(got) == [sum(i % 5 for i in range(a - 1, b)) for a, b in spans]


def test_work_grows_with_the_lines(spark):
    """20,000 units in 300 KB: the time per unit stays about that of a file a quarter as large."""
    import time

    def seconds(units):
        content = "class K:\n" + "".join(f"  def f{i}():\n" for i in range(units))
        df = frame(spark, content, "python")
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert chunks.code_blocks(df).count() == units + 1
            chunks.chunk_files(df, ANY_SIZE).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)

    small, large = seconds(5_000), seconds(20_000)
    assert large < 8 * small, (small, large)


def test_a_file_that_cannot_be_chunked_is_a_row_and_the_others_are_chunked(spark):
    rows = [("r", "a.py", "def f():\n  pass", "python"), ("r", "lost.py", None, "python"), ("r", None, "x", "python"),
            (None, "b.py", "x", "python"), ("r", "empty.py", "", "python"), ("r", "c.sql", "SELECT 1", None)]
    chunked = chunks.with_chunks(spark.createDataFrame(rows, SCHEMA), ANY_SIZE)
    got = {(r.repo_id, r.path): (r.chunk_count, r.error) for r in chunks.chunk_outcomes(chunked).collect()}
    assert got == {("r", "a.py"): (1, None), ("r", "lost.py"): (0, "no content"), ("r", None): (0, "no path"),
                   (None, "b.py"): (0, "no repository"), ("r", "empty.py"): (0, None), ("r", "c.sql"): (1, None)}
    assert {r.file_path for r in chunks.explode_chunks(chunked).collect()} == {"a.py", "c.sql"}


def test_token_counter_is_an_argument(spark):
    content = "def f(a):\n  return a.b.c.d\n"
    spaces = Limits(min_tokens=1, count_tokens=lambda text: F.size(F.filter(F.split(text, " +", -1), lambda w: w != "")))
    assert [r.token_count for r in chunks.chunk_files(frame(spark, content, "python"), ANY_SIZE).collect()] == [14]
    assert [r.token_count for r in chunks.chunk_files(frame(spark, content, "python"), spaces).collect()] == [4]
    assert [r.token_count for r in chunks.code_blocks(frame(spark, content, "python"), spaces).collect()] == [4]
    assert chunks.chunk_files(frame(spark, content, "python"), Limits(
        min_tokens=5, count_tokens=spaces.count_tokens)).first().node_type == "module"
