"""Fixed values shared by the adapters and the SQL: how driver rows become files, jobs and events."""

# Directories and suffixes of the file made from a document (by doc_id).
DIRS = ["src", "lib/core", "src/node_modules/x", ".hidden", "app", "docs/build", "pkg", "a-b/c",
        "vendor/z", "a/b", "test"]
SUFFIXES = [".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".cpp", ".c", ".rb", ".PY",
            ".txt"]

# Line templates of source files made from documents. {n} is the line number and {t}
# the line of the document.
TEMPLATES = {
    "python": ['"""Module {n}: {t}"""', "import lib_{n}", "@register", "class Unit{n}:",
               "    def run{n}(self):", '        text = "{t}"', "# note {t}", "    @cached(",
               "        {n}", "    )", "    def find{n}(", "        self,", "    ):",
               '        return "{t}"', "async def main{n}():", '    yield "{t}"', ""],
    "typescript": ['import { a{n} } from "m";', "interface Shape{n} {", "    text: string; // {t}",
                   "}", "@Service()", "export class Unit{n} {", "    run{n}(a: string): string {",
                   '        return "{t}";', "    }", "}", "const go{n} = async (a) => {",
                   '    return "{t}";', "};", 'type T{n} = "{t}";', "enum E{n} {", "    A, // {t}",
                   "}"],
    "tsx": ['import x{n} from "m";', "function View{n}(props) {", "  return (",
            '    <div className="c{n}">', "      <p>", "        {t}", "      </p>", "    </div>",
            "  );", "}"],
    "javascript": ["import {", "  a{n},", '} from "m";', "class Unit{n} {", "  run{n}(a) {",
                   '    if (a) { return "{t}"; }', "  }", "}", "function go{n}(a) {",
                   '  return "{t}";', "}", "const f{n} = function (a) {", '  return "{t}";', "};"],
    "go": ["package p{n}", "import (", '\t"m{n}"', ")", "type Unit{n} struct {", "\tText string // {t}",
           "}", "func New{n}(", "\ta int,", ") *Unit{n} {", '\treturn "{t}"', "}",
           "func (u *Unit{n}) Run{n}() string {", '\treturn "{t}"', "}", "const (", '\tA{n} = "{t}"',
           ")"],
    "rust": ["use m{n}::x;", "#[derive(Debug)]", "pub struct Unit{n} {", "    text: str, // {t}", "}",
             "impl<T> Unit{n} {", "    pub fn run{n}(&self) -> str {", '        "{t}"', "    }", "}",
             "pub(crate) async fn go{n}() {", '    let a = "{t}";', "}", "trait Do{n} {",
             "    fn act{n}(&self); // {t}", "}"],
    "java": ["package p{n};", "import m{n}.X;", "@Entity", "public class Unit{n} extends Base {",
             '    private String a = "{t}";', "    public Unit{n}(int a) {", '        this.a = "{t}";',
             "    }", "    @Override", "    public List<String> run{n}(int a,",
             "                  int b) {", '        return "{t}";', "    }", "}"],
    "cpp": ["#include <m{n}>", "class Unit{n} : public Base", "{", "public:",
            "    int run{n}(int a)", "    {", '        return "{t}";', "    }", "};",
            "static int go{n}(int a)", "{", '    return call("{t}");', "}"],
    "c": ["#include <m{n}.h>", "struct unit{n} {", "    int a; /* {t} */", "};",
          "int run{n}(int a,", "          int b)", "{", '    print("{t}");', "    return 0;", "}"],
    "ruby": ["require 'm{n}'", "module Mod{n}", "  class Unit{n} < Base", "    def self.go{n}(a)",
             "      '{t}'", "    end", "    def ok{n}?", "      '{t}'", "    end", "  end", "end"],
}

# Repository status by event type.
STATUS_OF = {"click": "queued", "view": "chunking", "signup": "embedding", "purchase": "ready",
             "error": "failed"}

# Model by event type.
MODEL_OF = {"click": "alpha/small", "view": "alpha/large", "signup": "beta/small",
            "purchase": "beta/large", "error": "beta/error"}
