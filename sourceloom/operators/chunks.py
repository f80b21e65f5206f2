"""Files to chunks.

All lines of a file fit in one row. Every step below works on the line array of one row, and a whole
corpus is chunked in one map-only stage: no shuffle, no join, no Python. Only the final ``explode``
multiplies rows. No step carries a growing array from line to line, so the work of a file is in
proportion to its lines, times the number of different indents that open units.

Unit ends follow indentation: a unit that opens at indent ``k`` runs until the next significant line
with indent <= ``k``. That line belongs to the unit if it closes it (``}``, ``end``, ``</``) at the
same indent, and is passed over if it continues the signature (``)``, ``]``, ``{``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.text import (
    basename, chunk_id, is_blank, let, strip,
)
from sourceloom.limits import DEFAULTS, Limits

CHUNK = ("struct<start_line:int,end_line:int,unit:string,head:string,content:string,"
         "context_header:string,token_count:int>")


def _empty(element: str) -> Column:
    return F.expr(f"cast(array() as array<{element}>)")


def _by_language(language: Column, table: dict[str, Column], default: Column) -> Column:
    """Pick an expression by language; equal expressions of several languages share a branch."""
    result = None
    for name, value in table.items():
        hit = language == name
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise(default)


def _unit_type(line: Column, language: Column) -> Column:
    """Type of the unit a line opens, or null."""
    none = F.lit(None).cast("string")
    table = {}
    for name, boundaries in rules.BOUNDARIES.items():
        kind = None
        for b in boundaries:
            hit = line.rlike(b.pattern)
            if b.unless:
                hit = hit & ~line.rlike(b.unless)
            kind = F.when(hit, b.type) if kind is None else kind.when(hit, b.type)
        table[name] = kind.when(line.rlike(rules.IMPORTS[name]), rules.IMPORT_TYPE).otherwise(none)
    return _by_language(language, table, none)


def _is_comment(line: Column, language: Column) -> Column:
    return _by_language(language, {k: line.rlike(p) for k, p in rules.COMMENTS.items()}, F.lit(False))


def _in_units(language: Column, unit: Column, table: dict[str, list[str]]) -> Column:
    hit = F.lit(False)
    for name, units in table.items():
        hit = hit | ((language == name) & unit.isin(units))
    return F.coalesce(hit, F.lit(False))


def _marks(lines: Column, language: Column) -> Column:
    """Significant lines with their indent and role."""

    def mark(line: Column, i: Column) -> Column:
        unit = _unit_type(line, language)
        return F.struct(
            (i + 1).cast("int").alias("no"),
            F.length(F.regexp_extract(line, r"^[ \t]*", 0)).alias("indent"),
            unit.alias("unit"),
            _is_comment(line, language).alias("comment"),
            line.rlike(rules.CLOSER).alias("closer"),
            line.rlike(rules.CONTINUATION).alias("continued"),
            line.rlike(rules.DECORATOR).alias("decorator"),
        )

    marked = F.transform(lines, lambda line, i: F.when(~is_blank(line), mark(line, i)))
    return F.filter(marked, lambda m: m.isNotNull() & (~m["comment"] | m["unit"].isNotNull()))


def _not_above(positions: Column, queries: Column) -> Column:
    """For each of the sorted ``queries``, how many of the sorted ``positions`` are not above it."""
    merged = F.sort_array(F.concat(
        F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(0).alias("query"))),
        F.transform(queries, lambda q: F.struct(q.alias("at"), F.lit(1).alias("query")))))
    placed = F.transform(merged, lambda m, i: F.struct(m["query"].alias("query"), i.alias("i")))
    return F.transform(F.filter(placed, lambda m: m["query"] == 1), lambda m, n: m["i"] - n)


def _opened(marks: Column) -> Column:
    """Units of the marked lines in line order, without what decorators add: no, unit, indent, deco, end_line, stop.

    A unit of indent ``k`` stops at the next line of indent <= ``k`` that continues no signature. So for each indent
    that opens units, the lines up to that indent are picked in order, and the neighbours of a unit are its answer:
    the line after it ends it, and decorators of its own indent right before it, which are kept as their first line,
    belong to it. A unit whose own line continues a signature stands between such lines.
    """
    def opened(m: Column, above: Column, below: Column, last: Column) -> Column:
        own_deco = above["decorator"] & (above["indent"] == m["indent"])
        end = (F.when(below["no"].isNull(), last)
               .when(below["closer"] & (below["indent"] == m["indent"]), below["no"]).otherwise(below["before"]))
        return F.struct(m["no"].alias("no"), m["unit"].alias("unit"), m["indent"].alias("indent"),
                        F.when(own_deco, above["no"]).alias("deco"), end.alias("end_line"), below["no"].alias("stop"))

    def of_indent(ms: Column, k: Column, last: Column) -> Column:
        def opens(m: Column) -> Column:
            return m["unit"].isNotNull() & (m["indent"] == k)

        def own_deco(m: Column) -> Column:
            return F.coalesce(m["decorator"] & (m["indent"] == k), F.lit(False))

        def plain(near: Column) -> Column:
            found = F.transform(near, lambda m, i: F.when(
                opens(m), opened(m, F.get(near, i - 1), F.get(near, i + 1), last)))
            return F.filter(found, lambda u: u.isNotNull())

        def continued(near: Column, late: Column) -> Column:
            place = _not_above(F.transform(near, lambda m: m["no"]), F.transform(late, lambda m: m["no"]))
            return let(place, lambda at: F.transform(late, lambda m, i: opened(
                m, F.get(near, F.get(at, i) - 1), F.get(near, F.get(at, i)), last)))

        def both(near: Column) -> Column:
            late = F.filter(ms, lambda m: opens(m) & m["continued"])
            return let(late, lambda found: F.when(F.size(found) == 0, plain(near))
                       .otherwise(F.concat(plain(near), continued(near, found))))

        up_to = F.filter(ms, lambda m: (m["indent"] <= k) & ~m["continued"])
        return let(let(up_to, lambda ls: F.filter(
            ls, lambda m, i: ~(own_deco(m) & own_deco(F.get(ls, i - 1))))), both)

    def run(ms: Column) -> Column:
        indents = F.array_distinct(F.transform(F.filter(ms, lambda m: m["unit"].isNotNull()), lambda m: m["indent"]))
        chained = F.transform(ms, lambda m, i: m.withField("before", F.get(ms, i - 1)["no"]))
        last = F.element_at(ms, -1)["no"]
        return let(chained, lambda c: F.sort_array(F.flatten(F.transform(indents, lambda k: of_indent(c, k, last)))))

    return let(marks, run)


def _depths(opened: Column, wrapped: Column) -> Column:
    """How many units are open where each unit starts: those that started before it less those that stopped by then.

    ``wrapped`` has one flag per unit; a wrapped unit counts twice.
    """
    def depths(us: Column, flags: Column) -> Column:
        nos = F.transform(us, lambda u: u["no"])
        twice = F.transform(us, lambda u, i: F.when(F.get(flags, i), F.array(u["stop"], u["stop"])).otherwise(F.array(u["stop"])))
        stops = F.sort_array(F.filter(F.flatten(twice), lambda at: at.isNotNull()))
        wraps = F.filter(F.transform(us, lambda u, i: F.when(F.get(flags, i), u["no"])), lambda no: no.isNotNull())
        return let(_not_above(stops, nos), lambda ended: let(_not_above(wraps, nos), lambda extra: F.transform(
            us, lambda u, i: (i + F.get(extra, i) - F.get(ended, i) - F.get(flags, i).cast("int")).cast("int"))))

    return let(opened, lambda us: let(wrapped, lambda flags: depths(us, flags)))


def _units(marks: Column, language: Column, with_depth: bool) -> Column:
    """All units of the marked lines by start line, outer before inner."""
    def unit(start, end, kind, indent, depth, head):
        return F.struct(start.alias("start_line"), (-end).alias("neg_end"), kind.alias("unit"),
                        indent.alias("indent"), depth.cast("int").alias("depth"), head.alias("head"))

    def wraps(u: Column) -> Column:
        return u["deco"].isNotNull() & _in_units(language, u["unit"], rules.DECORATED_WRAP)

    def expand(us: Column, depths: Column | None) -> Column:
        def one(u: Column, i: Column) -> Column:
            depth = F.lit(0) if depths is None else F.get(depths, i)
            pull = u["deco"].isNotNull() & _in_units(language, u["unit"], rules.DECORATED_PULL)
            plain = unit(F.when(pull, u["deco"]).otherwise(u["no"]), u["end_line"], u["unit"], u["indent"],
                         depth + wraps(u).cast("int"), u["no"])
            outer = unit(u["deco"], u["end_line"], F.lit(rules.WRAPPED_TYPE), u["indent"], depth, u["deco"])
            return F.when(wraps(u), F.array(outer, plain)).otherwise(F.array(plain))

        return F.sort_array(F.flatten(F.transform(us, one)))

    def run(us: Column) -> Column:
        if not with_depth:
            return expand(us, None)
        return let(_depths(us, F.transform(us, wraps)), lambda depths: expand(us, depths))

    return let(_opened(marks), run)


SUMMED = 128     # lines whose tokens are summed together


def _token_sums(lines: Column, limits: Limits = DEFAULTS) -> Column:
    """Tokens per line (``n``), and before each run of ``SUMMED`` lines (``before``)."""
    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, n: a + n)

    def sums(tokens: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(tokens) / SUMMED).cast("int")),
                           lambda r: add(F.slice(tokens, r * SUMMED + 1, F.lit(SUMMED))))
        before = let(runs, lambda rs: F.transform(rs, lambda r, i: add(F.slice(rs, F.lit(1), i))))
        return F.struct(tokens.alias("n"), before.alias("before"))

    return let(F.transform(lines, lambda line: limits.count_tokens(line)), sums)


def _token_sum(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens of the lines from ``start`` to ``end``: line by line, or between sums of whole runs."""
    def lines(first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(tokens["n"], first, count), F.lit(0), lambda a, n: a + n)

    def up_to(line: Column) -> Column:
        run = F.floor(line / SUMMED).cast("int")
        return F.get(tokens["before"], run) + lines(run * SUMMED + 1, line - run * SUMMED)

    return F.when(end - start < SUMMED, lines(start, end - start + 1)).otherwise(up_to(end) - up_to(start - 1))


def _text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def _analyse(content: Column, language: Column,
             body: Callable[[Column, Column, Column], Column], limits: Limits) -> Column:
    """Evaluate ``body(lines, token sums, units)``, each computed once per file.

    Units are sorted by start line, outer before inner.
    """
    def with_lines(lines: Column) -> Column:
        return let(_token_sums(lines, limits), lambda tokens: let(
            _units(_marks(lines, language), language, limits.max_depth is not None),
            lambda units: body(lines, tokens, units)))

    return let(F.split(content, "\n", -1), with_lines)


def _is_boundary(limits: Limits) -> Callable[[Column], Column]:
    def test(u: Column) -> Column:
        no_import = u["unit"] != rules.IMPORT_TYPE
        return no_import if limits.max_depth is None else no_import & (u["depth"] <= limits.max_depth)

    return test


def code_blocks(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Every boundary unit of every file: type, indent, line range, token count."""

    def blocks(lines: Column, tokens: Column, units: Column) -> Column:
        return F.transform(F.filter(units, _is_boundary(limits)), lambda u: F.struct(
            u["unit"].alias("boundary_type"), u["indent"].alias("indent"),
            u["start_line"].alias("start_line"), (-u["neg_end"]).alias("end_line"),
            _token_sum(tokens, u["start_line"], -u["neg_end"]).alias("token_count")))

    found = _analyse(F.col("content"), F.col("language"), blocks, limits)
    # explode_outer: a plain explode adds a size filter that repeats the whole expression.
    rows = files.select("repo_id", "path", "language", F.explode_outer(found).alias("u"))
    return rows.where(F.col("u").isNotNull()).select("repo_id", "path", "language", "u.*")


def _docstring(lines: Column) -> Column:
    """Leading module string of a Python file, as an array of zero or one text."""
    first = F.coalesce(
        F.array_min(F.filter(
            F.transform(lines, lambda l, i: F.when(
                ~is_blank(l) & ~l.rlike(rules.COMMENTS["python"]), i + 1)),
            lambda n: n.isNotNull())),
        F.size(lines) + 1)

    def pick(n: Column) -> Column:
        rest = F.array_join(F.slice(lines, n, F.size(lines)), "\n")

        def quoted(text: Column) -> Column:
            result = F.when(F.lit(False), _empty("string"))
            for quote in ('"""', "'''"):
                pieces = F.split(text, quote, 3)
                result = result.when(
                    text.startswith(quote) & (F.size(pieces) == 3),
                    F.array(F.concat(F.lit(quote), F.get(pieces, F.lit(1)), F.lit(quote))))
            return result.otherwise(_empty("string"))

        return let(rest, quoted)

    return let(first.cast("int"), pick)


def _header(language: Column, lines: Column, units: Column, limits: Limits) -> Column:
    """Top-level imports (after the module string of a Python file), in order.

    The piece that crosses the token budget is the last one kept.
    """
    imports = F.transform(
        F.filter(units, lambda u: (u["indent"] == 0) & (
            (u["unit"] == rules.IMPORT_TYPE)
            | ((language == "rust") & (u["unit"] == "use_declaration")))),
        lambda u: _text(lines, u["start_line"], -u["neg_end"]))
    doc = F.when(language == "python", _docstring(lines)).otherwise(_empty("string"))
    sized = F.transform(F.concat(doc, imports),
                        lambda p: F.struct(p.alias("text"), limits.count_tokens(p).alias("n")))
    start = F.struct(_empty("string").alias("kept"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        more = F.struct(F.concat(s["kept"], F.array(p["text"])).alias("kept"),
                        (s["n"] + p["n"]).alias("n"))
        return F.when(s["n"] <= limits.header_tokens, more).otherwise(s)

    return F.aggregate(sized, start, step, lambda s: F.array_join(s["kept"], "\n"))


def context_headers(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Context header of every file ('' where there is none)."""
    header = _analyse(F.col("content"), F.col("language"), lambda lines, tokens, units: _header(
        F.col("language"), lines, units, limits), limits)
    return files.select("repo_id", "path", "language", header.alias("context_header"))


def _selected(lines: Column, tokens: Column, units: Column, header: Column,
              limits: Limits) -> Column:
    """Outermost units with a token count in range; units inside a kept one are not emitted.

    A unit of fitting size is kept if no other one that starts before it is still open, that is, if as many of them end
    before its start as start before it. Only a line that both opens a unit and continues a signature lets units overlap
    in part; such files are gone through unit by unit, past the end of the last one kept.
    """
    def sized(u: Column) -> Column:
        return F.struct(u["start_line"].alias("start_line"), (-u["neg_end"]).alias("end_line"), u["unit"].alias("unit"),
                        u["head"].alias("head"), _token_sum(tokens, u["start_line"], -u["neg_end"]).alias("size"))

    def chunk(u: Column) -> Column:
        return F.struct(
            u["start_line"].alias("start_line"), u["end_line"].alias("end_line"), u["unit"].alias("unit"),
            F.get(lines, u["head"] - 1).alias("head"),
            F.ltrim(_text(lines, u["start_line"], u["end_line"]), F.lit(" \t")).alias("content"),
            header.alias("context_header"), u["size"].alias("token_count"))

    def one_by_one(fitting: Column) -> Column:
        start = F.struct(F.lit(0).alias("covered"), _empty("int").alias("kept"))

        def step(s: Column, u: Column) -> Column:
            more = F.struct(u["end_line"].alias("covered"), F.concat(s["kept"], F.array(u["i"])).alias("kept"))
            return F.when(u["start_line"] > s["covered"], more).otherwise(s)

        placed = F.transform(fitting, lambda u, i: u.withField("i", i))
        return F.aggregate(placed, start, step, lambda s: s["kept"])

    def places(fitting: Column) -> Column:
        ends = F.sort_array(F.transform(fitting, lambda u: u["end_line"]))
        ended = _not_above(ends, F.transform(fitting, lambda u: u["start_line"] - 1))

        def crossed(outer: Column, i: Column, p: Column) -> Column:
            inside = F.slice(fitting, p + 1, F.coalesce(F.get(outer, i + 1), F.size(fitting)) - p)
            return F.exists(inside, lambda u: u["end_line"] > F.get(fitting, p)["end_line"])

        def checked(outer: Column) -> Column:
            overlap = F.exists(F.transform(outer, lambda p, i: crossed(outer, i, p)), lambda x: x)
            return F.when(overlap, one_by_one(fitting)).otherwise(outer)

        return let(F.filter(F.transform(ended, lambda n, i: F.when(n == i, i)), lambda i: i.isNotNull()), checked)

    def outermost(fitting: Column) -> Column:
        return F.transform(places(fitting), lambda p: let(F.get(fitting, p), chunk))

    all_sized = F.transform(F.filter(units, _is_boundary(limits)), sized)
    return let(F.filter(all_sized, lambda u: u["size"].between(limits.min_tokens, limits.max_tokens)), outermost)


def _fallback(lines: Column, tokens: Column, content: Column, limits: Limits) -> Column:
    """One chunk for a small file, else overlapping line windows that stop at the last line."""
    n = F.size(lines)
    none = F.lit(None).cast("string")

    def chunk(start, end, head, text, header_tokens):
        return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
                        none.alias("unit"), head.alias("head"), text.alias("content"),
                        F.lit("").alias("context_header"), header_tokens.alias("token_count"))

    whole = _token_sum(tokens, F.lit(1), n)
    last = F.greatest(F.lit(0), F.ceil((n - limits.window) / limits.stride).cast("int")) * limits.stride

    def window(i: Column) -> Column:
        end = F.least(i + limits.window, n)
        label = F.concat(F.lit(":L"), (i + 1).cast("string"), F.lit("-L"), end.cast("string"))
        return chunk(i + 1, end, label, _text(lines, i + 1, end), _token_sum(tokens, i + 1, end))

    windows = F.transform(F.sequence(F.lit(0), last, F.lit(limits.stride)), window)
    return (F.when(content == "", _empty(CHUNK))
            .when(whole <= limits.max_tokens, F.array(chunk(F.lit(1), n, none, content, whole)))
            .otherwise(windows))


def with_chunks(files: DataFrame, limits: Limits = DEFAULTS, boundaries: bool = True) -> DataFrame:
    """Add ``chunks``, the array of all chunks of the file in line order.

    Files without any boundary chunk fall back to one chunk or to line windows.
    """
    content, language = F.col("content"), F.col("language")

    def chosen(lines: Column, tokens: Column, units: Column) -> Column:
        kept = let(_header(language, lines, units, limits),
                   lambda header: _selected(lines, tokens, units, header, limits))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(
            _fallback(lines, tokens, content, limits)))

    if boundaries:
        chunks = _analyse(content, language, chosen, limits)
    else:
        chunks = let(F.split(content, "\n", -1), lambda lines: let(
            _token_sums(lines, limits),
            lambda tokens: _fallback(lines, tokens, content, limits)))
    return files.withColumn("chunks", F.when(content.isNotNull(), chunks))


def _unit_name(language: Column, unit: Column, head: Column, content: Column) -> Column:
    """Declared identifier, else the first 60 characters of the first line."""
    by_language = {}
    for name, boundaries in rules.BOUNDARIES.items():
        found = None
        for b in boundaries:
            if b.type in rules.UNNAMED_TYPES or "(" not in b.pattern.replace("(?:", ""):
                continue
            hit = unit == b.type
            value = F.regexp_extract(head, b.pattern, 1)
            found = F.when(hit, value) if found is None else found.when(hit, value)
        by_language[name] = found
    declared = _by_language(language, by_language, F.lit(None).cast("string"))
    first_line = strip(F.substring(F.substring_index(content, "\n", 1), 1, 60))
    return F.coalesce(F.nullif(declared, F.lit("")), first_line)


def explode_chunks(files: DataFrame, boundaries: bool = True) -> DataFrame:
    """One row per chunk from the output of ``with_chunks``."""
    c = files.select("repo_id", "path", "language", F.explode_outer("chunks").alias("c"))
    c = c.where(F.col("c").isNotNull() & F.col("repo_id").isNotNull() & F.col("path").isNotNull())
    name = F.concat(basename("path"), F.coalesce(F.col("c.head"), F.lit("")))
    kind = F.lit("module")
    if boundaries:
        is_fallback = F.col("c.unit").isNull()
        kind = F.when(is_fallback, kind).otherwise(rules.classify("c.unit"))
        name = F.when(is_fallback, name).otherwise(
            _unit_name(F.col("language"), F.col("c.unit"), F.col("c.head"), F.col("c.content")))
    return c.select(
        chunk_id("repo_id", "path", "c.start_line").alias("id"), "repo_id",
        F.col("path").alias("file_path"), "language",
        kind.alias("node_type"), name.alias("node_name"), "c.start_line", "c.end_line", "c.content", "c.context_header",
        "c.token_count",
    )


def chunk_outcomes(chunked: DataFrame) -> DataFrame:
    """(repo_id, path, chunk_count, error) of every file of ``with_chunks``; a file that could not be chunked says why.

    The expressions of a file give null instead of raising, so a file without content, without a path or without a
    repository (which have no chunk ids) is a row here and the other files are chunked.
    """
    reason = (F.when(F.col("repo_id").isNull(), "no repository").when(F.col("path").isNull(), "no path")
              .when(F.col("content").isNull(), "no content").when(F.col("chunks").isNull(), "not chunked"))
    return chunked.select("repo_id", "path", F.when(reason.isNull(), F.size("chunks")).otherwise(F.lit(0)).alias("chunk_count"),
                          reason.alias("error"))


def chunk_files(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Chunks of all files: boundary units where they exist, line windows elsewhere."""
    return explode_chunks(with_chunks(files, limits))


def fallback_chunks(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Chunks by file size and line windows only."""
    return explode_chunks(with_chunks(files, limits, boundaries=False), boundaries=False)


def chunk_sample(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first chunks in file and line order, with location and size."""
    first = chunks.orderBy("repo_id", F.split("file_path", "/", -1), "start_line", "id").limit(n)
    return first.select(
        "node_type", "node_name", "file_path", "start_line", "end_line", "token_count")
