"""Column functions over text. All of them are built-in expressions, so plans stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The classes are spelled out because \w and \s differ between regex dialects.
SPACE = r"[ \t\n\x0B\f\r]"
NON_SPACE = r"[^ \t\n\x0B\f\r]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    The optimizer may inline a projected column into a lambda, which would evaluate it once per
    element; a lambda variable cannot be inlined.
    """
    # Spark counts the parameters: a body with a second one, even with a default, would get the index.
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def token_count(text: Column | str) -> Column:
    """Model-agnostic token count: runs of word characters, and single other visible characters."""
    return F.regexp_count(as_column(text), F.lit(TOKEN))


def words(text: Column | str) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` removes blanks only)."""
    return F.regexp_replace(as_column(text), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column | str) -> Column:
    return ~as_column(text).rlike(NON_SPACE)


def basename(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Lower-case suffix with its dot. A leading dot alone is no suffix (``.py`` has none)."""
    return F.lower(F.regexp_extract(basename(path), r"^(?s:.+)(\.[^.]+)$", 1))


def decode_utf8(raw: Column | str) -> Column:
    """UTF-8 text of a binary column, with U+FFFD for invalid bytes."""
    return F.make_valid_utf8(as_column(raw).cast("string"))


def chunk_id(repo_id: Column | str, path: Column | str, start_line: Column | str) -> Column:
    """Deterministic 16-digit id of the chunk that starts at ``start_line``."""
    key = F.concat_ws(":", as_column(repo_id), as_column(path), as_column(start_line).cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def location(path: Column | str, start_line: Column | str, end_line: Column | str) -> Column:
    """``path:L<start>-L<end>``."""
    return F.concat(
        as_column(path), F.lit(":L"), as_column(start_line).cast("string"),
        F.lit("-L"), as_column(end_line).cast("string"),
    )


def embedding_text(header: Column | str, node_type: Column | str, node_name: Column | str,
                   content: Column | str) -> Column:
    """Text that is vectorized: header (if any), a ``# type: name`` line, the content."""
    title = F.concat(F.lit("# "), as_column(node_type), F.lit(": "), as_column(node_name))
    return F.concat_ws("\n\n", F.nullif(as_column(header), F.lit("")), title, as_column(content))


def or_default(value: Column | str, default: Column) -> Column:
    """``value or default`` for strings: null and '' both give the default."""
    return F.coalesce(F.nullif(as_column(value), F.lit("")), default)
