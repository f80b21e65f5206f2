"""Default limits of the operators. Every operator takes them as an argument."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from sourceloom.functions.text import token_count


@dataclass(frozen=True)
class Limits:
    # None: no bound, every row and every character takes part.
    max_files: int | None = None  # eligible files per repository, in path order
    max_bytes: int | None = None  # largest eligible file
    # They decide which chunks exist.
    min_tokens: int = 50          # smaller boundary units are dropped
    max_tokens: int = 1_500       # larger boundary units are descended into
    header_tokens: int = 300      # the context header stops after the line that crosses this
    window: int = 80              # lines per fallback window
    stride: int = 60              # lines between fallback window starts
    max_depth: int | None = None  # nesting guard for boundary units
    upsert_batch: int = 100       # rows per accounting batch
    metadata_chars: int | None = None   # content kept next to a vector
    default_top_k: int = 8
    max_top_k: int = 20           # also the over-fetch ceiling
    list_limit: int = 50          # rows of a repository listing
    # How the tokens of a text column are counted, wherever sizes are compared with the numbers above.
    count_tokens: Callable[[Column], Column] = token_count

    def files_cap(self, max_files: int | None = None) -> int | None:
        """0 and None both mean "use the default"."""
        return max_files or self.max_files

    def bytes_cap(self, max_bytes: int | None = None) -> int | None:
        return max_bytes or self.max_bytes


DEFAULTS = Limits()
# The bounds of a small service, for callers who ask for them.
BOUNDED = Limits(max_files=500, max_bytes=102_400, max_depth=10, metadata_chars=4_000)
