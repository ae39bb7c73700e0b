"""Sources and sinks."""

from .checkpoint import read_checkpoint, write_checkpoint
from .custom import function_source, save_partition, save_with
from .manifest import AlreadyCommitted, clean_attempts, commit, read_committed, read_manifest, verify
from .rows import empty, from_rows, make_range, table
from .text import save_text, text_file

__all__ = ["AlreadyCommitted", "clean_attempts", "commit", "empty", "from_rows", "function_source", "make_range", "read_checkpoint", "read_committed", "read_manifest", "save_partition", "save_text", "save_with", "table", "text_file", "verify", "write_checkpoint"]
