"""Incremental ingest of newly arriving source files (file-stream form of the
batch cleaner; the source itself has no streaming operators)."""

from .incremental import incremental_clean_long  # noqa: F401
