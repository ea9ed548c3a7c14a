"""Readers and writers of the tables the jobs work on."""

from .logs import (
    annotate,
    append_clustered_csv,
    append_clustered,
    clustered_rows,
    read_clustered,
    read_clustered_csv,
    read_log_directory,
    read_log_file,
    save_patterns,
    signature_batch,
)
from .model import (
    Model,
    Thresholds,
    load_model,
    read_registry_json,
    save_model,
    save_stats,
    stored_model,
)

__all__ = [
    "Model",
    "Thresholds",
    "annotate",
    "append_clustered",
    "append_clustered_csv",
    "clustered_rows",
    "load_model",
    "read_clustered",
    "read_clustered_csv",
    "read_log_directory",
    "read_log_file",
    "read_registry_json",
    "save_model",
    "save_patterns",
    "save_stats",
    "signature_batch",
    "stored_model",
]
