"""Scratch tables, shared files and table access: those of the library."""

from caseloom.operators.shared import forget, free_name, new_folder, remove, shared_dir, table, written

__all__ = ["forget", "free_name", "new_folder", "remove", "shared_dir", "table", "written"]
