"""Intermediate tables, by the name that the corpus operators use."""

from eventloom.scratch import partitions, remove, shared_folder, write_out

__all__ = ["partitions", "remove", "shared_folder", "write_out"]
