"""Table readers, writers and lineage cuts."""

from tarn.sources.tables import FORMATS, cut_lineage, read_files, read_table, release, scratch_folder, shared_dir, utc_timestamps, write_files

__all__ = ["FORMATS", "cut_lineage", "read_files", "read_table", "release", "scratch_folder", "shared_dir", "utc_timestamps", "write_files"]
