"""Reading Parquet files of the shared file system from within tasks: for tables that a task needs parts of, or in pieces."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


def parquet_files(paths: list[str]) -> Iterator:
    """Open Parquet files of folders, in name order, in whatever file system their addresses name. A missing folder has none, but
    the one it would be in has to be there."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    for path in paths:
        system, at = fs.FileSystem.from_uri(path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        if not found and system.get_file_info(at.rstrip("/").rpartition("/")[0]).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{path} is not where this task can read")
        for info in sorted(found, key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                yield pq.ParquetFile(system.open_input_file(info.path))


def row_groups_with(file, column: str, sorted_values: list) -> Iterator[int]:
    """The row groups whose range of ``column`` holds any of the values."""
    at = file.schema_arrow.names.index(column)
    for group in range(file.num_row_groups):
        stats = file.metadata.row_group(group).column(at).statistics
        if stats is None or not stats.has_min_max:
            yield group
        else:
            i = bisect_left(sorted_values, stats.min)
            if i < len(sorted_values) and sorted_values[i] <= stats.max:
                yield group
