"""Text ingest, table lifecycle and export."""

from voltpoint.sources.delimited import read_delimited
from voltpoint.sources.export import write_dat, write_dat_lines, write_parquet
from voltpoint.sources.lylout import list_files, load_report, read_lines, read_points
from voltpoint.sources.scratch import remove_scratch, scratch_folder, written
from voltpoint.sources.store import PointStore
from voltpoint.sources.tables import clear, cluster, keep, read_staged, replace_load, stage

__all__ = [
    "PointStore",
    "clear",
    "cluster",
    "keep",
    "list_files",
    "load_report",
    "read_delimited",
    "read_lines",
    "read_points",
    "read_staged",
    "remove_scratch",
    "replace_load",
    "scratch_folder",
    "stage",
    "write_dat",
    "write_dat_lines",
    "write_parquet",
    "written",
]
