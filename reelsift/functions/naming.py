"""Names of runs, folders and crop files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelsift.params import Params

# File endings accepted as video, and the folder of each category.
VIDEO_ENDINGS = (".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv", ".webm", ".m4v")
CATEGORY_DIRS = {"person": "persons", "animal": "animals"}
OTHER_DIR = "objects"


def is_video(path: Column) -> Column:
    lowered = F.lower(path)
    match = F.lit(False)
    for ending in VIDEO_ENDINGS:
        match = match | lowered.endswith(ending)
    return match


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stem(path: Column) -> Column:
    """File name without its last ending; a name that only has a leading dot stays whole."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def run_name(path: Column, params: Params) -> Column:
    mode = "ensemble" if params.ensemble else "yolo"
    suffix = f"_{params.crop_format.replace(':', 'x')}_{mode}{'_turbo' if params.turbo else ''}"
    return F.concat(stem(path), F.lit(suffix))


def category_dir(category: Column) -> Column:
    folder = F.lit(OTHER_DIR)
    for name, value in CATEGORY_DIRS.items():
        folder = F.when(category == name, value).otherwise(folder)
    return folder


def crop_file_name(frame_no: Column, quality: Column) -> Column:
    return F.format_string("frame_%06d_q%d.jpg", frame_no, (quality * F.lit(100.0)).cast("int"))
