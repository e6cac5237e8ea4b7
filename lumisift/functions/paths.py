"""Photo paths: format class, name, and which paths a scan takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File name extensions of decodable and of raw photos.
STANDARD = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]
RAW = ["cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "orf", "rw2", "raf", "dng", "pef", "ptx", "srw", "x3f", "3fr", "erf", "kdc", "mrw", "raw", "mos", "iiq", "rwl", "dcr"]
ASIDE = "disqualified"


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def format_class(path: Column) -> Column:
    """'standard', 'raw' or 'unsupported', by extension in any case; null paths are unsupported."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(extension.isin(STANDARD), "standard").when(extension.isin(RAW), "raw").otherwise("unsupported")


def supported_photos(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.filter(format_class(F.col(path_col)) != "unsupported")


def relative_path(path: Column, root: str) -> Column:
    """What follows root in the path; the whole path if root is empty or not in it."""
    at = F.instr(path, root) if root else F.lit(0)
    return F.when(at > 0, path.substr(at + F.lit(len(root)), F.length(path))).otherwise(path)


def filter_photo_paths(df: DataFrame, path_col: str = "path", root: str = "") -> DataFrame:
    """Supported photos, but for those in a folder named 'disqualified' at any depth below root (root itself may be so named)."""
    return supported_photos(df, path_col).filter(~relative_path(F.col(path_col), root).rlike(f"(^|/){ASIDE}/"))
