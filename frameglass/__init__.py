"""Profile and prepare tables of any size with Spark."""

from .operators.slices import profile_slices
from .plans import Chain, Profile, profile
from .sources import read_any, read_csv, read_json, read_jsonl, read_parquet, write_clean

__all__ = [
    "Chain", "Profile", "profile", "profile_slices", "read_any", "read_csv", "read_json", "read_jsonl", "read_parquet",
    "write_clean",
]
