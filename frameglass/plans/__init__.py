"""Whole-table plans: the profile report and chains of column operations."""

from .chain import Chain
from .report import Profile, profile

__all__ = ["Chain", "Profile", "profile"]
