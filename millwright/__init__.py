"""Maintenance and equipment-effectiveness analytics expressed as Spark DataFrame jobs."""

from millwright.session import configure, staged, work_dir

__all__ = ["configure", "staged", "work_dir"]
