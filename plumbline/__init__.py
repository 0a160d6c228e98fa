"""Data profiling as Spark jobs."""

from plumbline.config import ProfileConfig
from plumbline.plans.catalog import Catalog, Dataset
from plumbline.plans.profile import TableProfile, profile
from plumbline.plans.run import run

__all__ = ["Catalog", "Dataset", "ProfileConfig", "TableProfile", "profile", "run"]
