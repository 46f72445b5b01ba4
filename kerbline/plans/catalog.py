"""Imports every query module so that the catalogue is complete."""

from kerbline.plans.registry import CATALOG
from kerbline.plans import bowl, curation, evaluation, flows, grading, hazard, raster, relational, scalars  # noqa: F401

__all__ = ["CATALOG"]
