"""Curation of image-training crops from tables of video frames and detections, on Spark."""

from reelsift.params import Params
from reelsift.plans.curate import curate

__all__ = ["Params", "curate"]
