"""The registered queries and the SQL they are checked against."""

from . import tables_cases, voxel_cases, neighbour_cases, camera_cases, mapping_cases, metric_cases, box_cases, registration_cases, region_cases, source_cases, plan_cases
from .registry import CASES
