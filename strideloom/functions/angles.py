"""Angles of image vectors; y grows downwards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_vertical(vx: Column, vy: Column) -> Column:
    """pi/2 - atan2(y, x), in radians, not wrapped."""
    return F.lit(math.pi / 2) - F.atan2(vy, vx)


def tibial_up(knee_x: Column, knee_y: Column, ankle_x: Column, ankle_y: Column) -> Column:
    """Of the vector from ankle to knee; pi for a vertical shin."""
    return from_vertical(knee_x - ankle_x, knee_y - ankle_y)


def tibial_down(knee_x: Column, knee_y: Column, ankle_x: Column, ankle_y: Column) -> Column:
    """Of the vector from knee to ankle; 0 for a vertical shin."""
    return from_vertical(ankle_x - knee_x, ankle_y - knee_y)


def knee_flexion(hip_x: Column, hip_y: Column, knee_x: Column, knee_y: Column, ankle_x: Column, ankle_y: Column) -> Column:
    """Degrees from the thigh to the shin, in [0, 360)."""
    turn = F.atan2(ankle_y - knee_y, ankle_x - knee_x) - F.atan2(hip_y - knee_y, hip_x - knee_x)
    return F.pmod(F.degrees(turn), F.lit(360.0))


def trunk(shoulder_x: Column, shoulder_y: Column, hip_x: Column, hip_y: Column) -> Column:
    """Degrees; 180 for an upright trunk."""
    return F.degrees(from_vertical(shoulder_x - hip_x, shoulder_y - hip_y))


def sigmoid_over(logit: Column, threshold: float = 0.35) -> Column:
    """1 where the sigmoid exceeds the threshold, else 0."""
    return (1 / (1 + F.exp(-logit)) > threshold).cast("long")


def bce_with_logits(logit: Column, target: Column, pos_weight: Column) -> Column:
    """Binary cross-entropy of a logit, positives weighted, in the form that does not overflow."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - target) * logit + (1 + (pos_weight - 1) * target) * soft
