"""Imports every plan module so that its jobs are registered."""

from __future__ import annotations

from plumbline.plans import (  # noqa: F401
    calibration_plans,
    cloud_plans,
    fleet_plans,
    ground_plans,
    measure_plans,
    pixel_plans,
    pose_plans,
    replay_plans,
    stream_plans,
    trial_plans,
)
from plumbline.plans.registry import PLANS

__all__ = ["PLANS"]
