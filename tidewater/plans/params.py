"""Parameters of a run, passed to every transform."""

from __future__ import annotations

import datetime
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineParams:
    snapshot_date: datetime.date = datetime.date(1998, 12, 31)
    cutover_date: datetime.date = datetime.date(1998, 7, 1)
    business_tz: str = "America/Bogota"
    placeholder_id: int = 999999999


PARAMS = EngineParams()
