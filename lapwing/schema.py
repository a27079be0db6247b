"""Canonical column names, their types, and the source columns each may come from.

Aliases are resolved once, at ingest; operators only ever see canonical names.
"""

from __future__ import annotations

# Accepted source columns by canonical name, most trusted first.
SESSION_ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "driver": ("string", ("Abbreviation", "Driver", "FullName", "BroadcastName", "DriverId", "driver", "code")),
    "full_name": ("string", ("FullName", "BroadcastName", "Driver")),
    "broadcast_name": ("string", ("BroadcastName",)),
    "number": ("int", ("DriverNumber", "CarNumber", "Number")),
    "team": ("string", ("TeamName", "Team", "Constructor")),
    "position": ("double", ("Position", "QualifyingPosition", "ClassifiedPosition", "FinishPosition")),
    "grid": ("double", ("GridPosition", "StartingGrid", "Grid")),
    "q1": ("string", ("Q1",)),
    "q2": ("string", ("Q2",)),
    "q3": ("string", ("Q3",)),
    "status": ("string", ("Status",)),
    "points": ("double", ("Points",)),
    "laps": ("double", ("Laps",)),
    "time": ("string", ("Time",)),
    "race": ("string", ("Race", "EventName")),
}
LAP_ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "driver": ("string", ("Abbreviation", "Driver")),
    "team": ("string", ("Team", "TeamName")),
    "lap_s": ("seconds", ("LapTimeSeconds", "LapSeconds", "LapTime")),
    "lap": ("double", ("LapNumber",)),
    "stint": ("double", ("Stint",)),
    "compound": ("string", ("Compound",)),
    "tyre_life": ("double", ("TyreLife",)),
    "deleted": ("boolean", ("Deleted",)),
    "pit_in": ("string", ("PitInTime",)),
    "pit_out": ("string", ("PitOutTime",)),
}
FORECAST_COLUMNS = (
    "entity", "team", "QualifyingPosition", "GridPenalty", "ActualStartingGrid", "ExpectedFinish", "MedianFinish",
    "WinProbability", "Top3Probability", "Top5Probability", "PointsProbability", "P5", "P25", "P50", "P75", "P95",
    "MLExpectedFinish", "PredictedPosition",
)
