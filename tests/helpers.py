"""Small frames with results worked out by hand."""

from __future__ import annotations

from datetime import date

SCORED = [
    (date(2026, 9, 1), "AA", "JFK", "LAX", -5.0),
    (date(2026, 9, 1), "AA", "JFK", "LAX", 10.0),
    (date(2026, 9, 1), "DL", "ATL", "JFK", 20.0),
    (date(2026, 9, 1), "DL", "ATL", "LAX", 40.0),
    (date(2026, 9, 2), "AA", "JFK", "LAX", 0.0),
    (date(2026, 9, 2), "UA", "ORD", "JFK", 15.0),
    (date(2026, 9, 2), "UA", "ORD", "LAX", 35.0),
    (date(2026, 9, 3), "DL", "ATL", "JFK", 12.0),
]
SCORED_SCHEMA = "FL_DATE date, OP_UNIQUE_CARRIER string, ORIGIN string, DEST string, predicted_arr_delay double"

TEXT_COLUMNS = [
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
    "DEST",
    "CRS_DEP_TIME",
    "CRS_ARR_TIME",
    "ARR_DELAY",
    "CANCELLED",
    "CRS_ELAPSED_TIME",
    "DISTANCE",
]


def text_rows(n: int) -> list[dict]:
    """All-text trips; departure times keep their leading zero."""
    return [
        {
            "FL_DATE": f"2026-09-{i % 28 + 1:02d}",
            "OP_UNIQUE_CARRIER": ("AA", "DL", "UA")[i % 3],
            "ORIGIN": ("JFK", "ATL")[i % 2],
            "DEST": ("LAX", "ORD")[i % 2],
            "CRS_DEP_TIME": f"{6 + i % 12:02d}30",
            "CRS_ARR_TIME": f"{9 + i % 12:02d}15",
            "ARR_DELAY": str(i),
            "CANCELLED": "0",
            "CRS_ELAPSED_TIME": str(120 + i),
            "DISTANCE": str(500 + 10 * i),
        }
        for i in range(n)
    ]


def text_frame(spark, rows):
    schema = ", ".join(f"{c} string" for c in TEXT_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in TEXT_COLUMNS) for r in rows], schema)


def write_csv(path, rows, columns=None, bom=False):
    columns = columns or TEXT_COLUMNS
    lines = [",".join(columns)] + [",".join(r.get(c, "") for c in columns) for r in rows]
    path.write_text(("﻿" if bom else "") + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


class DistanceModel:
    def predict(self, frame):
        return frame["DISTANCE"] / 100


class BrokenModel:
    def predict(self, frame):
        raise RuntimeError("no prediction")


class TwoColumns:
    def predict(self, frame):
        assert list(frame.columns) == ["DISTANCE", "CRS_ELAPSED_TIME"]
        return frame["DISTANCE"] / 100 + frame["CRS_ELAPSED_TIME"]
