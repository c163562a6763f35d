"""A catalogue in memory that writes down what it is asked."""

import json
import os
from datetime import datetime, timedelta


class Fake:
    def __init__(self, size=200):
        first = datetime(2020, 1, 1)
        self.all = []
        for k in range(size):
            at, sat = first + timedelta(hours=9 * k), ("L8", "L9", "S2")[k % 3]
            x, y = (k * 37) % 300 - 150.0, (k * 23) % 120 - 60.0
            p = {"system:time_start": str(int((at - datetime(1970, 1, 1)).total_seconds() * 1000)), "CLOUD_COVER": str(k % 100)}
            self.all.append((at, {"satname": sat, "tier": "T1", "id": f"scene{k}", "properties": p, "bands": [{"id": "B1", "crs": "EPSG:32756"}], "x_min": x, "x_max": x + 2, "y_min": y, "y_max": y + 2}))

    def meets(self, satname, start, end, box):
        west, south, east, north = box
        return [e for at, e in self.all if e["satname"] == satname and start <= at <= end and e["x_max"] >= west and e["x_min"] <= east and e["y_max"] >= south and e["y_min"] <= north]

    def note(self, what, satname, start, end, box):
        if os.environ.get("FAKE_SERVICE_LOG"):
            with open(os.environ["FAKE_SERVICE_LOG"], "a") as f:
                f.write(json.dumps([what, satname, start.isoformat(), end.isoformat(), box]) + "\n")

    def count(self, satname, start, end, box):
        self.note("count", satname, start, end, box)
        return len(self.meets(satname, start, end, box))

    def fetch(self, satname, start, end, box):
        self.note("fetch", satname, start, end, box)
        return self.meets(satname, start, end, box)


service = Fake()
