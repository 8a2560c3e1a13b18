"""Names of entities that an id tells apart."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidecast.operators import columns as C
from tidecast.operators import dates as D

COLUMNS = "source string, col_idx int, name string, role string, n_blank long"


def slow_labels(rows):
    """``(source, key) -> (label, first_name, renamed, label_idx)`` row by row."""
    out = {}
    for source in {r[0] for r in rows}:
        mine, fit = [r for r in rows if r[0] == source], []
        for idx in (2, 3):
            told, spans = {}, {}
            for _, at, day, cells in mine:
                told.setdefault((cells[1], day), set()).add(cells[idx])
                if day:
                    spans.setdefault(cells[1], []).append((day, at, cells[idx]))
            if all(len(names) == 1 for names in told.values()):
                names = {k: (min(s)[2], max(s)[2]) for k, s in spans.items()}
                last = [n for _, n in names.values()]
                fit.append((-len(set(last)), idx, names, last))
        if fit:
            _, idx, names, last = min(fit)
            for key, (first, now) in names.items():
                label = f"{now} ({key})" if last.count(now) > 1 else now
                out[source, key] = (label, first, first != now, idx)
    return out


def test_labels_from_one_pass_over_rows(spark, monkeypatch):
    rng, rows = random.Random(2), []
    for s in range(24):
        twice, undated = s % 3 == 0, s % 4 == 1
        for key in range(4):
            for i in range(30):
                day = dt.date(2026, 1, 1) + dt.timedelta(days=i)
                shop = rng.choice("AB") if s % 2 else "AB"[i > 14]  # back and forth, or renamed once
                rows.append((f"s{s}", len(rows), day, [str(day), str(key), f"{shop}{key // 2}", f"x{key}"]))
        if twice:
            rows.append((f"s{s}", len(rows), dt.date(2026, 1, 9), ["", "1", rows[-1][3][2], "y"]))
        if undated:
            for brand in "yz":
                rows.append((f"s{s}", len(rows), None, ["", "2", rows[-1][3][2], brand]))
    frame = spark.createDataFrame(rows, "source string, row_num long, day date, cells array<string>")
    named = [(f"s{s}", i, n, r, 0) for s in range(24)
             for i, n, r in [(1, "Shop ID", "identifier"), (2, "Shop", "text"), (3, "Brand", "text")]]
    groups = spark.createDataFrame([(f"s{s}", 1, "Shop ID") for s in range(24)],
                                   "source string, group_idx int, group_by string")
    written, real = {}, C.landed

    def landed(df, label):
        out = real(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(C, "landed", landed)
    columns = spark.createDataFrame(named, COLUMNS)
    got = C.entity_labels(frame.withColumn("filled", F.lit(False)), columns, groups).collect()
    want = slow_labels(rows)
    assert {(r["source"], r["key"]): (r["label"], r["first_name"], r["renamed"], r["label_idx"])
            for r in got} == want and want
    # What is written grows with ids and their names, not with their days.
    assert written["names"] <= 24 * (4 * 2 + 4 + 4)


def test_days_of_an_export_are_read_once(spark):
    cells = [("p", 1, ["2026-01-02", "a\x01b"]), ("d", 1, [" 13/01/2026 ", None]),
             ("d", 2, ["02/01/2026", "x"]), ("m", 1, ["01/13/2026"]), ("u", 1, ["02/01/2026"]),
             ("n", 1, ["Brand", "x"])]
    records = spark.createDataFrame(cells, "source string, row_num long, cells array<string>")
    read = D.read_days(records)
    order = {r["source"]: r["date_order"] for r in D.order_of(read).collect()}
    assert order == {"p": "plain", "d": "day", "m": "month", "u": "undecided", "n": "plain"}
    got = {(r["source"], r["row_num"]): (str(r["day"]), r["cells"])
           for r in D.in_order(read, D.order_of(read)).collect()}
    assert got == {("p", 1): ("2026-01-02", ["2026-01-02", "ab"]),
                   ("d", 1): ("2026-01-13", [" 13/01/2026 ", None]),
                   ("d", 2): ("2026-01-02", ["02/01/2026", "x"]),
                   ("m", 1): ("2026-01-13", ["01/13/2026"]),
                   ("u", 1): ("None", ["02/01/2026"]), ("n", 1): ("None", ["Brand", "x"])}
