"""Generators of simulation files with the same content as text and database."""

import datetime as dt
import sqlite3

#: id, key, type, units, interval
HEADER = [
    (7, "ZONE1", "Zone Mean Air Temperature", "C", "hourly"),
    (8, "ZONE2", "Zone Mean Air Temperature", "C", "hourly"),
    (9, "ZONE1", "Zone Mean Air Temperature", "C", "daily"),
    (10, "Meter", "Electricity:Facility", "J", "monthly"),
    (11, "ZONE1", "Lights Electric Power", "W", "monthly"),
    (12, "ZONE1", "Lights Electric Power", "W", "runperiod"),
]
NAMES = {"hourly": "Hourly", "daily": "Daily", "monthly": "Monthly", "runperiod": "RunPeriod", "annual": "Annual"}


def value(i, n):
    return round(i * 10 + (n * 7 % 23) / 4, 3)


def steps(start=dt.datetime(2019, 1, 30), days=3):
    """(interval, stamp fields) in the order of a file; months end with their days."""
    out, day = [], start
    for n in range(days):
        for h in range(1, 25):
            out.append(("hourly", day, h))
        out.append(("daily", day, n + 1))
        after = day + dt.timedelta(days=1)
        if after.month != day.month or n == days - 1:
            out.append(("monthly", day, n + 1))
        day = after
    out.append(("runperiod", day, days))
    return out


def write_eso(path, environments=("RUN PERIOD 1",), design=(), start=dt.datetime(2019, 1, 30), days=3, end=True, extra_header=(), skip=()):
    lines = ["Program Version,Simulator, Version 9.1.0-abc, YMD=2020.05.01 12:30"]
    lines += [f"{i},{i + 1},definition {i}" for i in range(1, 7)]
    for i, key, kind, units, table in [*HEADER, *extra_header]:
        if key == "Meter":
            lines.append(f"{i},9,{kind} [{units}] !{NAMES[table]} [Value,Min,Day,Hour,Minute,Max,Day,Hour,Minute]")
        else:
            lines.append(f"{i},1,{key},{kind} [{units}] !{NAMES[table]}")
    lines.append("End of Data Dictionary")
    for env in environments:
        lines.append(f"1,{env},51.0,0.0,0.0,10.0")
        count = {}
        for table, day, x in steps(start, days):
            name = "SummerDesignDay" if env in design else day.strftime("%A")
            if table == "hourly":
                lines.append(f"2,1,{day.month},{day.day},0,{x},0.00,60.00,{name}")
            elif table == "daily":
                lines.append(f"3,{x},{day.month},{day.day},0,{name}")
            elif table == "monthly":
                lines.append(f"4,{x},{day.month}")
            else:
                lines.append(f"5,{x}")
            n = count[table] = count.get(table, -1) + 1
            for i, key, _, _, of in [*HEADER, *extra_header]:
                if of == table and (i, n) not in skip:
                    v = value(i, n)
                    peak = {"hourly": "", "daily": f",{v - 1},3,60,{v + 1},14,30", "monthly": f",{v - 1},{day.day},3,60,{v + 1},{day.day},24,60", "runperiod": f",{v - 1},1,30,3,60,{v + 1},2,1,1,15"}[table]
                    lines.append(f"{i},{v}{peak}")
    if end:
        lines += ["End of Data", "Number of Records Written=1"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def write_sql(path, environments=("RUN PERIOD 1",), start=dt.datetime(2019, 1, 30), days=3):
    code = {"hourly": 1, "daily": 2, "monthly": 3, "runperiod": 4}
    freq = {"hourly": "Hourly", "daily": "Daily", "monthly": "Monthly", "runperiod": "Run Period"}
    with sqlite3.connect(path) as db:
        db.execute("create table Time (TimeIndex integer primary key, Year, Month, Day, Hour, Minute, Dst, Interval, IntervalType, SimulationDays, DayType, EnvironmentPeriodIndex, WarmupFlag)")
        db.execute("create table EnvironmentPeriods (EnvironmentPeriodIndex integer primary key, SimulationIndex, EnvironmentName, EnvironmentType)")
        db.execute("create table ReportData (ReportDataIndex integer primary key, TimeIndex, ReportDataDictionaryIndex, Value)")
        db.execute("create table ReportDataDictionary (ReportDataDictionaryIndex integer primary key, IsMeter, Type, IndexGroup, TimestepType, KeyValue, Name, ReportingFrequency, ScheduleName, Units)")
        for i, key, kind, units, table in HEADER:
            meter = key == "Meter"
            db.execute("insert into ReportDataDictionary values (?,?,?,?,?,?,?,?,?,?)", (i, int(meter), "Sum", "", "", "" if meter else key, kind, freq[table], None, units))
        at = row = 0
        for e, env in enumerate(environments, 1):
            db.execute("insert into EnvironmentPeriods values (?,1,?,3)", (e, env))
            count = {}
            for table, day, x in steps(start, days):
                at += 1
                hour = x if table == "hourly" else 24
                sim = x if table != "hourly" else None
                db.execute("insert into Time values (?,?,?,?,?,0,0,60,?,?,?,?,0)", (at, 2019 if table != "runperiod" else None, day.month, day.day, hour, code[table], sim, day.strftime("%A") if table in ("hourly", "daily") else None, e))
                n = count[table] = count.get(table, -1) + 1
                for i, _, _, _, of in HEADER:
                    if of == table:
                        row += 1
                        db.execute("insert into ReportData values (?,?,?,?)", (row, at, i, value(i, n)))
