"""Unit conversion as column expressions.

Every conversion is affine: value * factor + offset. The tables are small and
fixed; they become literals of the plan, so no join is needed and a conversion
stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Square feet in a square metre, and factors from joules and watts.
FT2 = 10.7639104167097
ENERGY = {
    "Wh": 0.000277777777777778,
    "kWh": 0.000277777777777778e-3,
    "MWh": 0.000277777777777778e-6,
    "kJ": 1e-3,
    "MJ": 1e-6,
    "GJ": 1e-9,
    "Btu": 0.000947817,
    "kBtu": 0.000947817e-3,
    "MBtu": 0.000947817e-6,
}
RATE = {
    "kW": 1e-3,
    "MW": 1e-6,
    "Btu/h": 3.4121412858518,
    "kBtu/h": 3.4121412858518e-3,
    "MBtu/h": 3.4121412858518e-6,
}
# SI unit, IP unit and factor.
IP = {
    "$/(m3/s)": ("$/(ft3/min)", 0.000472000059660808),
    "$/(W/K)": ("$/(Btu/h-F)", 0.52667614683731),
    "$/kW": ("$/(kBtuh/h)", 0.293083235638921),
    "$/m2": ("$/ft2", 0.0928939733269818),
    "$/m3": ("$/ft3", 0.0283127014102352),
    "(kg/s)/W": ("(lbm/sec)/(Btu/hr)", 0.646078115385742),
    "1/K": ("1/F", 0.555555555555556),
    "1/m": ("1/ft", 0.3048),
    "A/K": ("A/F", 0.555555555555556),
    "cm": ("in", 0.3937),
    "cm2": ("inch2", 0.15500031000062),
    "deltaC": ("deltaF", 1.8),
    "deltaC/hr": ("deltaF/hr", 1.8),
    "deltaJ/kg": ("deltaBtu/lb", 0.0004299),
    "g/GJ": ("lb/MWh", 0.00793664091373665),
    "g/kg": ("grains/lb", 7),
    "g/MJ": ("lb/MWh", 7.93664091373665),
    "g/mol": ("lb/mol", 0.0022046),
    "g/m-s": ("lb/ft-s", 0.000671968949659),
    "g/m-s-K": ("lb/ft-s-F", 0.000373574867724868),
    "GJ": ("ton-hrs", 78.9889415481832),
    "J/K": ("Btu/F", 526.565),
    "J/kg-K": ("Btu/lb-F", 0.000239005736137667),
    "J/kg-K2": ("Btu/lb-F2", 0.000132889924714692),
    "J/kg-K3": ("Btu/lb-F3", 7.38277359526066e-05),
    "J/m2-K": ("Btu/ft2-F", 4.89224766847393e-05),
    "J/m3": ("Btu/ft3", 2.68096514745308e-05),
    "J/m3-K": ("Btu/ft3-F", 1.49237004739337e-05),
    "K": ("R", 1.8),
    "K/m": ("F/ft", 0.54861322767449),
    "kg": ("lb", 2.2046),
    "kg/J": ("lb/Btu", 2325.83774250441),
    "kg/kg-K": ("lb/lb-F", 0.555555555555556),
    "kg/m": ("lb/ft", 0.67196893069637),
    "kg/m2": ("lb/ft2", 0.204794053596664),
    "kg/m3": ("lb/ft3", 0.062428),
    "kg/m-s": ("lb/ft-s", 0.67196893069637),
    "kg/m-s-K": ("lb/ft-s-F", 0.373316072609094),
    "kg/m-s-K2": ("lb/ft-s-F2", 0.207397818116164),
    "kg/Pa-s-m2": ("lb/psi-s-ft2", 1412.00523459398),
    "kg/s": ("lb/s", 2.20462247603796),
    "kg/s2": ("lb/s2", 2.2046),
    "kg/s-m": ("lb/s-ft", 0.67196893069637),
    "kJ/kg": ("Btu/lb", 0.429925),
    "kPa": ("psi", 0.145038),
    "L/day": ("pint/day", 2.11337629827348),
    "L/GJ": ("gal/kWh", 0.000951022349025202),
    "L/kWh": ("pint/kWh", 2.11337629827348),
    "L/MJ": ("gal/kWh", 0.951022349025202),
    "lux": ("foot-candles", 0.092902267),
    "m": ("ft", 3.28083989501312),
    "m/hr": ("ft/hr", 3.28083989501312),
    "m/s": ("ft/min", 196.850393700787),
    "m/yr": ("inch/yr", 39.3700787401575),
    "m2": ("ft2", 10.7639104167097),
    "m2/m": ("ft2/ft", 3.28083989501312),
    "m2/person": ("ft2/person", 10.764961),
    "m2/s": ("ft2/s", 10.7639104167097),
    "m2-K/W": ("ft2-F-hr/Btu", 5.678263),
    "m3": ("gal", 264.172037284185),
    "m3/GJ": ("ft3/MWh", 127.13292),
    "m3/hr": ("ft3/hr", 35.3146667214886),
    "m3/hr-m2": ("ft3/hr-ft2", 3.28083989501312),
    "m3/hr-person": ("ft3/hr-person", 35.3146667214886),
    "m3/kg": ("ft3/lb", 16.018),
    "m3/m2": ("ft3/ft2", 3.28083989501312),
    "m3/MJ": ("ft3/kWh", 127.13292),
    "m3/person": ("ft3/person", 35.3146667214886),
    "m3/s": ("ft3/min", 2118.88000328931),
    "m3/s-m": ("ft3/min-ft", 645.89),
    "m3/s-m2": ("ft3/min-ft2", 196.85),
    "m3/s-person": ("ft3/min-person", 2118.6438),
    "m3/s-W": ("(ft3/min)/(Btu/h)", 621.099127332943),
    "N-m": ("lbf-in", 8.85074900525547),
    "N-s/m2": ("lbf-s/ft2", 0.0208857913669065),
    "Pa": ("psi", 0.000145037743897283),
    "percent/K": ("percent/F", 0.555555555555556),
    "person/m2": ("person/ft2", 0.0928939733269818),
    "s/m": ("s/ft", 0.3048),
    "V/K": ("V/F", 0.555555555555556),
    "W/((m3/s)-Pa)": ("W/((gal/min)-ftH20)", 0.188582274697355),
    "W/(m3/s)": ("W/(ft3/min)", 0.0004719475),
    "W/K": ("Btu/h-F", 1.89563404769544),
    "W/m": ("Btu/h-ft", 1.04072),
    "W/m2": ("W/sqf", 1 / 10.7639104167097),
    "W/m2-K": ("Btu/h-ft2-F", 0.176110194261872),
    "W/m2-K2": ("Btu/h-ft2-F2", 0.097826),
    "W/m-K": ("Btu-in/h-ft2-F", 6.93481276005548),
    "W/m-K2": ("Btu/h-F2-ft", 0.321418310071648),
    "W/m-K3": ("Btu/h-F3-ft", 0.178565727817582),
    "W/person": ("Btu/h-person", 3.4121412858518),
}
# Conversions with an offset.
IP_AFFINE = {
    "C": ("F", 1.8, 32.0),
    "J/kg": ("Btu/lb", 0.00042986, 7.686),
}

Conversion = tuple[str, float, float]


def energy_table(target: str) -> dict[str, Conversion]:
    """From J and J/m2 to the target; nothing for J itself."""
    if target == "J":
        return {}
    if target not in ENERGY:
        raise ValueError(f"no such energy unit: {target}")
    factor = ENERGY[target]
    area = (f"{target}/ft2", factor / FT2, 0.0) if target.endswith("Btu") else (f"{target}/m2", factor, 0.0)
    return {"J": (target, factor, 0.0), "J/m2": area}


def rate_table(target: str) -> dict[str, Conversion]:
    """From W and W/m2 to the target; nothing for W itself."""
    if target == "W":
        return {}
    if target not in RATE:
        raise ValueError(f"no such rate unit: {target}")
    factor = RATE[target]
    area = (f"{target}-ft2", factor / FT2, 0.0) if "Btu" in target else (f"{target}/m2", factor, 0.0)
    return {"W": (target, factor, 0.0), "W/m2": area}


def conversions(units_system: str = "SI", rate_units: str = "W", energy_units: str = "J") -> dict[str, Conversion]:
    """All conversions asked for; energy and rate win over the units system."""
    out: dict[str, Conversion] = {}
    if units_system == "IP":
        out |= {k: (to, f, 0.0) for k, (to, f) in IP.items()} | IP_AFFINE
    return out | energy_table(energy_units) | rate_table(rate_units)


def _pick(table: dict[str, Conversion], units: Column, which: int, other: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(units == k, F.lit(v[which])) if out is None else out.when(units == k, F.lit(v[which]))
    return other if out is None else out.otherwise(other)


def converted(value: Column, units: Column, table: dict[str, Conversion]) -> Column:
    """The converted value; unknown units stay."""
    out = None
    for k, (_, factor, offset) in table.items():
        expr = value * F.lit(float(factor)) + F.lit(float(offset)) if offset else value * F.lit(float(factor))
        out = F.when(units == k, expr) if out is None else out.when(units == k, expr)
    return value if out is None else out.otherwise(value)


def converted_units(units: Column, table: dict[str, Conversion]) -> Column:
    return _pick(table, units, 0, units)


def convert(df: DataFrame, table: dict[str, Conversion], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Convert the value columns and the units of long rows; names once, at the end."""
    if not table:
        return df
    for v in values:
        df = df.withColumn(v, converted(F.col(v), F.col("units"), table))
    return df.withColumn("units", converted_units(F.col("units"), table))


def rate_like(units: set[str]) -> bool:
    """Whether units mix a rate and its energy, so that rates can become energy."""
    return units == {"J", "W"} or units == {"J/m2", "W/m2"}


def step_kinds(steps: DataFrame) -> DataFrame:
    """Of each table: `(file_id, table, n, least, most, step_s)` with the
    differences of successive stamps in seconds; step_s is set if all are alike."""
    w = Window.partitionBy("file_id", "table").orderBy("ts")
    diff = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    return (
        steps.where("ts is not null")
        .withColumn("diff", diff)
        .groupBy("file_id", "table")
        .agg(F.count("*").alias("n"), F.min("diff").alias("least"), F.max("diff").alias("most"))
        .withColumn("step_s", F.when(F.col("least") == F.col("most"), F.col("least")))
        .withColumn("is_hourly", F.coalesce(F.col("step_s") == 3600, F.lit(False)))
        .withColumn("is_daily", F.coalesce(F.col("step_s") == 86400, F.lit(False)))
        .withColumn("is_timestep", F.coalesce(F.col("step_s") < 3600, F.lit(False)))
        .withColumn("n_steps", F.when(F.col("step_s") <= 3600, F.lit(3600.0) / F.col("step_s")))
    )


def rate_to_energy(df: DataFrame, step_s: float | None) -> DataFrame:
    """W to J and W/m2 to J/m2 on long rows with n_days; the step is that of the
    whole table, and rows of longer intervals count their days."""
    seconds = F.lit(float(step_s)) if step_s is not None else F.col("n_days") * F.lit(86400.0)
    rate = F.col("units").isin("W", "W/m2")
    return df.withColumn("value", F.when(rate, F.col("value") * seconds).otherwise(F.col("value"))).withColumn("units", F.when(F.col("units") == "W", "J").when(F.col("units") == "W/m2", "J/m2").otherwise(F.col("units")))
