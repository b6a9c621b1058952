"""Variables, limits and texts of the quality control."""

from __future__ import annotations

VARS = ("T", "P", "RH")
NAMES = {"T": "Temperature", "P": "Pressure", "RH": "Humidity"}
UNITS = {"T": "°C", "P": "hPa", "RH": "%"}
SENSORS = {"T": "Temperature probe", "P": "Barometer", "RH": "Humidity sensor"}
#: Hard limits, both ends allowed.
RANGE = {"T": (-15.0, 50.0), "P": (500.0, 1080.0), "RH": (0.0, 100.0)}
#: Largest believable change in a minute.
STEP = {"T": 3.0, "P": 1.5, "RH": 20.0}
TOLERANCE = {"T": 1.0, "P": 1.0, "RH": 5.0}
#: Usual sensor noise, one standard deviation.
NOISE = {"T": 0.08, "P": 0.05, "RH": 0.5}
#: Least standard deviation of a spatial residual.
FLOOR = {"T": 0.35, "P": 0.25, "RH": 2.0}
#: Equal readings in a row, after the first, that make a sensor stuck.
STUCK = {"T": 15, "P": 15, "RH": 20}
THRESHOLD, INSTANT_P, HARD_P = 0.7, 0.5, 0.99
RADIUS_KM, MOST_NEIGHBOURS, EARTH_KM = 100.0, 6, 6371.0
WARMUP, SLACK = 300, 20

LABEL = {"spike": "Transient spike", "level_shift": "Sudden jump", "drift": "Slow drift", "stuck": "Stuck reading", "noise_burst": "Noise burst", "comm_error": "Communication error", "power_glitch": "Power glitch"}
CAUSE = {
    "spike": "Electrical interference or a transient sensor fault",
    "level_shift": "Sensor damage or a sudden calibration shift",
    "drift": "Calibration drift or sensor ageing",
    "stuck": "Frozen sensor or a logger that has hung",
    "noise_burst": "Loose connection or moisture in the sensor",
    "comm_error": "Communication, logger or power-supply failure",
    "power_glitch": "Power fluctuation (battery, solar controller or brown-out)",
}
ACTION = {
    "spike": "Inspect wiring and shielding of the {s} within 48 hours",
    "level_shift": "Replace or recalibrate the {s} within 48 hours",
    "drift": "Recalibrate the {s} within 7 days",
    "stuck": "Check the logger and wiring of the {s}, power-cycle and verify within 24 hours",
    "noise_burst": "Check connectors and moisture ingress on the {s} within 72 hours",
    "comm_error": "Check the GPRS/modem link, logger and power supply within 24 hours",
    "power_glitch": "Check the battery, solar charge controller and power supply within 48 hours",
}
SEVERITY = {"spike": 2, "level_shift": 2, "stuck": 2, "power_glitch": 2, "comm_error": 1, "noise_burst": 1, "drift": 1}
SEVERITIES = ("low", "medium", "high")
#: Column names by which a reader knows a variable, whatever their case.
ALIASES = {
    "station": ("station", "station_id", "id"),
    "time": ("time", "timestamp", "datetime", "date_time"),
    "T": ("temperature", "temp", "t", "ta"),
    "P": ("pressure", "pres", "p", "slp"),
    "RH": ("humidity", "rh", "relative_humidity"),
}

#: Fixed texts that operators return, with the values that they name in braces.
CHECKS = {
    "qc": ("Quick check on the station", "range · jump · stuck · missing"),
    "physics": ("Physics check", "T ↔ RH dew point"),
    "neighbour": ("Neighbour check", "buddy · 100 km"),
    "ai": ("AI check", "IsolationForest + autoencoder"),
}
CHECK_TEXT = {
    "packets": "Missing or invalid packets for {bad} of {minutes} minutes.",
    "range": "{name} {value} {unit} is outside the {low} to {high} limit.",
    "step": "{name} changed {value} {unit} in 1 minute.",
    "stuck": "{name} identical for {count} readings in a row.",
    "qc_pass": "No impossible values, sudden jumps, stuck or missing readings.",
    "physics_fail": "Temperature and humidity together imply a dew point of {dew} °C, moved {moved} °C in 30 minutes. Air moisture cannot change that fast.",
    "physics_pass": "Temperature, pressure and humidity are consistent. Dew point steady.",
    "neighbour_fail": "{name} is {size} {unit} from {n} stations within {km} km. Only this station is off.",
    "neighbour_warn": "Close to the {n} stations within {km} km. The fault shows in the station's own signals.",
    "neighbour_na": "No other station within 100 km. Physics and AI only, so confidence is lower.",
    "ai": "Unusualness score {score} against this station's own learned pattern (1.0 = outside 99.9% of normal behaviour).",
}
WHO = {"near": "{n} nearby stations stayed normal", "alone": "no neighbour is available to confirm, so physics and AI decided"}
SENTENCE = {
    "comm_error": "Flagged: packets are missing or invalid for {minutes} minutes, so all three readings are unusable.",
    "stuck": "Flagged: {names} have not changed for {minutes} minutes{tail}",
    "noise_burst": "Flagged: {name} readings became erratic for {minutes} minutes with no matching weather change, while {who}.",
    "power_glitch": "Flagged: temperature, pressure and humidity jumped together at random for {minutes} minutes, the signature of a power fault, while {who}.",
    "spike": "Flagged: {name} jumped {size} {unit} for {minutes} minutes and returned, while {who}.",
    "drift": "Flagged: {name} has crept {size} {unit} away from the expected value over {minutes} minutes, while {who}.",
    "level_shift": "Flagged: {name} jumped {size} {unit} within minutes and stayed there, while {who}.",
}
STUCK_TAIL = {"near": " while {n} nearby stations kept moving.", "alone": "."}
SHARES = ("Difference from neighbours", "Dew-point jump (physics)", "Broke a station limit", "Unusual for this station (AI)")
EVENT_TEXT = {
    "extreme": "Not a fault: temperature is {size} °C from normal, and {agree} of {n} nearby stations show the same departure. Real weather is kept, not deleted.",
    "weather": "Not a fault: temperature, pressure and humidity changed together, and {agree} of {n} nearby stations saw the same change. Real weather is kept, not deleted.",
    "alone": "Unusual but physically consistent. No neighbour is available to confirm, so it is kept with a lower confidence.",
}
NOTES = {
    "drift": "{sensor} is drifting {rate} {unit} per day and is expected to exceed its {limit} {unit} tolerance in about {days} days. Schedule recalibration.",
    "weak": "{sensor} health {score}/100. Inspect at the next visit.",
    "none": "No maintenance needed.",
}
#: Names of sensors that fail together.
PROBE, LOGGER = "Temperature / humidity probe", "Logger (all sensors)"
