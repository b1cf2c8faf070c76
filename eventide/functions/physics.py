"""Column expressions: distances, solar geometry, moist thermodynamics, kernels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.195
SOLAR = 1361.0


def km_per_deg_lat() -> Column:
    return F.lit(KM_PER_DEGREE)


def km_per_deg_lon(lat: Column) -> Column:
    return KM_PER_DEGREE * F.cos(F.radians(lat))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def local_solar_hour(lon: Column, utc_hour: Column) -> Column:
    return F.pmod(utc_hour + lon / 15, F.lit(24.0))


def local_slot_offset(lon: Column) -> Column:
    """Three-hourly slots from UTC to local time, halves up."""
    return F.floor(lon / 45 + 0.5).cast("int")


def linear_hour(hour: Column) -> Column:
    """Hours after midnight follow the evening: 24 is added below 12."""
    return F.when(hour < 12, hour + 24).otherwise(hour)


def cos_zenith(lat: Column, lon: Column, day_of_year: Column, utc_hour: Column) -> Column:
    """Cosine of the solar zenith angle, not below 0, with a simple declination."""
    declination = F.radians(F.lit(-23.44)) * F.cos(2 * F.pi() * (day_of_year + 10) / 365.0)
    angle = F.radians((local_solar_hour(lon, utc_hour) - 12) * 15)
    return F.greatest(F.lit(0.0), F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle))


def clear_sky_flux(mu: Column, transmissivity: float = 0.75) -> Column:
    return SOLAR * mu * transmissivity


def contact_weight(alt: Column, depth: Column, fraction: float = 1.0, taper: float = 0.2) -> Column:
    """1 inside the layer, a linear ramp to 0 over the taper above it, 0 for invalid input."""
    top = depth * fraction
    ramp = 1 - (alt - top) / (top * taper)
    return F.when(alt.isNull() | depth.isNull() | (depth <= 0) | (alt < 0), 0.0).when(alt <= top, 1.0).when(alt >= top * (1 + taper), 0.0).otherwise(ramp)


def diurnal_shape(hour: Column, rise: float = 7.0, peak: float = 15.0, fall: float = 19.0) -> Column:
    """0 at night and at both ends of the day, 1 at the peak, along half cosines."""
    rising = 0.5 * (1 - F.cos(F.pi() * (hour - rise) / (peak - rise)))
    falling = 0.5 * (1 + F.cos(F.pi() * (hour - peak) / (fall - peak)))
    return F.when((hour > rise) & (hour <= peak), rising).when((hour > peak) & (hour < fall), falling).when(hour.isNotNull(), 0.0)


def layer_depth(lon: Column, utc_hour: Column, night: float = 200.0, day: float = 1800.0, west_per_degree: float = 50.0, reference_lon: float = -65.0) -> Column:
    """Climatological depth of the mixed layer in metres: a nightly floor, a daily maximum that deepens westward."""
    top = F.greatest(day + west_per_degree * (reference_lon - lon), F.lit(night))
    return night + (top - night) * diurnal_shape(local_solar_hour(lon, utc_hour))


def specific_humidity(mixing_g_kg: Column) -> Column:
    """kg/kg from a mixing ratio in g/kg; a zero reading is missing."""
    r = F.nullif(mixing_g_kg, F.lit(0.0)) / 1000
    return r / (1 + r)


def spread_km(travelled: Column, base: float = 20.0, growth: float = 0.1, factor: float = 1.0) -> Column:
    return base + factor * growth * travelled


def condensation_discount(arrival: Column, here: Column) -> Column:
    """Share of the moisture here that arrives, within 0 and 1; 1 for invalid input."""
    return F.when(arrival.isNull() | here.isNull() | (here <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), arrival / here)))


def dew_point_k(mixing: Column, hpa: Column) -> Column:
    """Dew point from mixing ratio (kg/kg) and pressure (hPa) by Bolton's vapour pressure."""
    e = mixing * hpa / (0.622 + mixing)
    x = F.log(e / 6.112)
    return 243.5 * x / (17.67 - x) + 273.15


def saturation_hpa(kelvin: Column) -> Column:
    c = kelvin - 273.15
    return 6.112 * F.exp(17.67 * c / (c + 243.5))


def relative_humidity(kelvin: Column, mixing: Column, hpa: Column) -> Column:
    return mixing * hpa / (0.622 + mixing) / saturation_hpa(kelvin)


def virtual_k(kelvin: Column, mixing: Column) -> Column:
    return kelvin * (1 + mixing / 0.622) / (1 + mixing)


def theta_e(kelvin: Column, mixing: Column, hpa: Column) -> Column:
    """Bolton (1980), equations 15 and 43."""
    td = dew_point_k(mixing, hpa)
    lcl = 1 / (1 / (td - 56) + F.log(kelvin / td) / 800) + 56
    r = mixing * 1000
    return kelvin * F.pow(1000 / hpa, 0.2854 * (1 - 0.00028 * r)) * F.exp((3.376 / lcl - 0.00254) * r * (1 + 0.00081 * r))


def cycle_day(day: Column, length: int = 16) -> Column:
    """Position in a repeating cycle of days."""
    return F.pmod(F.datediff(day, F.lit("2000-01-01").cast("date")), F.lit(length))


def nearest_branch(lon: Column, to: Column) -> Column:
    """A longitude moved by whole turns next to another."""
    return to + F.pmod(lon - to + 180, F.lit(360.0)) - 180


def _share(a: Column, b: Column, ieee: bool = False) -> Column:
    share = F.when(b > 0, a / b)
    return share.when(a > 0, float("inf")).when(b == 0, float("nan")) if ieee else share


def contingency_scores(pred_hit: Column, pred_miss: Column, truth_hit: Column, truth_miss: Column, ieee: bool = False) -> dict[str, Column]:
    """Detection, false alarms, critical success and bias of symmetric neighbourhood counts.

    Shares of nothing are null, or with ``ieee`` what floating-point division gives: infinite, or NaN where both counts are zero.
    """
    pod, far = _share(truth_hit, truth_hit + truth_miss, ieee), _share(pred_miss, pred_hit + pred_miss, ieee)
    csi = F.when(F.isnan(pod) | F.isnan(far), float("nan")).when((pod > 0) & (far < 1), 1 / (1 / pod + 1 / (1 - far) - 1)).when(pod.isNotNull() & far.isNotNull(), 0.0)
    return {"pod": pod, "far": far, "csi": csi, "fb": _share(pred_hit + pred_miss, truth_hit + truth_miss, ieee)}
