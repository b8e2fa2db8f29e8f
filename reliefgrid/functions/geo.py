"""Great-circle geometry and corridor travel time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import as_col, rnd

EARTH_KM = 6371.0

# Rail stations in track order (name, latitude, longitude) for the two lines.
RAIL_LINES = {
    "ets": [
        ("Padang Besar", 6.65, 100.20),
        ("Arau", 6.43, 100.27),
        ("Alor Setar", 6.12, 100.37),
        ("Gurun", 5.82, 100.48),
        ("Sungai Petani", 5.64, 100.49),
        ("Butterworth", 5.39, 100.37),
        ("Bukit Mertajam", 5.36, 100.46),
        ("Nibong Tebal", 5.17, 100.48),
        ("Taiping", 4.85, 100.73),
        ("Kuala Kangsar", 4.77, 100.94),
        ("Ipoh", 4.60, 101.09),
        ("Batu Gajah", 4.48, 101.04),
        ("Kampar", 4.31, 101.15),
        ("Tapah Road", 4.20, 101.27),
        ("Tanjung Malim", 3.68, 101.52),
        ("Rawang", 3.32, 101.58),
        ("KL Sentral", 3.14, 101.69),
        ("Kajang", 3.00, 101.79),
        ("Seremban", 2.73, 101.94),
        ("Tampin", 2.47, 102.23),
        ("Gemas", 2.58, 102.61),
    ],
    "jungle": [
        ("Gemas", 2.58, 102.61),
        ("Bahau", 2.81, 102.41),
        ("Triang", 3.23, 102.43),
        ("Mentakab", 3.48, 102.35),
        ("Jerantut", 3.93, 102.36),
        ("Kuala Lipis", 4.18, 102.05),
        ("Gua Musang", 4.88, 101.97),
        ("Dabong", 5.38, 102.01),
        ("Kuala Krai", 5.53, 102.20),
        ("Tanah Merah", 5.81, 102.15),
        ("Pasir Mas", 6.04, 102.14),
        ("Wakaf Bharu", 6.16, 102.23),
        ("Tumpat", 6.20, 102.17),
    ],
}
RAIL_INTERCHANGE = "Gemas"
RAIL_ACCESS_KM = 25.0
RAIL_MIN_PAIR_KM = 15.0

# Name keywords of mountain places.
MOUNTAIN_PATTERN = "cameron|genting|fraser|kundasang|ranau|kinabalu|crocker|banjaran titiwangsa"

# Corridor labels.
MODE_RAIL_ETS = "KTM ETS / Komuter Rail"
MODE_RAIL_JUNGLE = "KTM Jungle Railway"
MODE_RAIL_TRANSFER = "KTM ETS + Jungle Rail (via Gemas transfer)"
MODE_MOUNTAIN_ROAD = "Federal Route 59 / Mountain Road (no rail link)"
MODE_EXPRESSWAY = "PLUS Expressway & Federal Road"
MODE_FEDERAL = "Federal Road & Express Coach"
MODE_LOCAL = "Federal / State Road"


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance in km."""
    a1, o1, a2, o2 = (as_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(a2 - a1) / 2.0)
    half_lon = F.sin(F.radians(o2 - o1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def destination_point(lat: Column | str, lon: Column | str, bearing_deg: Column, distance_m: Column | float) -> Column:
    """struct(lat, lon) reached from a point along a bearing."""
    arc = as_col(distance_m) / (EARTH_KM * 1000.0)
    phi, lam, theta = F.radians(as_col(lat)), F.radians(as_col(lon)), F.radians(bearing_deg)
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta))
    lam2 = lam + F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(phi2))
    return F.struct(F.degrees(phi2).alias("lat"), F.degrees(lam2).alias("lon"))


def circle_ring(lat: Column | str, lon: Column | str, radius_m: Column | str, segments: int = 64) -> Column:
    """Closed ring of ``segments`` + 1 points; the radius is held within 6-40 km."""
    radius = F.greatest(F.lit(6000.0), F.least(F.lit(40000.0), as_col(radius_m).cast("double")))
    step = 360.0 / segments
    return F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: destination_point(lat, lon, (i % segments).cast("double") * step, radius),
    )


def radius_from_hectares(hectares: Column | str) -> Column:
    """Radius in metres of the circle with the same area, to the nearest 500 m (half even); null for a negative area."""
    area = as_col(hectares)
    metres = F.sqrt(F.when(area >= 0, area) / 100.0 / F.pi()) * 1000.0
    return (F.bround(metres / 500.0) * 500).cast("long")


def is_mountain(name: Column | str, pattern: str = MOUNTAIN_PATTERN) -> Column:
    return F.coalesce(F.lower(as_col(name)).rlike(pattern), F.lit(False))


def is_east_coast(state: Column | str, lon: Column | str) -> Column:
    state, lon = as_col(state), as_col(lon)
    return state.isin("Kelantan", "Terengganu") | (state.isin("Pahang", "Johor") & (lon > 102.8))


def _stops(lines: list[str]) -> Column:
    """Fixed stations as one array literal: struct(ord, name, line, seq, lat, lon)."""
    stops = [(line, seq, stop) for line in lines for seq, stop in enumerate(RAIL_LINES[line])]
    structs = [
        f"named_struct('ord', {ordinal}, 'name', '{name}', 'line', '{line}', 'seq', {seq}, 'lat', {lat}D, 'lon', {lon}D)"
        for ordinal, (line, seq, (name, lat, lon)) in enumerate(stops)
    ]
    return F.expr(f"array({', '.join(structs)})")


def nearest_station(lat: Column | str, lon: Column | str, access_km: float = RAIL_ACCESS_KM) -> Column:
    """struct(dist_km, ord, name, line, seq, lat, lon) of the closest station, null beyond ``access_km``.

    The network is a fixed short list, so it rides in the expression and needs no join.
    """
    fields = ["ord", "name", "line", "seq", "lat", "lon"]
    ranked = F.transform(
        _stops(list(RAIL_LINES)),
        lambda s: F.struct(haversine_km(lat, lon, s["lat"], s["lon"]).alias("dist_km"), *[s[f].alias(f) for f in fields]),
    )
    # an array of none or one element, so the search is written once in the plan
    best = F.filter(F.array(F.array_min(ranked)), lambda s: s["dist_km"] <= access_km)
    return F.get(best, F.lit(0))


def road_profile(straight_km: Column, mountain: Column) -> Column:
    """struct(road_km, time_mins, speed_kmh, label, mountain) of an honest road estimate."""

    def banded(mountain_value, over_120, over_60, over_25, rest):
        return (
            F.when(mountain, F.lit(mountain_value))
            .when(straight_km > 120.0, F.lit(over_120))
            .when(straight_km > 60.0, F.lit(over_60))
            .when(straight_km > 25.0, F.lit(over_25))
            .otherwise(F.lit(rest))
        )

    circuity = banded(1.75, 1.32, 1.35, 1.30, 1.25)
    speed = banded(38.0, 70.0, 60.0, 50.0, 45.0)
    road_km = straight_km * circuity
    return F.struct(
        rnd(road_km, 1).alias("road_km"),
        F.greatest(F.lit(15.0), rnd(road_km / speed * 60.0 + 8.0)).alias("time_mins"),
        speed.alias("speed_kmh"),
        banded(MODE_MOUNTAIN_ROAD, MODE_EXPRESSWAY, MODE_FEDERAL, MODE_FEDERAL, MODE_LOCAL).alias("label"),
        mountain.alias("mountain"),
    )


def rail_viable(straight_km: Column, o_station: Column, d_station: Column) -> Column:
    """Both ends near a station and far enough apart; the two lines meet, so a line change is allowed."""
    return o_station.isNotNull() & d_station.isNotNull() & (straight_km >= RAIL_MIN_PAIR_KM)


def corridor(straight_km: Column, mountain: Column, o_station: Column, d_station: Column) -> Column:
    """struct(distance_km, travel_time_mins, transit_mode, rail_viable); distance is always by road."""
    road = road_profile(straight_km, mountain)
    viable = rail_viable(straight_km, o_station, d_station)
    transfer = o_station["line"] != d_station["line"]
    rail_mins = straight_km * 1.25 / 75.0 * 60.0 + 18.0 + F.when(transfer, F.lit(30.0)).otherwise(F.lit(0.0))
    rail_mode = (
        F.when(transfer, F.lit(MODE_RAIL_TRANSFER))
        .when(o_station["line"] == "ets", F.lit(MODE_RAIL_ETS))
        .otherwise(F.lit(MODE_RAIL_JUNGLE))
    )
    return F.struct(
        road["road_km"].alias("distance_km"),
        F.when(viable, F.greatest(F.lit(20.0), rnd(rail_mins))).otherwise(road["time_mins"]).alias("travel_time_mins"),
        F.when(viable, rail_mode).otherwise(road["label"]).alias("transit_mode"),
        viable.alias("rail_viable"),
    )


def _between_stations(line: str, from_seq: Column, to_seq: Column) -> Column:
    """Track points after ``from_seq`` up to and including ``to_seq``, in travel order."""
    low, high = F.least(from_seq, to_seq), F.greatest(from_seq, to_seq)
    span = F.filter(_stops([line]), lambda s: (s["seq"] >= low) & (s["seq"] <= high) & (s["seq"] != from_seq))
    points = F.transform(span, lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")))
    return F.when(to_seq < from_seq, F.reverse(points)).otherwise(points)


def rail_path(
    o_lat: Column | str, o_lon: Column | str, d_lat: Column | str, d_lon: Column | str, o_station: Column, d_station: Column
) -> Column:
    """array(struct(lat, lon)): origin, stations along the track, destination; null when rail is not viable."""

    def point(lat, lon):
        return F.struct(as_col(lat).alias("lat"), as_col(lon).alias("lon"))

    start, end = point(rnd(o_lat, 5), rnd(o_lon, 5)), point(rnd(d_lat, 5), rnd(d_lon, 5))
    o_stop, d_stop = point(o_station["lat"], o_station["lon"]), point(d_station["lat"], d_station["lon"])
    direct = F.when(
        o_station["line"] == "ets", _between_stations("ets", o_station["seq"], d_station["seq"])
    ).otherwise(_between_stations("jungle", o_station["seq"], d_station["seq"]))
    same_line = F.concat(F.array(start), F.array(o_stop), direct, F.array(end))
    # drop a point equal to the one before it
    same_line = F.filter(same_line, lambda p, i: (i == 0) | (F.coalesce(F.get(same_line, i - 1), end) != p))
    meet = {line: [s[0] for s in stations].index(RAIL_INTERCHANGE) for line, stations in RAIL_LINES.items()}
    ets_first = F.concat(
        _between_stations("ets", o_station["seq"], F.lit(meet["ets"])),
        _between_stations("jungle", F.lit(meet["jungle"]), d_station["seq"]),
    )
    jungle_first = F.concat(
        _between_stations("jungle", o_station["seq"], F.lit(meet["jungle"])),
        _between_stations("ets", F.lit(meet["ets"]), d_station["seq"]),
    )
    changed = F.concat(
        F.array(point(o_lat, o_lon)),
        F.array(o_stop),
        F.when(o_station["line"] == "ets", ets_first).otherwise(jungle_first),
        F.array(d_stop),
        F.array(point(d_lat, d_lon)),
    )
    viable = rail_viable(haversine_km(o_lat, o_lon, d_lat, d_lon), o_station, d_station)
    return F.when(viable, F.when(o_station["line"] == d_station["line"], same_line).otherwise(changed))
