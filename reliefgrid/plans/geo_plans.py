"""Distance joins, corridors, zones and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.geo import RAIL_INTERCHANGE, RAIL_LINES, circle_ring, haversine_km, is_mountain, nearest_station, radius_from_hectares, road_profile
from reliefgrid.functions.numeric import rnd
from reliefgrid.functions.text import slug
from reliefgrid.operators import traffic, zones
from reliefgrid.operators.nearby import nearest, radius_join
from reliefgrid.plans.mapping import places, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import CIRCUITY, LABELS, MOUNTAIN, PLACE_STOP, PLACES, SPEED, STOPS, banded, corridor_columns, km, r
from reliefgrid.session import cut_lineage

# homes: customers with formula coordinates
HOMES = """homes AS (SELECT c_custkey, c_name, c_nationkey, 1e0+(c_custkey*41%640)/100e0 AS c_lat, 100e0+(c_custkey*59%1880)/100e0 AS c_lon FROM customer)"""
ZONES = f"""{HOMES},
zones AS (SELECT 'Z'||c_custkey AS key, c_name AS nama, c_lat AS lat, c_lon AS lon, 6000+(c_custkey*7%69)*500 AS radius_m FROM homes)"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key, "c_name", "c_nationkey",
        ((key * 41 % 640) / 100.0 + 1.0).alias("c_lat"), ((key * 59 % 1880) / 100.0 + 100.0).alias("c_lon"),
    )


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return homes(spark, sf_dir).select(
        F.concat(F.lit("Z"), key.cast("string")).alias("key"), F.col("c_name").alias("nama"), F.lit("").alias("daerah"),
        F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), (key * 7 % 69 * 500 + 6000).alias("radius_m"),
    )


@query(
    "within_radius",
    f"""WITH {PLACES},{HOMES} SELECT destination_id, c_custkey, {r('d',6)} AS straight_km
    FROM (SELECT destination_id, c_custkey, {km('lat','lon','c_lat','c_lon')} AS d FROM places, homes) x WHERE d<=40e0""",
)
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = radius_join(
        places(spark, sf_dir).select("destination_id", "lat", "lon"), homes(spark, sf_dir), ("lat", "lon"), ("c_lat", "c_lon"),
        right_key="c_custkey", left_key="destination_id", radius_km=40.0,
    )
    return near.select("destination_id", "c_custkey", rnd("straight_km", 6).alias("straight_km"))


@query(
    "nearest_point",
    f"""WITH {PLACES},{HOMES}, p AS (SELECT c_custkey, destination_id, {km('c_lat','c_lon','lat','lon')} AS d FROM homes, places)
    SELECT c_custkey, destination_id AS nearest_destination_id, {r('d',6)} AS nearest_km FROM
    (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, destination_id) AS n FROM p) q WHERE n=1""",
)
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(homes(spark, sf_dir), places(spark, sf_dir), "c_custkey", ("c_lat", "c_lon"), "destination_id", ("lat", "lon"))
    return out.withColumn("nearest_km", rnd("nearest_km", 6))


@query(
    "nearest_station",
    f"""WITH {HOMES},{STOPS} SELECT c_custkey, stop_name, line, {r('d',6)} AS dist_km FROM
    (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, ord) AS n FROM (SELECT homes.*, stops.*, {km('c_lat','c_lon','stop_lat','stop_lon')} AS d FROM homes, stops) y) x
    WHERE n=1 AND d<=25e0""",
)
def station_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = homes(spark, sf_dir).withColumn("s", nearest_station("c_lat", "c_lon")).where(F.col("s").isNotNull())
    return stop.select("c_custkey", F.col("s.name").alias("stop_name"), "s.line", rnd("s.dist_km", 6).alias("dist_km"))


# flows: quantity from each supplier to each customer nation; hubs: mean customer position of the nation
FLOWS = f"""{HOMES},
hubs AS (SELECT c_nationkey, n_name AS hub_name, {r('avg(c_lat)',4)} AS h_lat, {r('avg(c_lon)',4)} AS h_lon FROM homes JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2),
flows AS (SELECT l_suppkey, c_nationkey, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"""


def flow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to customer-nation flows with both positions; as many rows as suppliers times nations at most."""
    home = homes(spark, sf_dir)
    hubs = home.groupBy("c_nationkey").agg(rnd(F.avg("c_lat"), 4).alias("h_lat"), rnd(F.avg("c_lon"), 4).alias("h_lon")).join(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("hub_name")), "c_nationkey"
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    flows = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "c_nationkey").agg(
        F.sum("l_quantity").alias("qty")
    )
    spots = places(spark, sf_dir).select(
        F.col("destination_id").alias("l_suppkey"), "destination_name", "lat", "lon", nearest_station("lat", "lon").alias("o_stop")
    )
    hubs = hubs.withColumn("d_stop", nearest_station("h_lat", "h_lon"))
    return flows.join(spots, "l_suppkey").join(hubs, "c_nationkey")


_ROAD_KM = "d*(" + banded("m", "d", tuple(f"{v}e0" for v in CIRCUITY)) + ")"
_ROAD_SPEED = banded("m", "d", tuple(f"{v}e0" for v in SPEED))


@query(
    "road_estimate",
    f"""WITH {PLACES},{FLOWS}, p AS (SELECT l_suppkey, hub_name, {km('lat','lon','h_lat','h_lon')} AS d, regexp_matches(lower(destination_name),'{MOUNTAIN}') AS m
      FROM flows JOIN places ON l_suppkey=destination_id JOIN hubs USING (c_nationkey))
    SELECT l_suppkey, hub_name, {r(_ROAD_KM,1)} AS road_km, greatest(15e0,{r(f'{_ROAD_KM}/({_ROAD_SPEED})*60e0+8e0')}) AS time_mins, {_ROAD_SPEED} AS speed_kmh, {banded('m','d',LABELS)} AS label FROM p""",
)
def road_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = flow_pairs(spark, sf_dir)
    straight = haversine_km("lat", "lon", "h_lat", "h_lon")
    road = pairs.withColumn("straight", straight).withColumn(
        "road", road_profile(F.col("straight"), is_mountain("destination_name", MOUNTAIN))
    )
    return road.select("l_suppkey", "hub_name", "road.road_km", "road.time_mins", "road.speed_kmh", "road.label")


@query(
    "corridor",
    f"""WITH {PLACES},{FLOWS},{STOPS},{PLACE_STOP},
    hub_stop AS (SELECT * FROM (SELECT hub_name, line AS hub_line, row_number() OVER (PARTITION BY hub_name ORDER BY d, ord) AS n, d FROM (SELECT *, {km('h_lat','h_lon','stop_lat','stop_lon')} AS d FROM hubs, stops) y) x WHERE n=1 AND d<=25e0),
    p AS (SELECT l_suppkey, hubs.hub_name, qty, line, hub_line, {km('lat','lon','h_lat','h_lon')} AS d, regexp_matches(lower(destination_name),'{MOUNTAIN}') AS m
      FROM flows JOIN places ON l_suppkey=places.destination_id JOIN hubs USING (c_nationkey) LEFT JOIN place_stop ON place_stop.destination_id=l_suppkey LEFT JOIN hub_stop ON hub_stop.hub_name=hubs.hub_name)
    SELECT l_suppkey, hub_name, qty, {r('d',6)} AS straight_km, {corridor_columns('m','d','line','hub_line')} FROM p""",
)
def corridor_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traffic.pair_corridors(
        flow_pairs(spark, sf_dir), ("lat", "lon"), ("h_lat", "h_lon"), "destination_name", "hub_name", "supplier.*[37]$",
        ("o_stop", "d_stop"),
    )
    return out.select(
        "l_suppkey", "hub_name", "qty", rnd("straight_km", 6).alias("straight_km"), "distance_km", "travel_time_mins", "transit_mode", "rail_viable"
    )


@query(
    "watch_zones",
    f"""WITH {PLACES},{ZONES}, hit AS (SELECT DISTINCT key, destination_name FROM zones, (SELECT destination_name, lat AS p_lat, lon AS p_lon FROM places WHERE continuous_pressure>=1e0) a
      WHERE {km('p_lat','p_lon','lat','lon')}<=radius_m/1000e0)
    SELECT key, count(*) AS watch_count, string_agg(destination_name, ', ' ORDER BY destination_name) AS watch_districts FROM hit GROUP BY key""",
)
def watch_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zones.watch_list(places(spark, sf_dir), zone_table(spark, sf_dir))
    return out.select("key", "watch_count", F.array_join("watch_districts", ", ").alias("watch_districts"))


def _word_list(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}),'[a-z]+'), lambda w: len(w)>4)"


@query(
    "zone_alerts",
    f"""WITH {PLACES},{HOMES},
    zone AS (SELECT 'P'||p_partkey AS key, 1e0+(p_partkey*43%640)/100e0 AS lat, 100e0+(p_partkey*61%1880)/100e0 AS lon, 6000+(p_partkey*11%69)*500 AS radius_m, {_word_list('p_name')} AS words FROM part),
    spot AS (SELECT c_custkey AS destination_id, c_lat AS p_lat, c_lon AS p_lon, {_word_list("c_mktsegment || ' widget ' || homes.c_name")} AS words FROM homes JOIN customer USING (c_custkey)),
    hit AS (SELECT destination_id, key, {km('p_lat','p_lon','lat','lon')}*1000e0 AS dist_m FROM spot, zone
      WHERE {km('p_lat','p_lon','lat','lon')}<=radius_m/1000e0 OR len(list_intersect(spot.words, zone.words))>0)
    SELECT destination_id, key, {r('dist_m',3)} AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY destination_id ORDER BY dist_m, key) AS n FROM hit) t WHERE n=1""",
)
def zone_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    zone = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("key"), F.col("p_name").alias("nama"), F.lit("").alias("daerah"),
        ((key * 43 % 640) / 100.0 + 1.0).alias("lat"), ((key * 61 % 1880) / 100.0 + 100.0).alias("lon"),
        (key * 11 % 69 * 500 + 6000).alias("radius_m"),
    )
    segment = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    spots = homes(spark, sf_dir).join(segment, "c_custkey").select(
        F.col("c_custkey").alias("destination_id"), F.concat_ws(" widget ", "c_mktsegment", "c_name").alias("destination_name"),
        F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"),
    )
    return zones.hotspot_alerts(spots, zone).withColumn("dist_m", rnd("dist_m", 3))


@query(
    "zone_footprints",
    f"""WITH {ZONES}, g AS (SELECT key, lat, lon, greatest(6000e0,least(40000e0,radius_m*1e0))/6371000e0 AS d, unnest(range(0,65)) AS i FROM zones),
    b AS (SELECT *, radians((i%64)*5.625e0) AS t, radians(lat) AS p, radians(lon) AS l FROM g),
    q AS (SELECT *, asin(sin(p)*cos(d)+cos(p)*sin(d)*cos(t)) AS p2 FROM b)
    SELECT key, i::INTEGER AS i, {r('degrees(p2)',6)} AS lat, {r('degrees(l+atan2(sin(t)*sin(d)*cos(p), cos(d)-sin(p)*sin(p2)))',6)} AS lon FROM q""",
)
def zone_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = zone_table(spark, sf_dir).select("key", F.posexplode(circle_ring("lat", "lon", "radius_m")).alias("i", "p"))
    return ring.select("key", "i", rnd("p.lat", 6).alias("lat"), rnd("p.lon", 6).alias("lon"))


@query(
    "zone_keys",
    """SELECT p_partkey, 'ksas'||lpad((p_partkey%15+1)::VARCHAR,2,'0')||'_'||
      CASE WHEN len(regexp_extract_all(lower(p_name),'[a-z]+'))>0 THEN array_to_string(regexp_extract_all(lower(p_name),'[a-z]+')[1:2],'_') ELSE 'tapak' END AS key,
      (round_even(sqrt(p_size*900e0/100e0/pi())*1000e0/500e0,0)*500)::BIGINT AS radius_m FROM part""",
)
def zone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("p_partkey") % 15 + 1).cast("string"), 2, "0")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("ksas"), number, F.lit("_"), slug("p_name")).alias("key"),
        radius_from_hectares(F.col("p_size") * 900.0).alias("radius_m"),
    )


@query(
    "rail_path_length",
    f"""WITH {HOMES},{STOPS}, near AS (SELECT * FROM (SELECT c_custkey, ord, line, seq, row_number() OVER (PARTITION BY c_custkey ORDER BY d, ord) AS n, d FROM (SELECT c_custkey, stops.*, {km('c_lat','c_lon','stop_lat','stop_lon')} AS d FROM homes, stops) y) x WHERE n=1 AND d<=25e0)
    SELECT c_custkey, line, abs(20-seq)+1 AS stops_to_interchange FROM near JOIN homes USING (c_custkey) WHERE line='ets' AND {km('c_lat','c_lon','2.58e0','102.61e0')}>=15e0""",
)
def rail_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations passed from every home with a viable western-line trip down to the interchange."""
    target = homes(spark, sf_dir).withColumns({"t_lat": F.lit(2.58), "t_lon": F.lit(102.61)})
    with_stop = target.withColumn("s", nearest_station("c_lat", "c_lon")).where(F.col("s.line") == "ets")
    paths = traffic.rail_paths(with_stop, ("c_lat", "c_lon"), ("t_lat", "t_lon"))
    # origin, its station, the stations after it, destination (merged with the last station)
    return paths.where(F.col("rail_path").isNotNull()).select("c_custkey", F.col("s.line").alias("line"), (F.size("rail_path") - 1).alias("stops_to_interchange"))


WIDE_ZONES = f"{HOMES}, zones AS (SELECT 'Z'||c_custkey AS key, c_lat AS lat, c_lon AS lon, (1+c_custkey*7%300)*1000 AS radius_m FROM homes)"


@query(
    "watch_zones_wide",
    f"""WITH {PLACES},{WIDE_ZONES} SELECT DISTINCT key AS z_key, destination_name AS p_name FROM zones, (SELECT destination_name, lat AS p_lat, lon AS p_lon FROM places WHERE continuous_pressure>=1e0) a
    WHERE {km('p_lat','p_lon','lat','lon')}<=radius_m/1000e0""",
)
def watch_zones_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of 1 to 300 km."""
    wide = zone_table(spark, sf_dir).withColumn("radius_m", (F.substring("key", 2, 12).cast("long") * 7 % 300 + 1) * 1000)
    return zones.watched_names(places(spark, sf_dir), wide)


@query(
    "display_zones",
    f"""WITH {PLACES},{ZONES}, near AS (SELECT destination_id, continuous_pressure, key, radius_m, d FROM (SELECT destination_id, continuous_pressure, key, radius_m, {km('places.lat','places.lon','zones.lat','zones.lon')} AS d FROM places, zones) x WHERE d<=150e0),
    hit AS (SELECT * FROM near WHERE d<=radius_m/1000e0),
    alert AS (SELECT destination_id, key FROM (SELECT *, row_number() OVER (PARTITION BY destination_id ORDER BY d, key) AS n FROM hit) t WHERE n=1),
    watched AS (SELECT DISTINCT key FROM hit WHERE continuous_pressure>=1e0)
    SELECT near.destination_id, near.key, alert.key IS NOT NULL AS is_alert FROM near LEFT JOIN alert USING (destination_id, key) WHERE near.key NOT IN (SELECT key FROM watched)
    UNION ALL SELECT NULL, key, true FROM watched""",
)
def display_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, circles = cut_lineage(places(spark, sf_dir)), zone_table(spark, sf_dir)
    return zones.display_zones(spots, circles, zones.hotspot_alerts(spots, circles), zones.watch_list(spots, circles))


@query(
    "zone_records",
    """SELECT 'Z'||c_custkey AS key, c_acctbal/100e0 AS gazetted_area_km2, c_mktsegment='BUILDING' AS area_derived FROM customer""",
)
def zone_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags come as text in several spellings."""
    flag = F.when(F.col("c_mktsegment") != "BUILDING", F.lit("False")).when(F.col("c_custkey") % 2 == 0, F.lit(" TRUE ")).otherwise(F.lit("true"))
    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Z"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("luas_h"), flag.alias("area_derived")
    )
    return zones.zone_records(raw).select("key", "gazetted_area_km2", "area_derived")


_MEET = {line: [name for name, *_ in stations].index(RAIL_INTERCHANGE) for line, stations in RAIL_LINES.items()}


def _between(line: str, start: str, end: str) -> str:
    return f"""coalesce((SELECT list({{'lat': stop_lat::DOUBLE, 'lon': stop_lon::DOUBLE}} ORDER BY CASE WHEN {end}<{start} THEN -seq ELSE seq END) FROM stops
      WHERE stops.line={line} AND stops.seq BETWEEN least({start},{end}) AND greatest({start},{end}) AND stops.seq<>{start}), [])"""


def _at(lat: str, lon: str) -> str:
    return f"[{{'lat': ({lat})::DOUBLE, 'lon': ({lon})::DOUBLE}}]"


@query(
    "rail_path_points",
    f"""WITH {HOMES},{STOPS},
    near AS (SELECT * FROM (SELECT c_custkey, c_lat, c_lon, ord, line, seq, stop_lat, stop_lon, row_number() OVER (PARTITION BY c_custkey ORDER BY d, ord) AS n, d
      FROM (SELECT homes.*, stops.*, {km('c_lat','c_lon','stop_lat','stop_lon')} AS d FROM homes, stops) y) x WHERE n=1 AND d<=25e0),
    pair AS (SELECT o.c_custkey, o.line AS o_line, o.seq AS o_seq, d.line AS d_line, d.seq AS d_seq, o.c_lat AS ola, o.c_lon AS olo, d.c_lat AS dla, d.c_lon AS dlo,
      o.stop_lat AS osla, o.stop_lon AS oslo, d.stop_lat AS dsla, d.stop_lon AS dslo,
      CASE o.line WHEN 'ets' THEN {_MEET['ets']} ELSE {_MEET['jungle']} END AS o_meet, CASE d.line WHEN 'ets' THEN {_MEET['ets']} ELSE {_MEET['jungle']} END AS d_meet
      FROM near o JOIN near d ON d.c_custkey=(o.c_custkey*17+5)%(SELECT max(c_custkey) FROM customer) WHERE {km('o.c_lat','o.c_lon','d.c_lat','d.c_lon')}>=15e0),
    path AS (SELECT c_custkey, o_line=d_line AS same, CASE WHEN o_line=d_line
      THEN list_concat({_at(r('ola',5), r('olo',5))}, {_at('osla','oslo')}, {_between('o_line','o_seq','d_seq')}, {_at(r('dla',5), r('dlo',5))})
      ELSE list_concat({_at('ola','olo')}, {_at('osla','oslo')}, {_between('o_line','o_seq','o_meet')}, {_between('d_line','d_meet','d_seq')}, {_at('dsla','dslo')}, {_at('dla','dlo')}) END AS points FROM pair),
    p AS (SELECT c_custkey, same, generate_subscripts(points, 1) AS i, unnest(points) AS point FROM path),
    kept AS (SELECT *, lag(point) OVER (PARTITION BY c_custkey ORDER BY i) AS before FROM p)
    SELECT c_custkey, same AS one_line, (row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1)::INTEGER AS i, {r('point.lat',5)} AS lat, {r('point.lon',5)} AS lon
    FROM kept WHERE NOT same OR before IS NULL OR before<>point""",
)
def rail_path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the way from each home to one other, on either line and over the interchange."""
    at = homes(spark, sf_dir).select("c_custkey", "c_lat", "c_lon")
    last = at.agg(F.max("c_custkey")).first()[0]
    other = at.select(F.col("c_custkey").alias("d_key"), F.col("c_lat").alias("d_lat"), F.col("c_lon").alias("d_lon"))
    pairs = at.withColumn("d_key", (F.col("c_custkey") * 17 + 5) % last).join(other, "d_key")
    lines = pairs.withColumn("one_line", nearest_station("c_lat", "c_lon")["line"] == nearest_station("d_lat", "d_lon")["line"])
    paths = traffic.rail_paths(lines, ("c_lat", "c_lon"), ("d_lat", "d_lon")).where(F.col("rail_path").isNotNull())
    return paths.select("c_custkey", "one_line", F.posexplode("rail_path").alias("i", "p")).select(
        "c_custkey", "one_line", "i", rnd("p.lat", 5).alias("lat"), rnd("p.lon", 5).alias("lon")
    )
