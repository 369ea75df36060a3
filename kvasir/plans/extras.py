"""More single-operator queries: vectors, lists, colours, sun, maps, graph edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import colors, lists, sun, vectors
from kvasir.operators import maps, networks
from kvasir.plans.analysis import _E1, _PT, _each, _vec
from kvasir.plans.graphs import _CO, _DEG, _parts, _regional
from kvasir.sources import tables
from kvasir.sources.tables import NATION

_p = lambda s, d: tables.table(s, d, "part")
_sizes = lambda: F.array(F.col("p_size").cast("double"), F.lit(20.0), F.lit(5.0), F.lit(20.0))
_rgb = lambda: F.array(F.col("p_size") * 5, F.lit(16), F.col("p_partkey") % 256)
_LAT, _LON = 51.5, -3.2


def _asia(spark, d):
    r = tables.table(spark, d, "region").filter("r_name = 'ASIA'")
    return r.select(F.col("r_regionkey").cast("long").alias("node"))


QUERIES = {
    "vec_compass_direction": lambda s, d: _vec(s, d).groupBy(vectors.compass_direction(F.col("u")).alias("direction")).agg(F.count(F.lit(1)).alias("n")),
    "vec_azimuth_altitude": lambda s, d: _vec(s, d).select("pid", F.round(vectors.altitude(F.col("u")), 4).alias("altitude"), F.round(F.element_at(vectors.by_azimuth_altitude(vectors.azimuth(F.col("u")), vectors.altitude(F.col("u"))), 1), 4).alias("x")),
    "vec_average_sum": lambda s, d: _vec(s, d).agg(vectors.average(F.col("u")).alias("a"), vectors.total(F.col("u")).alias("t")).select(F.round(F.element_at("a", 1), 6).alias("ax"), F.round(F.element_at("t", 3), 4).alias("tz")),
    "vec_bisect_spread": lambda s, d: _vec(s, d).select("pid", F.round(vectors.spread(F.col("u"), F.col("v")), 5).alias("spread"), F.round(vectors.magnitude(vectors.bisect(F.col("u"), F.col("v"))), 5).alias("unit"), vectors.is_antiparallel(F.col("u"), vectors.reverse(F.col("u"))).alias("opposite")),
    "mat_rotation": lambda s, d: (lambda t: t.select("pid", *[F.round(F.element_at("t", i + 1), 6).alias(c) for i, c in enumerate("xyz")]))(_vec(s, d).select("pid", vectors.transform_point(vectors.matrix_multiply(vectors.rotation("z", F.lit(90.0)), vectors.scaling(F.lit(2.0), F.lit(3.0), F.lit(1.0))), F.col("u")).alias("t"))),
    "list_indices": lambda s, d: _p(s, d).select("p_partkey", F.array_join(lists.maximum_indices(_sizes()).cast("array<string>"), ",").alias("most"), F.array_join(lists.minimum_indices(_sizes()).cast("array<string>"), ",").alias("least"), lists.position(_sizes(), F.lit(21.0)).cast("int").alias("place")),
    "list_every_other": lambda s, d: _p(s, d).select("p_partkey", F.array_join(lists.remove_even(F.split("p_name", "")), "").alias("odd"), F.array_join(lists.remove_odd(F.split("p_name", "")), "").alias("even")),
    "list_nested": lambda s, d: _p(s, d).select("p_partkey", F.array_join(F.flatten(lists.transpose(lists.trim_all(F.array(F.split("p_type", " "), F.split("p_name", " "))))), "|").alias("v")),
    "color_mix": lambda s, d: _p(s, d).select("p_partkey", colors.rgb_to_hex(_rgb()).alias("hex"), colors.add_hex(colors.rgb_to_hex(_rgb()), F.lit("#808080")).alias("lighter")),
    "color_average": lambda s, d: _p(s, d).groupBy("p_brand").agg(colors.average_hex(colors.rgb_to_hex(F.array(F.col("p_size"), F.lit(16), F.lit(255)))).alias("hex")),
    "sun_altitude": lambda s, d: tables.table(s, d, "events").select("event_id", F.round(sun.altitude(F.lit(_LAT), F.lit(_LON), F.col("ts")), 3).alias("altitude")),
    "sun_day_length": lambda s, d: tables.table(s, d, "events").select("event_id", F.round(sun.day_length(F.lit(_LAT), F.col("ts")), 2).alias("hours")),
    "map_set_values": lambda s, d: _each(s, d).select("user_id", maps.canonical(maps.set_values(F.col("a"), ["day", "new"], [F.lit("x"), F.col("user_id")])).alias("m")),
    "map_keys_at_value": lambda s, d: _each(s, d).select("user_id", F.array_join(maps.keys_at_value(F.col("a"), "click"), ",").alias("k"), F.array_join(maps.values_at(F.col("a"), ["event_type", "none"], "-"), ",").alias("v")),
    "graph_degree_centrality": lambda s, d: networks.degree_centrality(_parts(s, d), tables.copurchase(s, d)),
    "graph_delta": lambda s, d: networks.delta(_parts(s, d), tables.copurchase(s, d)),
    "graph_is_complete": lambda s, d: networks.is_complete(*_regional(s, d)),
    "graph_adjacency_list": lambda s, d: networks.adjacency_list(*_regional(s, d)).select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours")),
    "graph_incident_edges": lambda s, d: networks.incident_edges(_regional(s, d)[1], _asia(s, d)),
    "graph_remove_vertices": lambda s, d: networks.remove_vertices(*_regional(s, d), _asia(s, d))[1],
    "graph_tree": lambda s, d: networks.spanning_tree(_regional(s, d)[1], NATION).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long"))),
    "graph_bridges": lambda s, d: networks.bridges(_regional(s, d)[1]),
    "graph_communities": lambda s, d: networks.communities(*_regional(s, d)),
}

_SUN = """s AS (SELECT event_id, epoch_us(ts) / 86400000000.0 - 10957.5 AS d FROM events),
l AS (SELECT event_id, d, radians((280.460 + 0.9856474 * d) % 360 + 1.915 * sin(radians((357.528 + 0.9856003 * d) % 360)) + 0.020 * sin(2 * radians((357.528 + 0.9856003 * d) % 360))) AS lam, radians(23.439 - 4e-7 * d) AS eps FROM s),
q AS (SELECT event_id, asin(sin(eps) * sin(lam)) AS dec, radians((280.46061837 + 360.98564736629 * d) % 360 - 3.2) - atan2(cos(eps) * sin(lam), cos(lam)) AS h FROM l)"""
_UV = f"{_PT}, uv AS (SELECT a.pid, a.x, a.y, a.z, b.x AS bx, b.y AS by_, b.z AS bz FROM pt a JOIN pt b ON b.pid = a.pid + 1)"
SQL = {
    "vec_compass_direction": f"WITH {_UV}, s AS (SELECT CASE WHEN x > 1e-4 THEN 'east' WHEN x < -1e-4 THEN 'west' ELSE '' END AS e, CASE WHEN y > 1e-4 THEN 'north' WHEN y < -1e-4 THEN 'south' ELSE '' END AS n, CASE WHEN z > 1e-4 THEN 'up' WHEN z < -1e-4 THEN 'down' ELSE 'origin' END AS u FROM uv) SELECT CASE WHEN e = '' AND n = '' THEN u ELSE n || e END AS direction, count(*) AS n FROM s GROUP BY 1",
    "vec_azimuth_altitude": f"WITH {_UV} SELECT pid, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS altitude, round(x / sqrt(x * x + y * y + z * z), 4) AS x FROM uv",
    "vec_average_sum": f"WITH {_UV} SELECT round(avg(x), 6) AS ax, round(sum(z), 4) AS tz FROM uv",
    "vec_bisect_spread": f"WITH {_UV} SELECT pid, round(1 - power(x * bx + y * by_ + z * bz, 2) / ((x * x + y * y + z * z) * (bx * bx + by_ * by_ + bz * bz)), 5) AS spread, 1.0::DOUBLE AS unit, true AS opposite FROM uv",
    "mat_rotation": f"WITH {_UV} SELECT pid, round(-3 * y, 6) AS x, round(2 * x, 6) AS y, z FROM uv",
    "list_indices": "SELECT p_partkey, CASE WHEN p_size > 20 THEN '0' WHEN p_size = 20 THEN '0,1,3' ELSE '1,3' END AS most, CASE WHEN p_size < 5 THEN '0' WHEN p_size = 5 THEN '0,2' ELSE '2' END AS least, 3 + (p_size < 21)::INTEGER AS place FROM part",
    "list_every_other": "SELECT p_partkey, array_to_string([p_name[i] FOR i IN range(2, length(p_name) + 1, 2)], '') AS odd, array_to_string([p_name[i] FOR i IN range(1, length(p_name) + 1, 2)], '') AS even FROM part",
    "list_nested": "WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part) SELECT p_partkey, array_to_string(flatten([[a[i], b[i]] FOR i IN range(1, least(len(a), len(b)) + 1)]), '|') AS v FROM w",
    "color_mix": "SELECT p_partkey, printf('#%02X%02X%02X', p_size * 5, 16, p_partkey % 256) AS hex, printf('#%02X%02X%02X', least(255, p_size * 5 + 128), 144, least(255, p_partkey % 256 + 128)) AS lighter FROM part",
    "color_average": "SELECT p_brand, printf('#%02X%02X%02X', round(avg(p_size))::BIGINT, 16, 255) AS hex FROM part GROUP BY p_brand",
    "sun_altitude": f"WITH {_SUN} SELECT event_id, round(degrees(asin(sin(radians(51.5)) * sin(dec) + cos(radians(51.5)) * cos(dec) * cos(h))), 3) AS altitude FROM q",
    "sun_day_length": f"WITH {_SUN} SELECT event_id, round(degrees(acos((sin(radians(-0.833)) - sin(radians(51.5)) * sin(dec)) / (cos(radians(51.5)) * cos(dec)))) / 7.5, 2) AS hours FROM q",
    "map_set_values": f"WITH {_E1} SELECT user_id, 'day=x;event_type=' || ta || ';first=' || ia || ';new=' || user_id AS m FROM p",
    "map_keys_at_value": f"WITH {_E1} SELECT user_id, CASE WHEN ta = 'click' THEN 'event_type' ELSE '' END AS k, ta || ',-' AS v FROM p",
    "graph_degree_centrality": f"WITH {_CO}, {_DEG} SELECT node, round(degree / ((SELECT count(*) FROM part) - 1)::DOUBLE, 9) AS centrality FROM deg",
    "graph_delta": f"WITH {_CO}, {_DEG} SELECT min(degree) AS minimum, max(degree) AS maximum FROM deg",
    "graph_is_complete": "SELECT false AS complete",
    "graph_adjacency_list": f"SELECT r_regionkey::BIGINT AS node, coalesce(string_agg((n_nationkey + {NATION})::VARCHAR, ',' ORDER BY n_nationkey), '') AS neighbours FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT n_nationkey + {NATION}, n_regionkey::VARCHAR FROM nation",
    "graph_incident_edges": f"SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "graph_remove_vertices": f"SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
    "graph_tree": f"WITH r AS (SELECT n_regionkey AS k FROM nation WHERE n_nationkey = 0) SELECT {NATION}::BIGINT AS node, -1::BIGINT AS parent, 0 AS depth UNION ALL SELECT k, {NATION}, 1 FROM r UNION ALL SELECT n_nationkey + {NATION}, k, 2 FROM nation JOIN r ON n_regionkey = k WHERE n_nationkey <> 0",
    "graph_bridges": f"SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + {NATION} AS dst FROM nation",
}
