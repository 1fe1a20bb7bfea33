"""The registered queries as DuckDB SQL over the same tables.

Written from the semantics, not generated from the Spark plans. DOUBLE
literals carry an exponent, as a bare decimal point means DECIMAL.
"""

from __future__ import annotations

from dataclasses import asdict

from voltpoint.plans import queries as Q
from voltpoint.schema import PANELS, POINT_COLUMNS, Thresholds

# Fixed value: the file name pattern of the format.
NAME = r".*\w+_(\d+)_\d+_\d+\.dat(\.gz)?"
POINT_LIST = ", ".join(POINT_COLUMNS)

POINTS = """
pts AS (
  SELECT event_id,
         epoch_us(ts) * 1000 AS epoch_ns,
         CAST(33e0 + CAST(event_id % 997 AS DOUBLE) / 1000e0 AS FLOAT) AS lat,
         CAST(-102e0 + CAST(event_id * 7 % 1009 AS DOUBLE) / 1000e0 AS FLOAT) AS lon,
         CAST(value / 10e0 AS FLOAT) AS alt,
         CAST(CAST(user_id % 61 AS DOUBLE) / 10e0 AS FLOAT) AS chi,
         CAST(event_id % 141 - 70 AS FLOAT) AS pdb,
         CAST(bit_count(event_id * 2654435761 % 65536) AS TINYINT) AS number_stations,
         strftime(ts, '%Y-%m-%d') AS file_day
  FROM events
)"""


def _inside(thresholds: Thresholds) -> str:
    t = asdict(thresholds)
    return (
        "number_stations >= {min_stations:.6f}"
        " AND alt >= {min_alt:.6f} AND alt <= {max_alt:.6f}"
        " AND chi >= {min_chi:.6f} AND chi <= {max_chi:.6f}"
        " AND pdb >= {min_power:.6f} AND pdb <= {max_power:.6f}"
    ).format(**t)


SELECTION = f"{POINTS},\nsel AS (SELECT * FROM pts WHERE {_inside(Thresholds())})"

EXTENT = f"""{SELECTION},
ext AS (
  SELECT count(*) AS source_count,
         min(epoch_ns) AS t_min_ns, max(epoch_ns) AS t_max_ns,
         max(epoch_ns) - min(epoch_ns) AS span_ns,
         min(lon) AS lon_min, max(lon) AS lon_max,
         min(lat) AS lat_min, max(lat) AS lat_max,
         min(alt) AS alt_min, max(alt) AS alt_max
  FROM sel
)"""

LINES = """
lines AS (
  SELECT event_id,
         strftime(ts, '%Y-%m-%d') AS file_day,
         CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS day_s,
         CASE
           WHEN event_id % 103 = 0 THEN ''
           WHEN event_id % 101 = 0 THEN '  12.5 33.5'
           ELSE ' ' || CAST((epoch_us(ts) // 1000000) % 86400 AS VARCHAR)
             || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')
             || '  33.' || lpad(CAST(event_id % 997 AS VARCHAR), 3, '0')
             || ' -101.' || lpad(CAST(event_id * 7 % 1009 AS VARCHAR), 4, '0')
             || ' ' || CASE WHEN event_id % 97 = 0 THEN 'bad'
                            ELSE CAST(CAST(round(value * 100e0) AS BIGINT) AS VARCHAR) END
             || ' ' || CAST((user_id % 61) // 10 AS VARCHAR)
             || '.' || CAST((user_id % 61) % 10 AS VARCHAR)
             || ' ' || CAST(event_id % 141 - 70 AS VARCHAR)
             || ' 0x' || lower(printf('%x', event_id * 2654435761 % 65536))
         END AS line
  FROM events
),
tok AS (
  SELECT event_id, file_day, day_s, line, regexp_split_to_array(trim(line), ' +') AS arr FROM lines
)"""

PARSED = f"""{LINES},
parsed AS (
  SELECT event_id, file_day,
         TRY_CAST((TRY_CAST(arr[1] AS DOUBLE) + day_s) * 1e9 AS BIGINT) AS epoch_ns,
         CAST(TRY_CAST(arr[2] AS DOUBLE) AS FLOAT) AS lat,
         CAST(TRY_CAST(arr[3] AS DOUBLE) AS FLOAT) AS lon,
         CAST(TRY_CAST(arr[4] AS DOUBLE) / 1000e0 AS FLOAT) AS alt,
         TRY_CAST(arr[5] AS FLOAT) AS chi,
         TRY_CAST(arr[6] AS FLOAT) AS pdb,
         CAST(bit_count(TRY_CAST(arr[7] AS INTEGER)) AS TINYINT) AS number_stations
  FROM tok
)"""

NAMES = """
names AS (
  SELECT event_id,
         'data/LYLOUT_'
         || CASE WHEN event_id % 7 = 0 THEN '249917' ELSE strftime(ts, '%y%m%d') END
         || CASE
              WHEN event_id % 10 = 3 THEN '_' || CAST(event_id AS VARCHAR) || '_0600.txt'
              WHEN event_id % 10 = 8 THEN '_' || CAST(event_id AS VARCHAR) || '.dat'
              WHEN event_id % 2 = 1 THEN '_' || CAST(event_id AS VARCHAR) || '_0600.dat.gz'
              ELSE '_' || CAST(event_id AS VARCHAR) || '_0600.dat'
            END AS path
  FROM events
)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _cell(value: str, low: str, high: str, cells: int) -> str:
    value, low, high = (f"CAST({v} AS DOUBLE)" for v in (value, low, high))
    place = f"floor(({value} - {low}) / nullif({high} - {low}, 0e0) * {cells})"
    return f"CAST(least({cells - 1}, coalesce({place}, 0e0)) AS INTEGER)"


def _axis_cell(axis: str, cells: int) -> str:
    if axis == "time":
        return _cell("epoch_ns - t_min_ns", "0", "span_ns", cells)
    return _cell(axis, f"{axis}_min", f"{axis}_max", cells)


COLOR = "CAST({ns} - t_min_ns AS DOUBLE) / CAST(nullif(span_ns, 0) AS DOUBLE)"


def _axis(axis: str) -> str:
    return "CAST(epoch_ns - t_min_ns AS FLOAT)" if axis == "time" else axis


def _panel_rows(name: str) -> str:
    x, y = PANELS[name]
    return (
        f"SELECT '{name}' AS panel, {_axis(x)} AS x, {_axis(y)} AS y, "
        f"{COLOR.format(ns='epoch_ns')} AS color FROM sel CROSS JOIN ext"
    )


def _raster_rows(name: str, extra: str = "") -> str:
    x, y = PANELS[name]
    width, height = Q.RASTER["width"], Q.RASTER["height"]
    return (
        f"SELECT '{name}' AS panel, {extra}{_axis_cell(x, width)} AS px, "
        f"{_axis_cell(y, height)} AS py, epoch_ns FROM sel CROSS JOIN ext"
    )


def _raster(rows: str, keys: str) -> str:
    return _with(
        f"{EXTENT},\ncells AS ({rows}),\n"
        f"agg AS (SELECT {keys}, max(epoch_ns) AS last_ns, count(*) AS n FROM cells GROUP BY {keys})",
        f"SELECT {keys}, last_ns, n, {COLOR.format(ns='last_ns')} AS color FROM agg CROSS JOIN ext",
    )


def _ticks(axes: list[tuple[str, str, str, str]], count: int, step: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{panel}' AS panel, '{side}' AS axis, CAST({low} AS FLOAT) AS low, "
        f"CAST({high} AS FLOAT) AS high FROM ext"
        for panel, side, low, high in axes
    )
    return _with(
        f"{EXTENT},\naxes AS ({rows}),\n"
        f"steps AS (SELECT CAST(i AS INTEGER) AS i, "
        f"CAST('0.1' AS FLOAT) + CAST(i AS FLOAT) * CAST('{step}' AS FLOAT) AS fraction "
        f"FROM range({count}) AS r(i)),\n"
        f"ticks AS (SELECT panel, axis, i, fraction, low + fraction * (high - low) AS value "
        f"FROM axes CROSS JOIN steps)",
        "SELECT *, printf('%.6f', CAST(value AS DOUBLE)) AS label FROM ticks",
    )


def _bound(column: str, low: float, high: float | None) -> str:
    upper = "" if high is None else f" AND {column} <= {high:.6f}"
    return _with(
        POINTS, f"SELECT event_id, {column} FROM pts WHERE {column} >= {low:.6f}{upper}"
    )


def _channel(i: int) -> str:
    entries = "[" + ", ".join(f"{rgb[i]:e}" for rgb in Q.PALETTE) + "]"
    last = len(Q.PALETTE) - 1

    def entry(shift: int) -> str:
        return f"{entries}[1 + greatest(0, least({last}, CAST(floor(pos) AS INTEGER) + {shift}))]"

    return f"{entry(0)} + ({entry(1)} - {entry(0)}) * (pos - floor(pos))"


def _far(high: str, low: str) -> str:
    """The difference as DOUBLE, of exact or else of rounded numbers."""
    exact = f"CAST(TRY_CAST(CAST({high} AS HUGEINT) - {low} AS BIGINT) AS DOUBLE)"
    return f"coalesce({exact}, CAST({high} AS DOUBLE) - CAST({low} AS DOUBLE))"


def _flashes(source: str) -> str:
    f = Q.FLASH
    axes = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in "xyz")
    return f"""
p AS (SELECT event_id, epoch_ns AS t, CAST(lon AS DOUBLE) * {f["km_per_lon"]}e0 AS x,
             CAST(lat AS DOUBLE) * {f["km_per_lat"]}e0 AS y, CAST(alt AS DOUBLE) AS z FROM {source}),
links AS (SELECT a.event_id AS one, b.event_id AS other FROM p a
          JOIN p b ON b.t >= a.t - {f["max_gap_ns"]} AND b.t <= a.t + {f["max_gap_ns"]}
          WHERE {axes} <= {f["max_km"] ** 2}e0),
reach AS (SELECT event_id, event_id AS other FROM p
          UNION SELECT reach.event_id, links.other FROM reach JOIN links ON reach.other = links.one),
flashes AS (SELECT event_id, min(other)::BIGINT AS flash_id FROM reach GROUP BY event_id)"""


def _dirty_extent() -> str:
    return f"""{POINTS},
dirty AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 251 = 0 THEN -8300000000000000000 WHEN event_id % 241 = 0 THEN 8300000000000000000
         ELSE epoch_ns END AS epoch_ns,
    CASE WHEN event_id % 239 = 0 THEN CAST(1e30 AS FLOAT) WHEN event_id % 233 = 0 THEN CAST(-1e-7 AS FLOAT)
         ELSE lat END AS lat)
  FROM pts),
sel AS (SELECT * FROM dirty WHERE {_inside(Thresholds())}),
ext AS (
  SELECT count(*) AS source_count, min(epoch_ns) AS t_min_ns, max(epoch_ns) AS t_max_ns,
         CAST(max(epoch_ns) AS HUGEINT) - min(epoch_ns) AS wide,
         min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max,
         min(alt) AS alt_min, max(alt) AS alt_max
  FROM sel)"""


def oracle_sql() -> dict[str, str]:
    t = Thresholds()
    sql: dict[str, str] = {}

    # files
    sql["scan_lylout"] = _with(LINES, "SELECT file_day, line FROM lines")
    sql["scan_lylout_streamed"] = sql["scan_nested"] = sql["scan_lylout"]
    sql["skip_header"] = _with(
        LINES,
        "SELECT file_day, count(*) AS lines, "
        "count(*) FILTER (WHERE contains(line, 'header line')) AS header_lines "
        "FROM lines GROUP BY file_day",
    )
    sql["skip_header_streamed"] = sql["skip_header"]
    sql["file_filter"] = _with(
        NAMES, f"SELECT event_id, path FROM names WHERE regexp_full_match(path, '{NAME}')"
    )
    sql["file_date"] = _with(
        f"{NAMES},\ndigits AS (SELECT event_id, "
        f"CASE WHEN regexp_full_match(path, '{NAME}') THEN regexp_extract(path, '{NAME}', 1) END AS d "
        "FROM names)",
        "SELECT event_id, CAST(epoch(TRY_CAST('20' || substr(d, 1, 2) || '-' || substr(d, 3, 2) "
        "|| '-' || substr(d, 5, 2) AS DATE)) AS BIGINT) AS day_s FROM digits",
    )
    sql["rows_per_day"] = _with(
        PARSED, "SELECT file_day, count(*) AS rows FROM parsed GROUP BY file_day"
    )
    sql["parse_lylout"] = _with(PARSED, f"SELECT file_day, {POINT_LIST} FROM parsed")
    sql["union_days"] = sql["parse_lylout_streamed"] = sql["parse_lylout"]
    sql["clear_table"] = _with(POINTS, "SELECT count(*) AS rows, false AS exists_after FROM pts")
    sql["load_report"] = _with(
        PARSED,
        "SELECT true AS matched, file_day, count(*) AS rows, count(*) - count(epoch_ns) AS null_times, "
        "count(*) - count(alt) AS null_alts, count(*) - count(number_stations) AS null_stations "
        "FROM parsed GROUP BY file_day "
        "UNION ALL SELECT true, '2099-01-01', 0, 0, 0, 0 UNION ALL SELECT false, NULL, 0, 0, 0, 0",
    )
    sql["replace_load"] = _with(
        POINTS, "SELECT count(*) AS rows, min(alt) AS alt_min, max(alt) AS alt_max FROM pts"
    )

    short = "CAST(event_id AS VARCHAR) || ';' || CAST(epoch_us(ts) AS VARCHAR)"
    lat, lon = "lpad(CAST(event_id % 997 AS VARCHAR), 3, '0')", "'-101.' || lpad(CAST(event_id * 7 % 1009 AS VARCHAR), 4, '0')"
    full = (
        f"{short} || ';' || CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '33.' END || {lat} || ';' || {lon} "
        "|| ';' || CAST(event_id % 141 - 70 AS VARCHAR)"
    )
    sql["scan_ctg"] = f"""
SELECT CAST(event_id AS BIGINT) AS event_id, epoch_us(ts) AS us,
       CASE WHEN event_id % 101 <> 0 AND event_id % 97 <> 0 THEN CAST('33.' || {lat} AS DOUBLE) END AS lat,
       CASE WHEN event_id % 101 <> 0 THEN CAST({lon} AS DOUBLE) END AS lon,
       CASE WHEN event_id % 101 <> 0 THEN CAST(event_id % 141 - 70 AS FLOAT) END AS current,
       CASE WHEN event_id % 101 = 0 THEN {short} WHEN event_id % 97 = 0 THEN {full} END AS rejected
FROM events"""
    sql["clear_ctg"] = "SELECT count(*) AS points, count(*) AS strikes, false AS points_after, false AS strikes_after FROM events"
    sql["versioned_load"] = sql["parse_lylout"]
    sql["stored_report"] = sql["load_report"]
    bounds = ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("lon", "lat", "alt"))
    stored = f"SELECT count(*) AS source_count, min(epoch_ns) AS t_min_ns, max(epoch_ns) AS t_max_ns, max(epoch_ns) - min(epoch_ns) AS span_ns, {bounds} FROM parsed"
    sql["stored_extent"] = _with(PARSED, stored)
    sql["stored_extent_days"] = _with(PARSED, stored + " WHERE file_day BETWEEN '{}' AND '{}'".format(*Q.STORED_DAYS))

    # line parsing
    sql["tokenize"] = _with(
        LINES,
        "SELECT event_id, CAST(len(arr) AS BIGINT) AS n_tokens, "
        "array_to_string(arr, '|') AS joined FROM tok",
    )
    sql["array_get"] = _with(
        LINES,
        "SELECT event_id, " + ", ".join(f"arr[{i}] AS token_{i}" for i in (1, 2, 4, 7, 8)) + " FROM tok",
    )
    sql["try_cast_double"] = _with(
        LINES,
        "SELECT event_id, "
        + ", ".join(f"TRY_CAST(arr[{i}] AS DOUBLE) AS double_{i}" for i in (2, 3, 4))
        + " FROM tok",
    )
    sql["try_cast_float"] = _with(
        LINES,
        "SELECT event_id, "
        + ", ".join(f"TRY_CAST(arr[{i}] AS FLOAT) AS float_{i}" for i in (4, 5, 6))
        + " FROM tok",
    )
    sql["try_expr"] = _with(
        LINES, "SELECT event_id, TRY(CAST(arr[4] AS DOUBLE) / 1000e0) AS km FROM tok"
    )
    for name, column in (
        ("alt_km", "alt"),
        ("make_epoch_ns", "epoch_ns"),
        ("station_count", "number_stations"),
    ):
        sql[name] = _with(PARSED, f"SELECT event_id, {column} FROM parsed")
    sql["epoch_ns_of_ts"] = "SELECT event_id, epoch_us(ts) * 1000 AS epoch_ns FROM events"

    # selection
    sql["filter_stations"] = _bound("number_stations", t.min_stations, None)
    sql["filter_alt"] = _bound("alt", t.min_alt, t.max_alt)
    sql["filter_chi"] = _bound("chi", t.min_chi, t.max_chi)
    sql["filter_power"] = _bound("pdb", t.min_power, t.max_power)
    sql["filter_points"] = _with(SELECTION, f"SELECT event_id, {POINT_LIST} FROM sel")
    sql["refilter_strict"] = _with(
        POINTS, f"SELECT event_id, {POINT_LIST} FROM pts WHERE {_inside(Q.STRICT)}"
    )
    wide = "number_stations >= 0 AND alt BETWEEN 0 AND 10000 AND chi BETWEEN 0 AND 10000"
    wide += " AND pdb BETWEEN -10000 AND 10000"
    sql["refilter_clustered"] = sql["refilter_strict"]
    sql["refilter"] = _with(
        POINTS,
        f"SELECT 'default' AS thresholds, count(*) AS n FROM pts WHERE {_inside(t)} "
        f"UNION ALL SELECT 'strict', count(*) FROM pts WHERE {_inside(Q.STRICT)} "
        f"UNION ALL SELECT 'wide', count(*) FROM pts WHERE {wide}",
    )
    sql["refilter_kept"] = sql["refilter"]
    sql["refilter_cube"] = _with(
        POINTS,
        " UNION ALL ".join(f"SELECT '{name}' AS thresholds, count(*) AS n FROM pts WHERE {_inside(s)}" for name, s in Q.CUBE_SETS.items()),
    )
    sql["project_points"] = _with(SELECTION, "SELECT epoch_ns, lon, lat, alt FROM sel")
    sql["range_filter_lineitem"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem WHERE "
        + " AND ".join(f"{c} >= {lo:e} AND {c} <= {hi:e}" for c, (lo, hi) in Q.LINEITEM_BOUNDS.items())
    )

    # extents and views
    sql["extent"] = _with(EXTENT, "SELECT * FROM ext")
    sql["source_count"] = _with(EXTENT, "SELECT source_count FROM ext")
    sql["extent_per_row"] = _with(
        SELECTION,
        "SELECT CAST(epoch_ns - min(epoch_ns) OVER () AS FLOAT) AS t, lon, lat, alt, "
        "min(epoch_ns) OVER () AS t_min_ns, max(epoch_ns) OVER () AS t_max_ns, "
        "min(lon) OVER () AS lon_min, max(lon) OVER () AS lon_max, "
        "min(lat) OVER () AS lat_min, max(lat) OVER () AS lat_max, "
        "min(alt) OVER () AS alt_min, max(alt) OVER () AS alt_max FROM sel",
    )
    sql["panel_extent"] = _with(
        EXTENT,
        "SELECT panel, x_min, x_max, y_min, y_max FROM ("
        f"SELECT 'time_alt' AS panel, CAST(0 AS FLOAT) AS x_min, CAST(span_ns AS FLOAT) AS x_max, "
        f"alt_min AS y_min, alt_max AS y_max FROM ext "
        f"UNION ALL SELECT 'lon_alt', lon_min, lon_max, alt_min, alt_max FROM ext "
        f"UNION ALL SELECT 'lon_lat', lon_min, lon_max, lat_min, lat_max FROM ext "
        f"UNION ALL SELECT 'alt_lat', alt_min, alt_max, lat_min, lat_max FROM ext "
        f"UNION ALL SELECT 'alt_hist', NULL, NULL, alt_min, alt_max FROM ext)",
    )
    sql["extent_lineitem"] = "SELECT count(*) AS row_count, " + ", ".join(
        f"min({c} + 0e0) AS {c}_min, max({c} + 0e0) AS {c}_max"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ) + " FROM lineitem"
    sql["axis_ticks_5"] = _ticks(
        [
            ("time_alt", "x", "0", "span_ns"),
            ("lon_alt", "x", "lon_min", "lon_max"),
            ("lon_lat", "x", "lon_min", "lon_max"),
            ("lon_lat", "y", "lat_min", "lat_max"),
            ("alt_lat", "y", "lat_min", "lat_max"),
        ],
        5,
        "0.2",
    )
    sql["axis_ticks_3"] = _ticks(
        [
            ("time_alt", "y", "alt_min", "alt_max"),
            ("lon_alt", "y", "alt_min", "alt_max"),
            ("alt_hist", "y", "alt_min", "alt_max"),
            ("alt_lat", "x", "alt_min", "alt_max"),
        ],
        3,
        "0.4",
    )
    sql["relative_time"] = _with(
        EXTENT,
        "SELECT event_id, epoch_ns - t_min_ns AS rel_ns, CAST(epoch_ns - t_min_ns AS FLOAT) AS t "
        "FROM sel CROSS JOIN ext",
    )
    sql["normalize_time"] = _with(
        EXTENT, f"SELECT event_id, {COLOR.format(ns='epoch_ns')} AS color FROM sel CROSS JOIN ext"
    )
    for name in PANELS:
        sql[f"panel_{name}"] = _with(
            f"{EXTENT},\nview_rows AS ({_panel_rows(name)})", "SELECT x, y, color FROM view_rows"
        )
        sql[f"raster_{name}"] = _raster(_raster_rows(name), "px, py")
    sql["panels"] = _with(EXTENT, " UNION ALL ".join(_panel_rows(name) for name in PANELS))
    sql["rasters"] = _raster(
        " UNION ALL ".join(_raster_rows(name) for name in PANELS), "panel, px, py"
    )
    sql["raster_frames"] = _raster(
        _raster_rows("lon_lat", f"{_axis_cell('time', Q.FRAMES)} AS frame, "), "frame, px, py"
    )
    alt_bin = _axis_cell("alt", Q.HISTOGRAM_BINS)
    sql["alt_histogram"] = _with(
        f"{EXTENT},\nbins AS (SELECT {alt_bin} AS bin FROM sel CROSS JOIN ext)",
        "SELECT bin, count(*) AS n FROM bins GROUP BY bin",
    )
    px = _cell("l_quantity", "q_min", "q_max", 40)
    py = _cell("l_extendedprice", "p_min", "p_max", 30)
    sql["grid_lineitem"] = (
        "WITH ext AS (SELECT min(l_quantity) AS q_min, max(l_quantity) AS q_max, "
        "min(l_extendedprice) AS p_min, max(l_extendedprice) AS p_max FROM lineitem), "
        f"cells AS (SELECT {px} AS px, {py} AS py, l_orderkey FROM lineitem CROSS JOIN ext) "
        "SELECT px, py, max(l_orderkey) AS last, count(*) AS n FROM cells GROUP BY px, py"
    )
    sql["point_colors"] = _with(
        f"{EXTENT},\ncolored AS (SELECT event_id, {COLOR.format(ns='epoch_ns')} * {len(Q.PALETTE)} "
        "- 0.5e0 AS pos FROM sel CROSS JOIN ext)",
        "SELECT event_id, "
        + ", ".join(f"{_channel(i)} AS {c}" for i, c in enumerate(("red", "green", "blue")))
        + " FROM colored",
    )

    sql["flash_group"] = f"WITH RECURSIVE {POINTS.strip()},{_flashes('pts')} SELECT event_id, flash_id FROM flashes"
    sql["flash_summary"] = (
        f"WITH RECURSIVE {SELECTION.strip()},{_flashes('sel')} SELECT flash_id, count(*) AS sources, "
        "min(epoch_ns) AS t_min_ns, max(epoch_ns) AS t_max_ns FROM flashes JOIN sel USING (event_id) GROUP BY flash_id"
    )

    # dirty values and windows
    dirty = _dirty_extent()
    sql["dirty_extent"] = _with(
        dirty,
        "SELECT source_count, t_min_ns, t_max_ns, TRY_CAST(wide AS BIGINT) AS span_ns, lon_min, lon_max, "
        "lat_min, lat_max, alt_min, alt_max FROM ext",
    )
    sql["dirty_relative_time"] = _with(
        dirty,
        "SELECT event_id, TRY_CAST(CAST(epoch_ns AS HUGEINT) - t_min_ns AS BIGINT) AS rel_ns, "
        f"CAST({_far('epoch_ns', 't_min_ns')} AS FLOAT) AS t FROM sel CROSS JOIN ext",
    )
    ticks = sql["axis_ticks_5"]
    ticks = f"WITH {dirty.strip()},\n" + ticks[ticks.index("axes AS (") :]
    ticks = ticks.replace("CAST(span_ns AS FLOAT)", f"CAST({_far('t_max_ns', 't_min_ns')} AS FLOAT)")
    sql["dirty_ticks"] = ticks.replace(
        "SELECT *, printf", "SELECT *, CASE WHEN abs(value) < 1e15 THEN printf"
    ).replace(" AS label FROM ticks", " END AS label FROM ticks")
    color = f"{_far('epoch_ns', 't_min_ns')} / nullif({_far('t_max_ns', 't_min_ns')}, 0e0)"
    t_axis = {"time": f"CAST({_far('epoch_ns', 't_min_ns')} AS FLOAT)"}
    sql["dirty_panels"] = _with(
        dirty,
        " UNION ALL ".join(
            f"SELECT '{n}' AS panel, {t_axis.get(x, x)} AS x, {t_axis.get(y, y)} AS y, {color} AS color "
            "FROM sel CROSS JOIN ext"
            for n, (x, y) in PANELS.items()
        ),
    )

    def dirty_cell(axis: str, cells: int) -> str:
        if axis == "time":
            return _cell(_far("epoch_ns", "t_min_ns"), "0", _far("t_max_ns", "t_min_ns"), cells)
        return _axis_cell(axis, cells)

    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS panel, {dirty_cell(x, Q.RASTER['width'])} AS px, "
        f"{dirty_cell(y, Q.RASTER['height'])} AS py, epoch_ns FROM sel CROSS JOIN ext"
        for n, (x, y) in PANELS.items()
    )
    sql["dirty_rasters"] = _with(
        f"{dirty},\ncells AS ({rows}),\nagg AS (SELECT panel, px, py, max(epoch_ns) AS last_ns, count(*) AS n "
        "FROM cells GROUP BY panel, px, py)",
        f"SELECT panel, px, py, last_ns, n, {color.replace('epoch_ns', 'last_ns')} AS color FROM agg CROSS JOIN ext",
    )
    sql["dirty_parquet"] = _with(dirty, f"SELECT {POINT_LIST} FROM sel")
    w = Q.WINDOW
    inside = f"lon BETWEEN {w['lon_min']}e0 AND {w['lon_max']}e0 AND lat BETWEEN {w['lat_min']}e0 AND {w['lat_max']}e0"
    px = _cell("lon", f"{w['lon_min']}e0", f"{w['lon_max']}e0", Q.RASTER["width"])
    py = _cell("lat", f"{w['lat_min']}e0", f"{w['lat_max']}e0", Q.RASTER["height"])
    sql["raster_window"] = _raster(f"SELECT {px} AS px, {py} AS py, epoch_ns FROM sel WHERE {inside}", "px, py")

    # export
    sql["parquet_round_trip"] = _with(SELECTION, f"SELECT file_day, {POINT_LIST} FROM sel")
    sql["dat_round_trip"] = _with(
        SELECTION,
        "SELECT epoch_ns // 1000 AS epoch_us, lat, lon, alt, chi, pdb, number_stations FROM sel",
    )
    return sql
