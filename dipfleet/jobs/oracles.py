"""SQL for an independent engine, one statement for each query that SQL can express."""

from __future__ import annotations

from dipfleet.jobs.adaptors import DETECTIONS_SQL, FRAMES_SQL, SENSOR_SQL

SENSOR = f"sensor as ({SENSOR_SQL})"
FRAMES = f"frames as ({FRAMES_SQL})"
BOXES = f"boxes as (select * from ({DETECTIONS_SQL}) d where class_id in (0, 1, 2) and confidence > 0.5)"

#: Runs below 220 with lead-in and end, merged where the gap is under 300 ms, kept from 200 ms on.
DIPS = (
    SENSOR
    + """,
pos as (select *, row_number() over w - 1 as i, coalesce(distance < 220, false) as below,
               lag(row_number) over w as pi, lead(row_number) over w as ni, lag(time_ms) over w as pt, lead(time_ms) over w as nt
        from (select *, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as row_number from sensor) s
        window w as (partition by sensor_id order by time_ms, seq)),
runs as (select *, sum(case when below and not coalesce(pb, false) then 1 else 0 end) over (partition by sensor_id order by i) as rid
         from (select *, lag(below) over (partition by sensor_id order by i) as pb from pos) p),
raw as (select sensor_id, rid::bigint as dip_id, min(coalesce(pi, i))::bigint as start_idx, max(coalesce(ni, i))::bigint as end_idx,
               min(coalesce(pt, time_ms)) as start_ms, max(coalesce(nt, time_ms)) as end_ms
        from runs where below group by sensor_id, rid),
merged as (
  select sensor_id, did::bigint as dip_id, min(start_idx) as start_idx, max(end_idx) as end_idx, min(start_ms) as start_ms, max(end_ms) as end_ms
  from (select *, sum(new) over (partition by sensor_id order by dip_id) as did
        from (select *, case when start_ms - lag(end_ms) over (partition by sensor_id order by dip_id) < 300 then 0 else 1 end as new from raw) a) b
  group by sensor_id, did),
kept as (select * from merged where end_ms - start_ms >= 200)"""
)


def slices(samples: str = "pos") -> str:
    return f"slices as (select s.*, k.dip_id from {samples} s join kept k on s.sensor_id = k.sensor_id and s.i between k.start_idx and k.end_idx)"


#: One row of features per dip, from `slices`.
FEATURES = """
steps as (select *, abs(distance - lag(distance) over d) as step, row_number() over d - 1 as k,
                 count(*) over (partition by sensor_id, dip_id) as n, avg(distance) over (partition by sensor_id, dip_id) as m,
                 first_value(distance) over (partition by sensor_id, dip_id order by i) as d0,
                 first_value(distance) over (partition by sensor_id, dip_id order by i desc) as d1
          from slices window d as (partition by sensor_id, dip_id order by i)),
base as (
  select sensor_id, dip_id, count(*) as frame_count, min(i)::bigint as start_frame_idx, max(i)::bigint as end_frame_idx,
         min(time_ms) / 1000.0::double as time_of_dip_seconds, (max(time_ms) - min(time_ms)) / 1000.0::double as dip_duration_seconds,
         max(distance) as max_depth, min(distance) as min_depth, avg(distance) as avg_depth, var_pop(distance) as depth_variance,
         avg(pow(distance - m, 4)) as depth_fourth_moment, coalesce(avg(step), 0) as avg_depth_gradient, coalesce(max(step), 0) as max_depth_gradient,
         case when count(*) >= 2 then (sum(distance) - (min(d0) + min(d1)) / 2) / (count(*) - 1) else 0 end as line_integral,
         var_pop(case when k >= floor(n * 0.25) and k < floor(n * 0.75) then distance end) as plateau
  from steps group by sensor_id, dip_id),
high as (select *, case when frame_count >= 3 then max_depth - min_depth else 0 end as dip_height from base),
filled as (
  select *, case when frame_count >= 3 and dip_height > 0 then (max_depth - line_integral) / dip_height else 0 end as fill_factor,
         case when frame_count >= 3 and dip_height > 0 then coalesce(plateau, 0) else 0 end as plateau_variance from high),
dips as (
  select *, case when frame_count < 3 then 'Undefined' when dip_height <= 0 then 'Noise'
                 when fill_factor > 0.65 and plateau_variance < 0.05 then 'Boxy_Flat (Likely Vehicle)' when fill_factor > 0.65 then 'Boxy_Irregular'
                 when plateau_variance < 0.05 then 'Peaked_Flat' else 'Peaked_Irregular (Likely Pedestrian/Bike)' end as shape_category from filled)"""


def neighbours(asked: str, known: str) -> str:
    """For each asked time the last known time up to it and the first from it on, by correlated aggregates."""
    return f"""select a.*, max(case when k.t <= a.tm then k.t end) as t0, min(case when k.t >= a.tm then k.t end) as t1, max(k.t) as t_max
    from {asked} a left join {known} k on a.sensor_id = k.sensor_id group by all"""


COUNTED = (
    FRAMES
    + """,
known as (select sensor_id, time_seconds as t from frames),
asked as (select sensor_id, seq, time_ms, distance, time_ms / 1000.0::double - 0.1::double as tm from sensor),
around as ("""
    + neighbours("asked", "known")
    + """),
counted as (
  select a.sensor_id, a.seq, a.time_ms, a.distance, """
    + ", ".join(f"case when t0 is null or t1 is null then 0 when t0 = tm then p.{c} else (q.{c} - p.{c}) / (t1 - t0) * (tm - t0) + p.{c} end::double as {c}" for c in ("vehicles_in_frame", "people_in_frame", "bicycles_in_frame"))
    + """
  from around a left join frames p on p.sensor_id = a.sensor_id and p.time_seconds = t0 left join frames q on q.sensor_id = a.sensor_id and q.time_seconds = t1)"""
)

OBJECTS = (
    "counted_pos as (select *, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as i from counted), "
    + slices("counted_pos")
    + ","
    + FEATURES
    + """,
labels_ as (
  select sensor_id, dip_id, case when max(vehicles_in_frame) > 0 then 'V' when max(bicycles_in_frame) > 0 then 'B' when max(people_in_frame) > 0 then 'P' else 'N' end as object,
         avg(vehicles_in_frame) as avg_vehicles, avg(bicycles_in_frame) as avg_bicycles, avg(people_in_frame) as avg_people
  from slices group by sensor_id, dip_id),
labelled as (select *, (object = 'V')::int as is_vehicle from dips join labels_ using (sensor_id, dip_id))"""
)
LABELLED = f"with {DIPS}, {COUNTED}, {OBJECTS}"


def events(line: str, gap: int, least: int, closed_only: bool, samples: str = "sensor") -> str:
    """Rows of events with shared boundary rows, and one row of statistics per event (`stats`)."""
    shut = "i <= shut" if closed_only else "(shut is null or i <= shut)"
    return f"""
e0 as (select *, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as i, coalesce(distance < {line}, false) as below from {samples}),
e1 as (select *, lag(i) over w as pi, lag(time_ms) over w as pt, lag(distance) over w as pd,
              max(case when below then i end) over (partition by sensor_id order by i rows between unbounded preceding and 1 preceding) as lbi,
              max(case when below then time_ms end) over (partition by sensor_id order by i rows between unbounded preceding and 1 preceding) as lb
       from e0 window w as (partition by sensor_id order by i)),
e2 as (select *, (below and (lb is null or (pi - lbi >= {least} and pt - lb > {gap}))) as st,
              (not below and lb is not null and i - lbi >= {least} and time_ms - lb > {gap}) as cl from e1),
e3 as (select *, sum(st::int) over (partition by sensor_id order by i) as event_id from e2),
e4 as (select *, min(case when cl then i end) over (partition by sensor_id, event_id) as shut from e3 where event_id > 0),
e5 as (select sensor_id, event_id, i, time_ms, distance from e4 where {shut}
       union all select sensor_id, event_id, pi, pt, pd from e4 where {shut} and st and pi is not null),
stats as (
  select sensor_id, event_id::bigint as event_id, min(i)::bigint as start_idx, max(i)::bigint as end_idx, min(time_ms) as time_ms, count(*) as samples,
         (max(time_ms) - min(time_ms)) / 1000.0::double as duration, min(distance) as min_depth, round(coalesce(var_pop(distance), 0), 6) as variance, round(coalesce(avg(step), 0), 6) as avg_gradient
  from (select *, abs(distance - lag(distance) over (partition by sensor_id, event_id order by i)) as step from e5) x group by sensor_id, event_id)"""


BATCH = f"with {SENSOR}, {events('215', 300, 1, False)}"
GATED = BATCH + ", gated as (select * from stats where duration between 0.5 and 10 and min_depth < 195)"
TYPED = GATED + ", typed as (select *, case when variance < 4800 and avg_gradient < 35 then 'Vehicle' else 'Person/Bike' end as type from gated)"

MODE = """
binned as (select sensor_id, cast(trunc(distance + 0.5) as bigint) as bin from (select *, min(time_ms) over (partition by sensor_id) as t0 from sensor) s where time_ms - t0 < 3000),
modes as (select sensor_id, coalesce(arg_max(bin, n * 10000 - bin), 0)::double as baseline from (select sensor_id, bin, least(count(*), 65535) as n from binned where bin between 0 and 4999 group by all) b group by sensor_id)"""
LIVE = (
    f"with {SENSOR}, {MODE}, "
    + """
on_ as (select *, lag(time_ms - t0 >= 3000) over (partition by sensor_id order by time_ms, seq) and time_ms - t0 >= 3000 as live
        from (select *, min(time_ms) over (partition by sensor_id) as t0 from sensor) s),
armed as (select o.*, baseline, case when coalesce(live, false) then baseline - 10 else '-infinity'::double end as line from on_ o join modes using (sensor_id)), """
    + events("line", 200, 2, True, "armed")
    + """
select sensor_id, time_ms, samples, duration, min_depth, variance, avg_gradient, baseline,
       case when variance < 4800 and avg_gradient < 35 then 'Vehicle' else 'Person/Bike' end as type
from stats join modes using (sensor_id) where duration between 0.5 and 10 and min_depth < baseline - 30"""
)


def compact(capacity: int, line: str, skip: int) -> str:
    return f"""with {SENSOR},
c0 as (select *, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as i from sensor),
c1 as (select c0.*, {line} as line from c0 left join (select sensor_id, avg(distance) as base from c0 where i < 10 group by sensor_id) b using (sensor_id)),
c2 as (select *, coalesce(distance < line, false) as below, lead(time_ms) over (partition by sensor_id order by i) as nt from c1 where i >= {skip}),
c3 as (select *, i - row_number() over (partition by sensor_id, below order by i) as isle from c2),
c4 as (select *, row_number() over (partition by sensor_id, isle order by i) - 1 as rn, count(*) over (partition by sensor_id, isle) as len,
              last_value(nt) over (partition by sensor_id, isle order by i rows between unbounded preceding and unbounded following) as ct from c3 where below),
c5 as (select sensor_id, isle, min(time_ms) as time_ms, max(ct) as close_ms, count(*) as samples, var_pop(distance) as variance
       from c4 where rn >= len - len % {capacity + 1} and ct is not null group by sensor_id, isle)
select sensor_id, time_ms, close_ms, samples, close_ms - time_ms as duration_ms, round(variance, 6) as variance, case when variance <= 3070 then 'VEHICLE' else 'OTHER' end as type
from c5 where close_ms - time_ms >= 200"""


LASTS = "lasts as (select sensor_id, max(time_ms) / 1000.0::double as last_seconds from sensor group by sensor_id)"
TIMES = "times as (select sensor_id, time_seconds from frames where vehicles_in_frame > 0)"
STARTS = "starts as (select s.sensor_id, min(s.seq) as start_seq, min(s.time_ms) as start_ms from sensor s join sensor a on a.sensor_id = s.sensor_id and a.seq = 5 and a.time_ms = s.time_ms group by s.sensor_id)"
CLASS_COUNTS = """counts as (
  select video_id, frame_number, count(*) filter (class_id = 0) as people_in_frame, count(*) filter (class_id = 1) as bicycles_in_frame,
         count(*) filter (class_id = 2) as vehicles_in_frame, count(*) as total_in_frame from boxes group by video_id, frame_number)"""
TIMELINE = """timeline as (
  select f.video_id, f.frame_number, coalesce(people_in_frame, 0) as people_in_frame, coalesce(bicycles_in_frame, 0) as bicycles_in_frame,
         coalesce(vehicles_in_frame, 0) as vehicles_in_frame, coalesce(total_in_frame, 0) as total_in_frame, f.frame_number / 4.0::double as time_seconds
  from (select video_id, unnest(generate_series(0, max(frame_number))) as frame_number from counts group by video_id) f left join counts c using (video_id, frame_number))"""
CUMULATIVE = """fresh as (select *, row_number() over (partition by video_id, lane order by frame_number, det_idx) = 1 as is_new from boxes),
per as (select video_id, frame_number, count(*) filter (is_new and class_id = 0) as p, count(*) filter (is_new and class_id = 1) as b, count(*) filter (is_new and class_id = 2) as v,
               count(*) filter (is_new) as newly_counted_this_frame from fresh group by video_id, frame_number),
cumulative as (
  select video_id, frame_number, newly_counted_this_frame, (sum(p) over w)::bigint as total_people_counted, (sum(b) over w)::bigint as total_bicycles_counted,
         (sum(v) over w)::bigint as total_vehicles_counted, (sum(newly_counted_this_frame) over w)::bigint as total_objects_counted
  from per window w as (partition by video_id order by frame_number))"""
#: The tracker one detection of every video at a time: tracks are a list of structs, in the order of their ids.
TRACKED = """walked as (select *, row_number() over (partition by video_id order by frame_number, det_idx) as k from boxes),
walk(video_id, k, tracks, next_id, frame_number, det_idx, class_id, x1, y1, x2, y2, object_id, is_new) as (
  select distinct video_id, 0::bigint, []::struct(id bigint, first bigint, last bigint, n bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, rn bigint, rs double, s bigint, ss hugeint, counted boolean)[],
         1::bigint, null::bigint, null::bigint, null::int, null::bigint, null::bigint, null::bigint, null::bigint, null::bigint, null::boolean from boxes
  union all
  select video_id, k, case when hit then list_transform(alive, lambda t, j: case when j = place then this else t end) else list_append(alive, this) end,
         next_id + (not hit)::bigint, frame_number, det_idx, class_id, x1, y1, x2, y2, this.id, this.counted and not coalesce(was, false)
  from (
    select *, {id: own.id, first: own.first, last: own.last, n: own.n, x1: own.x1, y1: own.y1, x2: own.x2, y2: own.y2, rn: own.rn, rs: own.rs, s: own.s, ss: own.ss,
               counted: coalesce(was, false) or case
                 when class_id = 0 then (frame_number - own.first) / 4.0::double >= 0.5
                 when class_id <> 2 then (frame_number - own.first) / 4.0::double > 0.5
                 else (frame_number - own.first) / 4.0::double >= 1 and own.rn > 0 and own.rs / own.rn between 0.3 and 3
                      and (own.n <= 2 or own.s <= 0 or sqrt((own.n * own.ss - own.s::hugeint * own.s)::double) / own.s <= 0.15) end} as this
    from (
      select *, {id: case when hit then old.id else next_id end, first: case when hit then old.first else frame_number end, last: frame_number, n: coalesce(old.n, 0) + 1, x1: x1, y1: y1, x2: x2, y2: y2,
                 rn: coalesce(old.rn, 0) + (y2 > y1)::bigint, rs: coalesce(old.rs, 0.0) + case when y2 > y1 then (x2 - x1)::double / (y2 - y1) else 0 end,
                 s: coalesce(old.s, 0) + area, ss: coalesce(old.ss, 0) + area::hugeint * area} as own, old.counted as was
      from (
        select *, coalesce(list_max(likes), 0) > 0.6 as hit, list_position(likes, list_max(likes)) as place,
               case when coalesce(list_max(likes), 0) > 0.6 then alive[list_position(likes, list_max(likes))] end as old
        from (
          select *, list_transform(alive, lambda t: 0.4::double * (case when greatest((t.x2 - t.x1) * (t.y2 - t.y1), area) > 0
                       then least((t.x2 - t.x1) * (t.y2 - t.y1), area)::double / greatest((t.x2 - t.x1) * (t.y2 - t.y1), area) else 0 end)
                     + 0.6::double * (case when (t.x2 - t.x1) * (t.y2 - t.y1) + area > 0 then greatest(0.0::double, 1 - sqrt(pow((t.x1 + t.x2 - x1 - x2) / 2.0::double, 2) + pow((t.y1 + t.y2 - y1 - y2) / 2.0::double, 2))
                       / sqrt(((t.x2 - t.x1) * (t.y2 - t.y1) + area) / 2.0::double) / 2) else 0 end)) as likes
          from (select o.*, list_filter(w.tracks, lambda t: o.frame_number - t.last <= 8) as alive, w.next_id, (o.x2 - o.x1) * (o.y2 - o.y1) as area
                from walk w join walked o on o.video_id = w.video_id and o.k = w.k + 1) a) b) c) d) e)"""
TRACKS = f"with recursive {BOXES}, {TRACKED} select video_id, frame_number, det_idx, class_id, x1, y1, x2, y2, object_id, is_new from walk where k > 0"
METRICS = """metrics as (
  select video_id, lane, count(*) as boxes, (max(frame_number) - min(frame_number)) / 4.0::double as duration_seconds,
         avg(case when y2 - y1 > 0 then (x2 - x1)::double / (y2 - y1) end) as mean_aspect,
         case when avg((x2 - x1) * (y2 - y1)) > 0 then stddev_pop((x2 - x1) * (y2 - y1)) / avg((x2 - x1) * (y2 - y1)) else 0 end as area_cv
  from boxes group by video_id, lane),
ruled as (
  select video_id, lane, boxes, duration_seconds, round(mean_aspect, 6) as mean_aspect, round(area_cv, 6) as area_cv,
         coalesce(duration_seconds >= 1 and mean_aspect between 0.3 and 3 and (boxes <= 2 or area_cv <= 0.15), false) as valid_vehicle,
         duration_seconds >= 0.5 as valid_person, duration_seconds > 0.5 as valid_other from metrics)"""
TABLE = """seen as (
  select video_id, frame_number, string_agg((['person', 'bicycle', 'car'])[class_id + 1] || ' ' || round(confidence * 1e6)::bigint::varchar || ' ' || concat_ws(',', x1, y1, x2, y2), ';' order by det_idx) as detected_objects from boxes group by video_id, frame_number),
table_ as (
  select t.video_id, t.time_seconds, t.frame_number, people_in_frame, bicycles_in_frame, vehicles_in_frame, total_in_frame,
         coalesce(max(total_people_counted) over w, 0) as total_people_counted, coalesce(max(total_bicycles_counted) over w, 0) as total_bicycles_counted,
         coalesce(max(total_vehicles_counted) over w, 0) as total_vehicles_counted, coalesce(max(total_objects_counted) over w, 0) as total_objects_counted,
         coalesce(newly_counted_this_frame, 0) as newly_counted_this_frame, coalesce(detected_objects, '') as detected_objects, total_in_frame as total_detections
  from timeline t left join cumulative using (video_id, frame_number) left join seen using (video_id, frame_number)
  window w as (partition by t.video_id order by t.frame_number))"""
_NINE = ("dip_duration_seconds", "min_depth", "avg_depth", "line_integral", "avg_depth_gradient", "depth_variance", "dip_height", "fill_factor", "plateau_variance")
_ROUND = lambda names: ", ".join(f"round({c}, 6) as {c}" for c in names)
PLAIN = f"with {DIPS}, {slices()}, {FEATURES}"
_VISIBLE = ", ".join(
    f"count(*) filter ({c}_in_frame > 0) as {c}_frames, round(count(*) filter ({c}_in_frame > 0) * 100.0::double / count(*), 6) as {c}_percent, round(avg({c}_in_frame), 6) as {c}_mean, max({c}_in_frame) as {c}_most" for c in ("people", "bicycles", "vehicles", "total")
)

#: Dips with their split by id, as in `stratified_split`, and their features, to six digits, as a list.
SPLIT = f"""{LABELLED},
flat_ as materialized (select sensor_id, dip_id, is_vehicle, {_ROUND(_NINE)} from labelled),
sizes as (select is_vehicle, count(*) as n, sum(count(*)) over () as n_all, floor(count(*) * 0.3::double) as quota from flat_ group by is_vehicle),
quotas as (select *, quota + case when row_number() over (order by n * 0.3::double - quota desc, is_vehicle) <= ceil(n_all * 0.3::double) - sum(quota) over () then 1 else 0 end as q from sizes),
split as materialized (
  select sensor_id, dip_id, is_vehicle, [{', '.join(_NINE)}] as f, n_all < 20 or r > q as in_train, n_all < 20 or r <= q as in_test, ((r) % 5)::int as fold from (
    select *, row_number() over (partition by is_vehicle order by sensor_id, dip_id) as r from flat_) l join quotas using (is_vehicle))"""
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def _drawn(digest: str) -> str:
    return " + ".join(f"((('0x' || substr(md5({digest}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 >= {p}::double)::int" for p in _POISSON)


def _gini(n: str, k: str) -> str:
    return f"2.0::double * (({k})::double / ({n})) * (1.0::double - ({k})::double / ({n}))"


def grown(depth: int, least: int, tried: int) -> str:
    """Trees level by level over `r0` (model, weight w, y, f, node 1): their nodes are `nodes`."""
    ctes = []
    for d in range(depth + 1):
        ctes.append(f"n{d} as materialized (select model, node, sum(w)::bigint as n, sum(w * y)::bigint as k from r{d} group by model, node)")
        if d == depth:
            ctes.append(f"b{d} as (select model, node, 0 as j, 0.0::double as threshold, 0.0::double as gain from n{d} where false)")
            break
        ctes.append(f"""s{d} as materialized (
  select model, node, n, k, j from (
    select *, row_number() over (partition by model, node order by md5('42:' || model || ':' || node || ':' || j), j) as place from n{d}, (select unnest(range(9))::int as j) u where k between 1 and n - 1 and n >= {2 * least}) x
  where place <= {tried})""")
        ctes.append(f"""c{d} as (
  select *, sum(w) over o as l, sum(w1) over o as l1, lead(v) over o as u from (
    select model, node, j, n, k, f[j + 1] as v, sum(w)::bigint as w, sum(w * y)::bigint as w1 from r{d} join s{d} using (model, node) group by all) x
  window o as (partition by model, node, j order by v))""")
        gain = f"round({_gini('n', 'k')} - l::double / n * ({_gini('l', 'l1')}) - (n - l)::double / n * ({_gini('n - l', 'k - l1')}), 12)"
        ctes.append(f"""b{d} as materialized (
  select model, node, j, threshold, gain from (
    select model, node, j, (v + u) / 2 as threshold, gain, row_number() over (partition by model, node order by gain desc, j, v) as place
    from (select *, {gain} as gain from c{d} where u is not null and l >= {least} and n - l >= {least}) x) y where place = 1 and gain > 0)""")
        ctes.append(f"r{d + 1} as materialized (select r.model, r.w, r.y, r.f, r.node * 2 + (r.f[b.j + 1] > b.threshold)::int as node from r{d} r join b{d} b using (model, node))")
    nodes = " union all ".join(f"select model, node, j, threshold, n, k, gain from n{d} left join b{d} using (model, node)" for d in range(depth + 1))
    return ", ".join(ctes) + f", nodes as materialized ({nodes})"


def walked(rows: str, depth: int) -> str:
    """`rows` (with model, node 1 and f) in their leaves: `leaf` has the share of class 1."""
    steps = [f"w0 as ({rows})"]
    steps += [f"w{d + 1} as (select w.* exclude (node), case when t.j is null then w.node else w.node * 2 + (w.f[t.j + 1] > t.threshold)::int end as node from w{d} w join nodes t using (model, node))" for d in range(depth)]
    return ", ".join(steps) + f", leaf as (select w.*, t.k::double / t.n as share from w{depth} w join nodes t using (model, node))"


_TREE = f"""{SPLIT}, r0 as materialized (select 0 as model, 1 as w, is_vehicle as y, f, 1 as node from split where in_train), {grown(3, 5, 9)}"""
_FOREST = f"""{SPLIT}, r0 as materialized (
  select * from (select model, {_drawn("'42:' || model || ':' || sensor_id || ':' || dip_id")} as w, is_vehicle as y, f, 1 as node from split, (select unnest(range(50))::int as model) m where in_train) x where w > 0), {grown(5, 3, 3)}"""
_FOLDS = f"""{SPLIT}, r0 as materialized (
  select * from (select g * 10 + tree as model, {_drawn("'42:' || tree || ':' || sensor_id || ':' || dip_id || ':' || g")} as w, is_vehicle as y, f, 1 as node
                 from split, (select unnest(range(5))::int as g) a, (select unnest(range(10))::int as tree) b where g <> fold) x where w > 0), {grown(5, 3, 3)}"""
_SCORED = _FOREST + ", " + walked("select sensor_id, dip_id, is_vehicle, in_test, f, model, 1 as node from split, (select distinct model from nodes) m", 5) + """,
probs as (select sensor_id, dip_id, is_vehicle, in_test, sum(share) / 50.0::double as p from leaf group by all)"""
REPORT = f"""
per as (select case k when 1 then 'Vehicle' else 'Non-Vehicle' end as class, (count(*) filter (y = k and p = k))::double as tp, (count(*) filter (p = k))::double as pp, (count(*) filter (y = k))::double as support, count(*)::double as n
        from scored, (values (0), (1)) v(k) group by k),
rated as (select *, case when pp > 0 then tp / pp else 0 end as precision, case when support > 0 then tp / support else 0 end as recall from per),
full_ as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rated),
rows_ as (
  select class, precision, recall, f1, support from full_
  union all select 'accuracy', sum(tp) / min(n), sum(tp) / min(n), sum(tp) / min(n), sum(support) from full_
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from full_
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from full_)
select class, {_ROUND(('precision', 'recall', 'f1', 'support'))} from rows_"""

SESSIONS = """below_ as (select *, row_number() over (partition by sensor_id order by time_ms, seq) as k from sensor where distance < 220),
breaks as (select *, sum(case when gap is null or gap > 300 then 1 else 0 end) over (partition by sensor_id order by k) as session
           from (select *, time_ms - lag(time_ms) over (partition by sensor_id order by k) as gap from below_) x)"""
LINES = """lines_ as (
  select sensor_id, time_ms, seq, u.place, case u.place when 0 then time_ms || ',' || distance when 1 then 'restarted' when 2 then '' else '12' end as line
  from sensor, (values (0), (1), (2), (3)) u(place) where u.place = 0 or seq % 10 = 3),
placed_ as (select *, coalesce(sum(length(line) + 1) over (partition by sensor_id order by time_ms, seq, place rows between unbounded preceding and 1 preceding), 0)::bigint as start from lines_)"""

ORACLES: dict[str, str] = {
    "bad_log_lines": f"""with {SENSOR}, {LINES} select sensor_id::varchar as sensor_id, start as "at", line, 'not a time and a distance' as reason from placed_ where place in (1, 3)""",
    "device_log_live": compact(500, "case when true then base - 15 end", 10),
    "bucketed_features": f"{PLAIN} select sensor_id, dip_id, {_ROUND(('dip_height', 'fill_factor', 'plateau_variance'))}, shape_category from dips",
    "merged_tables_roundtrip": f"""with {SENSOR}, {COUNTED} select sensor_id::varchar as sensor_id, seq, time_ms / 1000.0::double as time, distance as depth, round(vehicles_in_frame, 6) as vehicles,
round(people_in_frame, 6) as people, round(bicycles_in_frame, 6) as bicycles from counted""",
    "session_events": f"with {SENSOR}, {SESSIONS} select sensor_id, min(time_ms) as start_ms, max(time_ms) as last_ms, count(*) as samples, min(distance) as min_depth, round(var_pop(distance), 6) as variance from breaks group by sensor_id, session",
    "session_differences": f"""with {DIPS}, {SESSIONS},
a as (select sensor_id, count(*) as dips from merged group by sensor_id), b as (select sensor_id, count(distinct session) as sessions from breaks group by sensor_id)
select dips, sessions, count(*) as sensors from a join b using (sensor_id) group by dips, sessions""",
    "scored_dips_roundtrip": f"""{_SCORED} select sensor_id, dip_id, is_vehicle, round(p, 6) as ml_vehicle_prob, (p > 0.5)::int as ml_prediction, case when p > 0.5 then 'Vehicle' else 'Non-Vehicle' end as ml_prediction_label from probs""",
    "tree_nodes": f"{_TREE} select node::bigint as node, [{', '.join(repr(c) for c in _NINE)}][j + 1] as feature, round(threshold, 6) as threshold, n::double as n, k::double as n_1, round(gain, 6) as gain from nodes",
    "forest_scores": f"""{_SCORED} select sensor_id, dip_id, is_vehicle, in_test, round(p, 6) as ml_vehicle_prob, (p > 0.5)::int as ml_prediction, case when p > 0.5 then 'Vehicle' else 'Non-Vehicle' end as ml_prediction_label from probs""",
    "forest_report": f"{_SCORED}, scored as (select is_vehicle as y, (p > 0.5)::int as p from probs where in_test), {REPORT}",
    "forest_importance": f"""{_FOREST},
shares as (select model, j, sum(n * gain) / sum(sum(n * gain)) over (partition by model) as g from nodes where j is not null group by model, j)
select [{', '.join(repr(c) for c in _NINE)}][u.j + 1] as feature, round(coalesce(sum(g) / (select count(distinct model) from shares), 0), 6) as importance from (select unnest(range(9))::int as j) u left join shares using (j) group by u.j""",
    "forest_folds": _FOLDS + ", " + walked("select sensor_id, dip_id, is_vehicle, fold, f, model, 1 as node from split join (select distinct model from nodes) m on model // 10 = fold", 5) + """,
hits as (select fold, ((avg(share) > 0.5)::int = is_vehicle)::int::double as hit from leaf group by sensor_id, dip_id, fold, is_vehicle),
folds_ as (select fold, count(*) as rows, avg(hit) as accuracy from hits group by fold)
select fold, rows, round(accuracy, 6) as accuracy, round(avg(accuracy) over (), 6) as mean_accuracy, round(stddev_pop(accuracy) over () * 2, 6) as two_std from folds_""",
    "filter_start_time": f"with {SENSOR} select sensor_id, seq, time_ms, distance, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as i from sensor where time_ms >= 5000",
    "start_at_exact_time": f"with {SENSOR}, {STARTS} select * from starts",
    "rebase_timeline": f"with {SENSOR}, {STARTS} select sensor_id, seq, (time_ms - start_ms) / 1000.0::double as time_seconds, distance from sensor join starts using (sensor_id) where seq >= start_seq",
    "vehicle_times": f"with {FRAMES}, {TIMES} select * from times",
    "nearest_depth_join": f"""with {SENSOR}, {FRAMES},
points as (select sensor_id, time_ms / 1000.0::double as t, arg_min(distance, seq) as d from sensor group by sensor_id, time_ms),
shifted as (select sensor_id, frame_number, time_seconds, time_seconds + 0.1::double as tm from frames),
around as ({neighbours('shifted', 'points')})
select a.sensor_id, frame_number, time_seconds,
       case when tm >= 0 and tm <= t_max then case when t0 is null then q.d when t1 is null or abs(t0 - tm) <= abs(t1 - tm) then p.d else q.d end end as ultrawide_depth_m
from around a left join points p on p.sensor_id = a.sensor_id and p.t = t0 left join points q on q.sensor_id = a.sensor_id and q.t = t1""",
    "interpolate_counts_join": f"with {SENSOR}, {COUNTED} select sensor_id, seq, time_ms, distance, {_ROUND(('vehicles_in_frame', 'people_in_frame', 'bicycles_in_frame'))} from counted",
    "clip_markers": f"""with {SENSOR}, {FRAMES}, {TIMES}, {LASTS}
select sensor_id, time_seconds, time_seconds - 2.5 as synced_time, color_group from (
  select *, ((row_number() over (partition by sensor_id order by time_seconds) - 1) % 2)::int as color_group from times) x join lasts using (sensor_id)
where time_seconds - 2.5 between 0 and last_seconds""",
    "offset_sweep": f"""with {SENSOR}, {FRAMES}, {TIMES}, {LASTS},
grid as (select unnest(generate_series(0, 120)) as step),
shown as (select sensor_id, step, count(*) as n from times join lasts using (sensor_id) join grid on time_seconds + (-30 + step * 0.5::double) between 0 and last_seconds group by all)
select step, sum(n)::bigint as shown, count(*) as sensors from shown group by step""",
    "raw_dips": f"with {DIPS} select * from raw",
    "merged_dips": f"with {DIPS} select * from merged",
    "filtered_dips": f"with {DIPS} select * from kept",
    "segment_events": f"{BATCH} select * from stats",
    "gate_events": f"{GATED} select * from gated",
    "classify_events": f"{TYPED} select sensor_id, event_id, time_ms, duration, min_depth, type from typed",
    "event_report": f"{TYPED} select sensor_id, count(*) filter (type = 'Vehicle') as vehicles, count(*) as events, min(time_ms) as first_ms, max(duration) as longest from typed group by sensor_id",
    "segment_events_live": f"with {SENSOR}, {events('215', 200, 2, True)} select * from stats",
    "long_dips": f"with {DIPS} select * from kept",
    "long_events": f"{BATCH} select * from stats",
    "long_events_live": f"with {SENSOR}, {events('215', 200, 2, True)} select * from stats",
    "dip_slice_join": f"with {DIPS} select p.sensor_id, r.dip_id, p.i, p.time_ms, p.distance from pos p join raw r on p.sensor_id = r.sensor_id and p.i between r.start_idx and r.end_idx",
    "late_samples": f"""with {SENSOR},
lasts as (select sensor_id, max(time_ms * 1000000 + seq) as last from sensor where seq % 50 <> 7 and time_ms < (select max(time_ms) - 1500 from sensor where seq % 50 <> 7) group by sensor_id)
select sensor_id, count(*) as late_rows from sensor join lasts using (sensor_id) where seq % 50 = 7 and time_ms * 1000000 + seq <= last group by sensor_id""",
    "segment_events_compact": compact(5, "215", 0),
    "longest_stretch_start": f"""with {SENSOR},
l0 as (select *, row_number() over (partition by sensor_id order by time_ms, seq) - 1 as i, coalesce(distance > 220, false) as above from sensor),
l1 as (select *, i - row_number() over (partition by sensor_id, above order by i) as isle from l0),
l2 as (select sensor_id, isle, min(i)::bigint as start_idx, min(time_ms) as start_ms, max(time_ms) - min(time_ms) as span_ms from l1 where above group by sensor_id, isle having max(time_ms) - min(time_ms) >= 1000)
select sensor_id, start_idx, start_ms, span_ms from (select *, row_number() over (partition by sensor_id order by span_ms desc, start_idx) as r from l2) x where r = 1""",
    "calibrate_mode": f"with {SENSOR}, {MODE} select s.sensor_id, coalesce(baseline, 0) as baseline from (select distinct sensor_id from sensor) s left join modes using (sensor_id)",
    "calibrate_mean": f"""with {SENSOR} select sensor_id, round(case when count(*) >= 10 then avg(distance) end, 6) as baseline
from (select *, row_number() over (partition by sensor_id order by time_ms, seq) as n from sensor) s where n <= 10 group by sensor_id""",
    "live_events_batch": LIVE,
    "live_detector": LIVE,
    "compact_live_detector": compact(500, "case when true then base - 15 end", 10),
    "dip_slices": f"with {DIPS}, {slices()} select sensor_id, dip_id, i, time_ms, distance from slices",
    "dip_features": f"""{PLAIN} select sensor_id, dip_id, frame_count, start_frame_idx, end_frame_idx, time_of_dip_seconds, dip_duration_seconds, max_depth, min_depth,
{_ROUND(('avg_depth', 'depth_variance', 'avg_depth_gradient', 'max_depth_gradient', 'line_integral'))}, round(depth_fourth_moment + 3e-4, 2) as depth_fourth_moment from dips""",
    "dip_shape": f"{PLAIN} select sensor_id, dip_id, {_ROUND(('dip_height', 'fill_factor', 'plateau_variance'))}, shape_category from dips",
    "array_features": f"{PLAIN} select sensor_id, dip_id, frame_count, {_ROUND(('avg_depth', 'depth_variance', 'avg_depth_gradient', 'line_integral', 'plateau_variance'))}, shape_category from dips",
    "dip_object": f"{LABELLED} select sensor_id, dip_id, object, {_ROUND(('avg_vehicles', 'avg_bicycles', 'avg_people'))} from labelled",
    "dip_arrays": f"with {DIPS}, {slices()} select sensor_id, dip_id, string_agg(cast(round(distance * 100) as bigint)::varchar, ',' order by i) as depths from slices group by sensor_id, dip_id",
    "dip_summary": f"""{PLAIN} select sensor_id, count(*) as dips, round(avg(dip_duration_seconds), 6) as mean_duration, round(avg(max_depth), 6) as mean_max_depth, round(avg(depth_variance), 6) as mean_variance,
min(min_depth) as least_depth, max(max_depth) as greatest_depth, round(avg(avg_depth), 6) as mean_depth from dips group by rollup (sensor_id)""",
    "object_distribution": f"{LABELLED} select object, count(*) as dips, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percent from labelled group by object",
    "filter_detections": f"""with {BOXES} select video_id, frame_number, det_idx, case class_id when 0 then 'person' when 1 then 'bicycle' else 'car' end as class, round(confidence, 6) as confidence,
x1::int as x1, y1::int as y1, x2::int as x2, y2::int as y2 from boxes""",
    "roi_filter": f"""with {BOXES} select video_id, frame_number, det_idx, class_id, x1, y1, x2, y2 from boxes
where video_id % 2 = 1 or ((x1 + x2) / 2.0::double between 150 and 550 and (y1 + y2) / 2.0::double between 0 and 400)""",
    "roi_regions": f"""with {BOXES}, centred as (select *, (x1 + x2) / 2.0::double as cx, (y1 + y2) / 2.0::double as cy from boxes) select video_id, frame_number, det_idx, class_id, x1, y1, x2, y2 from centred
where video_id % 3 = 0 or (cx between 150 and 350 and cy between 0 and 400) or (cx between 300 and 500 and cy between 100 and 127) or (cx between 640 and 670 and cy between 0 and 1000)""",
    "frame_times": f"with {BOXES}, {CLASS_COUNTS}, {TIMELINE} select video_id, frame_number, frame_number / 4.0::double as time_seconds, total_in_frame from timeline where frame_number >= 41",
    "box_similarity_pairs": f"""with {BOXES},
pairs as (select a.video_id, a.frame_number, a.det_idx, b.det_idx as next_idx, ((a.x2 - a.x1) * (a.y2 - a.y1))::double as s, ((b.x2 - b.x1) * (b.y2 - b.y1))::double as t,
                 sqrt(pow((a.x1 + a.x2) / 2.0::double - (b.x1 + b.x2) / 2.0::double, 2) + pow((a.y1 + a.y2) / 2.0::double - (b.y1 + b.y2) / 2.0::double, 2)) as dist
          from boxes a join boxes b on a.video_id = b.video_id and b.frame_number = a.frame_number + 1),
alike as (select *, 0.4::double * (case when greatest(s, t) > 0 then least(s, t) / greatest(s, t) else 0 end)
                    + 0.6::double * (case when s + t > 0 then greatest(0, 1 - dist / sqrt((s + t) / 2) / 2) else 0 end) as similarity from pairs)
select video_id, frame_number, det_idx, next_idx, round(similarity, 6) as similarity from alike where similarity > 0.6""",
    "frame_class_counts": f"with {BOXES}, {CLASS_COUNTS} select * from counts",
    "frame_timeline": f"with {BOXES}, {CLASS_COUNTS}, {TIMELINE} select * from timeline",
    "cumulative_counts": f"with {BOXES}, {CUMULATIVE} select * from cumulative",
    "visibility_stats": f"""with {BOXES}, {CLASS_COUNTS}, {TIMELINE}, {CUMULATIVE},
finals as (select video_id, max(total_people_counted) as final_people, max(total_bicycles_counted) as final_bicycles, max(total_vehicles_counted) as final_vehicles, max(total_objects_counted) as final_objects from cumulative group by video_id)
select video_id, max(time_seconds) as duration, count(*) as frames, {_VISIBLE}, min(final_people) as final_people, min(final_bicycles) as final_bicycles, min(final_vehicles) as final_vehicles, min(final_objects) as final_objects
from timeline join finals using (video_id) group by video_id""",
    "frame_table": f"with {BOXES}, {CLASS_COUNTS}, {TIMELINE}, {CUMULATIVE}, {TABLE} select * from table_",
    "frame_counts_roundtrip": f"with {BOXES}, {CLASS_COUNTS}, {TIMELINE}, {CUMULATIVE}, {TABLE} select * exclude (video_id) from table_",
    "frame_counts_live": f"with {BOXES}, {CLASS_COUNTS} select * from counts",
    "sensor_log_roundtrip": f"with {SENSOR} select sensor_id::varchar as sensor_id, seq, time_ms, distance from sensor",
    "lenient_log_roundtrip": f"with {SENSOR} select sensor_id::varchar as sensor_id, seq, time_ms, distance from sensor",
    "log_to_report": f"{TYPED} select sensor_id::varchar as sensor_id, count(*) filter (type = 'Vehicle') as vehicles, count(*) as events, min(time_ms) as first_ms, max(duration) as longest from typed group by sensor_id",
    "dip_table_roundtrip": f"""{LABELLED},
depths_ as (select sensor_id, dip_id, string_agg(round(distance * 100)::bigint::varchar, ',' order by i) as depths from slices group by sensor_id, dip_id)
select time_of_dip_seconds, dip_duration_seconds, frame_count, start_frame_idx, end_frame_idx, min_depth, object, shape_category,
{_ROUND(('avg_depth', 'depth_variance', 'avg_depth_gradient', 'line_integral', 'fill_factor', 'plateau_variance', 'avg_vehicles', 'avg_bicycles', 'avg_people'))}, depths
from labelled join depths_ using (sensor_id, dip_id)""",
    "track_objects": TRACKS,
    "track_objects_crowded": TRACKS,
    "track_objects_live": TRACKS,
    "track_metrics": f"with {BOXES}, {METRICS} select * from ruled",
    "valid_vehicle": f"with {BOXES}, {METRICS} select video_id, lane, boxes, duration_seconds from ruled where valid_vehicle",
    "valid_person": f"with {BOXES}, {METRICS} select video_id, lane, boxes, duration_seconds from ruled where valid_person",
    "label_fill_features": f"{LABELLED} select sensor_id, dip_id, is_vehicle, {_ROUND(_NINE)} from labelled",
    "rule_score": f"{LABELLED} select sensor_id, dip_id, (depth_variance <= 3070)::int as rule_variance, (avg_depth_gradient <= 21.08)::int as rule_gradient from labelled",
    "stratified_split": f"""{LABELLED},
sizes as (select is_vehicle, count(*) as n, sum(count(*)) over () as n_all, floor(count(*) * 0.3::double) as quota from labelled group by is_vehicle),
quotas as (select *, quota + case when row_number() over (order by n * 0.3::double - quota desc, is_vehicle) <= ceil(n_all * 0.3::double) - sum(quota) over () then 1 else 0 end as q from sizes)
select sensor_id, dip_id, is_vehicle, n_all < 20 or r > q as in_train, n_all < 20 or r <= q as in_test from (
  select *, row_number() over (partition by is_vehicle order by sensor_id, dip_id) as r from labelled) l join quotas using (is_vehicle)""",
    "classification_report": f"{LABELLED}, scored as (select is_vehicle as y, (depth_variance <= 3070)::int as p from labelled), {REPORT}",
}
ORACLES["frames_with_depth_roundtrip"] = ORACLES["nearest_depth_join"].replace("select a.sensor_id, frame_number", "select a.sensor_id::varchar as sensor_id, frame_number")
#: Like `rounded` in the registry: a value that ends in 5 at the seventh place rounds up in both engines.
ORACLES = {k: v.replace(", 6)", " + 3e-8, 6)") for k, v in ORACLES.items()}
