"""DuckDB SQL for the queries, written from the semantics and not from the Spark plans."""

from keystride import queries as Q
from keystride import schema as S
from keystride.functions.scalars import TIER_ICONS, TIER_MESSAGES
from keystride.plans.scoring import FAMILIES, NORMAL, UNUSUAL
from keystride.sources.sample import ERROR_SHARE, RESOLUTIONS, USER_AGENTS

ORACLES: dict[str, str] = {}


def r(expression: str, name: str) -> str:
    """Rounded like the queries; adding zero turns -0.0 into 0.0."""
    return (f"case when abs({expression}) < {Q.LARGE} then round({expression}, {Q.DIGITS}) + 0.0 "
            f"else round({expression}, {Q.LARGE_DIGITS}) end as {name}")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- shared views -------------------------------------------------------------------------
EV = f"""
ev as (
  select cast(user_id as varchar) as session_id, event_id as pos, ts as event_time,
         epoch_us(ts) / 8e10 as t,
         case when event_type in ('view', 'click') then 'key'
              when event_type = 'error' then 'click' else 'movement' end as lane,
         case event_type when 'view' then 'keydown' when 'click' then 'keyup'
              when 'error' then 'click' else 'movement' end as kind,
         case when event_type in ('view', 'click') then 65 + k % 5 end as key_code,
         case when event_type not in ('view', 'click') then cast(k * 37 % 1920 as double) end as x,
         case when event_type not in ('view', 'click')
              then cast(cast(floor(value) as int) % 1080 as double) end as y,
         case when event_type = 'error' then cast(k % 3 as varchar) end as button,
         {_list(RESOLUTIONS)}[k % 4 + 1] as screen_resolution
  from (select *, cast(props->>'$.k' as int) as k from events)
)"""

TIMED = f"""{EV},
paired as (
  select *, t - lag(t) over w as dt, x - lag(x) over w as dx, y - lag(y) over w as dy,
         row_number() over w as place,
         min(case when kind = 'keyup' then t end) over (
           partition by session_id, lane, key_code order by t, pos
           rows between 1 following and unbounded following) - t as later_up
  from ev window w as (partition by session_id, lane order by t, pos)
),
moved as (
  select *, case when lane = 'movement' and dt > 0 then sqrt(dx * dx + dy * dy) / dt end
            as velocity,
         case when kind = 'keydown' then later_up end as hold,
         case when kind = 'keydown' and dt < {S.LONG_PAUSE_SECONDS} then dt end as interkey
  from paired
),
valid as (
  select pos, (velocity - lag(velocity) over (partition by session_id order by t, pos)) / dt
              as acceleration
  from moved where velocity is not null
),
timed as (select moved.*, acceleration from moved left join valid using (pos))"""

KEYS = """
  avg(hold) as mean_hold_time, stddev_pop(hold) as std_hold_time,
  avg(interkey) as mean_interkey_time, stddev_pop(interkey) as std_interkey_time,
  count(*) / nullif(max(t) - min(t), 0) as typing_speed"""
MOUSE = """
  avg(velocity) as mean_velocity, stddev_pop(velocity) as std_velocity,
  coalesce(avg(acceleration), 0) as mean_acceleration,
  coalesce(stddev_pop(acceleration), 0) as std_acceleration,
  count(*) filter (where lane = 'click') / nullif(max(t) - min(t), 0) as click_frequency,
  coalesce(avg(acceleration), 0) as movement_smoothness,
  count(*) filter (where lane = 'movement') as movements"""
DEVICES = f"""
users as (
  select user_id, cast(user_id as varchar) as session_id,
         min(epoch_us(ts) / 8e10) as session_start,
         max(epoch_us(ts) / 8e10) - min(epoch_us(ts) / 8e10) as session_duration,
         {_list(RESOLUTIONS)}[user_id % 4 + 1] as screen_resolution,
         case when count(*) filter (where event_type = 'error') / count(*) > {ERROR_SHARE}
              then 1 else 0 end as label
  from events group by user_id
),
devices as (
  select session_id, session_duration,
         cast(split_part(screen_resolution, 'x', 1) as double) as screen_width,
         cast(split_part(screen_resolution, 'x', 2) as double) as screen_height,
         cast(split_part(screen_resolution, 'x', 1) as double)
           / cast(split_part(screen_resolution, 'x', 2) as double) as screen_ratio,
         case when user_id % 4 = 2 then 1.0::double else 0.0::double end as is_mobile,
         cast((user_id % 25 - 12) * 60 as double) as timezone_offset
  from users
)"""


def _prefixed(prefix: str, names: list[str], guard: str = "") -> str:
    return ", ".join(
        (f"case when {guard} then {n} end" if guard else n) + f" as {prefix}{n}" for n in names
    )


FEATURES = f"""{TIMED}, {DEVICES},
kf as (select session_id, {KEYS} from timed where lane = 'key' group by session_id),
mf as (select session_id, {MOUSE} from timed where lane <> 'key' group by session_id),
features as (
  select session_id, {_prefixed("keystroke_", S.KEYSTROKE_FEATURES)},
         {_prefixed("mouse_", S.MOUSE_FEATURES, "movements >= 2")},
         {_prefixed("device_", S.DEVICE_FEATURES)},
         coalesce(session_duration, 0) as session_duration
  from devices full join kf using (session_id) full join mf using (session_id)
),
aligned as (select session_id, {", ".join(
    f"coalesce({n}, 0.0) as {n}" for n in S.SESSION_FEATURES)} from features),
stats as (select {", ".join(
    f"avg({n}) as {n}_m, coalesce(nullif(stddev_pop({n}), 0), 1) as {n}_s"
    for n in S.SESSION_FEATURES)} from aligned),
scaled as (select session_id, {", ".join(
    f"({n} - {n}_m) / {n}_s as {n}" for n in S.SESSION_FEATURES)} from aligned, stats),
shares as (select session_id, {", ".join(f"abs({n}) / total as {n}" for n in S.SESSION_FEATURES)}
  from (select *, {" + ".join(f"abs({n})" for n in S.SESSION_FEATURES)} as total from scaled))"""

RAW = f"""{TIMED},
raw as (
  select session_id, pos, event_time,
         case when lane = 'key' then dt end as time_between_keystrokes,
         velocity as mouse_velocity,
         case when lane = 'movement' and place > 1 then atan2(dy, dx) end as mouse_movement_angle,
         case when lane = 'click' then cast(x as varchar) || ',' || cast(y as varchar) end
           as mouse_click_position,
         case when screen_resolution in ('390x844', '768x1024') then 'portrait'
              else 'landscape' end as device_orientation,
         screen_resolution
  from timed
)"""
ACTIVITY = """
  avg(time_between_keystrokes) as avg_typing_speed,
  stddev_samp(time_between_keystrokes) as typing_rhythm_consistency,
  quantile_disc(time_between_keystrokes, 0.9) as typing_burst_speed,
  avg(mouse_velocity) as avg_mouse_speed,
  stddev_samp(mouse_movement_angle) as mouse_direction_entropy,
  count(distinct mouse_click_position) as distinct_click_positions,
  array_to_string(list_sort(list(distinct device_orientation)), ';')
    as device_orientation_changes,
  array_to_string(list_sort(list(distinct screen_resolution)), ';')
    as screen_resolution_changes,
  count(*) as total_interactions,
  count(*) filter (where hour(event_time) between 0 and 5) as late_night_activity"""
ACTIVITY_DOUBLES = ["avg_typing_speed", "typing_rhythm_consistency", "typing_burst_speed",
                    "avg_mouse_speed", "mouse_direction_entropy"]
ACTIVITY_OTHERS = ["distinct_click_positions", "device_orientation_changes",
                   "screen_resolution_changes", "total_interactions", "late_night_activity"]
ACTIVE = f"""{RAW},
activity as (select session_id, {ACTIVITY} from raw group by session_id),
long as (
  unpivot (select session_id, {", ".join(
      f"cast(coalesce({n}, 0) as double) as {n}" for n in S.ACTIVITY_VECTOR)} from activity)
  on {", ".join(S.ACTIVITY_VECTOR)} into name feature value value
)"""
SCORED = """
scored as (
  select event_id, cast(user_id as varchar) as session_id, ts as event_time,
         k / 100.0::double as risk_score, (event_id % 1000) / 1000.0::double as confidence,
         -(k + 1) / 101.0::double as raw_score,
         value / nullif(value + 50, 0) as normality,
         case when event_type = 'error' then 1 else 0 end as label
  from (select *, cast(props->>'$.k' as int) as k from events)
)"""
METRICS = f"""
  count(*) as prediction_count, {r("avg(risk_score)", "average_risk_score")},
  {r(f"count(*) filter (where label = 1 and risk_score >= {S.HIGH_RISK}) / count(*)",
     "true_positive_rate")},
  {r(f"count(*) filter (where label = 0 and risk_score >= {S.HIGH_RISK}) / count(*)",
     "false_positive_rate")},
  {r(f"count(*) filter (where label = 1 and risk_score >= {S.HIGH_RISK}) "
     "/ nullif(count(*) filter (where label = 1), 0)", "recall")},
  {r(f"count(*) filter (where label = 0 and risk_score >= {S.HIGH_RISK}) "
     "/ nullif(count(*) filter (where label = 0), 0)", "fall_out")}"""
TIER = (f"case when risk_score > {S.HIGH_RISK} then 'high' "
        f"when risk_score > {S.MEDIUM_RISK} then 'medium' else 'low' end")
DRIFT = f"""
binned as (
  select least(cast(floor(risk_score * 10) as int), 9) as bin,
         event_time < timestamp '{Q.HALF_TIME}' as early from scored
),
sides as (
  select bin,
         greatest(count(*) filter (where early)
           / (select count(*) from binned where early), 1e-6) as b,
         greatest(count(*) filter (where not early)
           / (select count(*) from binned where not early), 1e-6) as c
  from binned group by bin
)"""


def _rounded(names: list[str], extra: str = "session_id") -> str:
    return ", ".join([extra] + [r(n, n) for n in names])


def _rank_sum(rows: str, score: str) -> str:
    """Area under ROC by average ranks."""
    return f"""(
      select (sum(case when label = 1 then mid end) - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1))
      from (select label,
                   rank() over (order by {score})
                     + (count(*) over (partition by {score}) - 1) / 2.0 as mid,
                   cast(count(*) filter (where label = 1) over () as double) as n1,
                   count(*) over () as n
            from {rows}) group by n1, n)"""


# ---- events and timings -------------------------------------------------------------------
ORACLES["keystroke_events"] = f"""with {EV}
  select session_id, pos, kind, key_code,
         {r("(epoch_us(event_time) // 1000) / 1000.0::double", "t")}
  from ev where lane = 'key'"""
ORACLES["mouse_events"] = f"""with {EV}
  select session_id, pos, kind, x, y, button,
         {r("(epoch_us(event_time) // 1000) / 1000.0::double", "t")}
  from ev where lane <> 'key'"""
ORACLES["device_record"] = f"""
  select event_id, {_list(RESOLUTIONS)}[cast(props->>'$.k' as int) % 4 + 1] as screen_resolution,
         'en-US' as browser_language,
         cast((user_id % 25 - 12) * 60 as int) as timezone_offset, 'sample' as platform,
         regexp_matches({_list(USER_AGENTS)}[event_id % 6 + 1], '(?i)Mobile|Android|iPhone')
           as is_mobile
  from events"""
ORACLES["keystroke_hold"] = f"""with {TIMED}
  select session_id, pos, key_code, {r("hold", "hold")} from timed where hold is not null"""
for _name in ("interkey", "velocity", "acceleration"):
    _family = "keystroke" if _name == "interkey" else "mouse"
    ORACLES[f"{_family}_{_name}"] = f"""with {TIMED}
      select session_id, pos, {r(_name, _name)} from timed where {_name} is not null"""
ORACLES["raw_behavioral"] = f"""with {RAW}
  select session_id, pos, epoch_us(event_time) as "timestamp",
         {r("time_between_keystrokes", "time_between_keystrokes")},
         {r("mouse_velocity", "mouse_velocity")},
         {r("mouse_movement_angle", "mouse_movement_angle")},
         mouse_click_position, device_orientation, screen_resolution
  from raw"""

# ---- session features ---------------------------------------------------------------------
ORACLES["keystroke_features"] = f"""with {FEATURES}
  select {_rounded(S.KEYSTROKE_FEATURES)} from kf"""
ORACLES["mouse_features"] = f"""with {FEATURES}
  select session_id, {", ".join(
      r(f"case when movements >= 2 then {n} end", n) for n in S.MOUSE_FEATURES)} from mf"""
ORACLES["device_features"] = f"""with {DEVICES}
  select {_rounded(S.DEVICE_FEATURES)} from devices"""
ORACLES["session_features"] = f"""with {FEATURES}
  select {_rounded(S.SESSION_FEATURES)} from features"""
ORACLES["align_features"] = f"""with {FEATURES}
  select {_rounded(S.SESSION_FEATURES[:-2])}, 0.0::double as device_battery from aligned"""
ORACLES["session_sql_features"] = f"""with {ACTIVE}
  select {_rounded(ACTIVITY_DOUBLES)}, {", ".join(ACTIVITY_OTHERS)} from activity"""
ORACLES["sql_view_features"] = ORACLES["session_sql_features"]
ORACLES["hourly_features"] = f"""with {RAW},
  activity as (select session_id, epoch_us(date_trunc('hour', event_time)) as hour, {ACTIVITY}
    from raw group by all)
  select {_rounded(ACTIVITY_DOUBLES, "session_id, hour")}, {", ".join(ACTIVITY_OTHERS)}
  from activity"""
ORACLES["hourly_refresh"] = ORACLES["hourly_features"]
ORACLES["session_span"] = f"""
  select cast(user_id as varchar) as session_id,
         strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') as started,
         {r("(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6", "seconds")},
         {r("(epoch_us(max(ts)) // 1000) / 1e3", "end_seconds")}
  from events group by user_id"""
ORACLES["session_key"] = """
  select event_id as pos,
         sha256(cast(user_id as varchar) || ':' || cast(epoch_us(ts) as varchar))[1:16]
           as session_key
  from events"""
GAPS = f"""{EV},
opened as (
  select *, case when event_time - lag(event_time) over w <= interval 6 hours then 0 else 1 end
    as opens
  from ev window w as (partition by session_id order by event_time)
),
runs as (
  select *, sum(opens) over (partition by session_id order by event_time) as run from opened
),
spans as (
  select session_id, run, min(event_time) as session_start, max(event_time) as last_event,
         count(*) as events
  from runs group by session_id, run
)"""
ORACLES["session_window_batch"] = f"""with {GAPS}
  select session_id, epoch_us(session_start) as session_start,
         epoch_us(last_event) as last_event, events from spans"""
ORACLES["mobile_user_agent"] = f"""
  select event_id,
         regexp_matches({_list(USER_AGENTS)}[event_id % 6 + 1], '(?i)Mobile|Android|iPhone')
           as is_mobile
  from events"""

# ---- payloads -----------------------------------------------------------------------------
CHECKED = """
  with bodies as (
    select event_id, case event_type
      when 'view' then '{"session_id":"' || user_id || '","timestamp":"' || ts
                       || '","props":' || props || '}'
      when 'click' then '{"session_id":null,"timestamp":"' || ts || '"}'
      when 'error' then '{"timestamp":"' || ts || '"}'
      when 'signup' then 'not json ' || user_id
      else '["session_id","timestamp",' || user_id || ']' end as raw
    from events
  ),
  parsed as (select *, json_keys(try_cast(raw as json)) as names from bodies),
  checked as (
    select event_id, raw, coalesce(list_contains(names, 'session_id')
                                   and list_contains(names, 'timestamp'), false) as is_valid
    from parsed
  )"""
ORACLES["payload_validation"] = f"{CHECKED} select event_id, is_valid from checked"
ORACLES["stream_rejected"] = f"""{CHECKED}
  select raw, case when raw like '{{%' then 'Missing required fields' else 'Not a JSON object' end as reason from checked where not is_valid"""
ORACLES["assigned_positions"] = f"""with {EV}
  select session_id, count(*) as events, count(*) as positions, sum(case when lane = 'key' then 1 else 0 end)::bigint as keys from ev group by session_id"""
_PLAIN = f"""with {EV}
  select session_id, pos, lane, kind, key_code, x, y, button, {r("t", "t")} from ev"""
for _name in ("explode_events", "read_session_log", "read_session_doc", "dedup_events",
              "stream_ingest", "stream_dedup"):
    ORACLES[_name] = _PLAIN
ORACLES["session_document"] = f"""with {EV}, {DEVICES}, placed as (
    select *, (row_number() over (partition by session_id, floor(t / 5) order by t, pos) - 1)
              // 50 as run from ev)
  select session_id, strftime(max(event_time), '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp",
         {r("max(t) - any_value(session_start)", "session_duration")},
         cast(count(*) filter (where lane = 'key') as int) as keys,
         cast(count(*) filter (where lane <> 'key') as int) as mouse,
         min(pos) filter (where lane = 'key') as first_key_pos,
         max(pos) filter (where lane <> 'key') as last_mouse_pos,
         any_value(users.screen_resolution) as screen_resolution
  from placed join users using (session_id) group by session_id, floor(t / 5), run"""
ORACLES["merge_payloads"] = f"""with {EV}, {DEVICES}
  select session_id, {r("any_value(session_duration)", "session_duration")},
         any_value(users.screen_resolution) as screen_resolution, count(*) as events,
         {r("min(t)", "first_t")}, {r("max(t)", "last_t")}
  from ev join users using (session_id) group by session_id"""
_REQUESTS = """with requests as (
    select c_custkey as request_id,
           case c_custkey % 10 when 9 then '' when 8 then null
                else cast(c_custkey as varchar) end as session_id
    from customer)
  select * from requests where session_id <> '' and session_id {} (
    select cast(user_id as varchar) from events)"""
ORACLES["sessions_with_data"] = _REQUESTS.format("in")
ORACLES["sessions_without_data"] = _REQUESTS.format("not in")

# ---- vectors ------------------------------------------------------------------------------
ORACLES["feature_vector"] = f"""with {ACTIVE}
  select session_id, feature, {r("value", "value")} from long"""
ORACLES["scaled_features"] = f"""with {ACTIVE}
  select session_id, feature, {r(
      "coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 0)", "value")}
  from long window w as (partition by feature)"""
#: The eigenvectors of the features' covariance by cyclic rotations: `a` goes to the diagonal, `v` collects the
#: rotations (8 x 8, row by row, 28 pairs a sweep).
ORACLES["pca_features"] = f"""with recursive {ACTIVE},
names as (select unnest({_list(S.ACTIVITY_VECTOR)}) as feature, unnest(range(8)) as i),
scaled as (
  select session_id, i, coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 0) as z
  from long join names using (feature) window w as (partition by i)
),
covariance as (
  select x.i, y.i as j, covar_samp(x.z, y.z) as c from scaled x join scaled y using (session_id) group by x.i, y.i
),
pairs as (
  select list(p order by p, q) as ps, list(q order by p, q) as qs
  from (select unnest(range(8)) as p) cross join (select unnest(range(8)) as q) where p < q
),
rotated(step, a, v) as (
  select 0, list(c order by i, j), [case when x // 8 = x % 8 then 1.0::double else 0 end for x in range(64)] from covariance
  union all
  select step + 1,
    [case when x // 8 = p then cs * b[p * 8 + x % 8 + 1] - sn * b[q * 8 + x % 8 + 1]
          when x // 8 = q then sn * b[p * 8 + x % 8 + 1] + cs * b[q * 8 + x % 8 + 1] else b[x + 1] end for x in range(64)],
    [case when x % 8 = p then cs * v[x // 8 * 8 + p + 1] - sn * v[x // 8 * 8 + q + 1]
          when x % 8 = q then sn * v[x // 8 * 8 + p + 1] + cs * v[x // 8 * 8 + q + 1] else v[x + 1] end for x in range(64)]
  from (
    select *, [case when x % 8 = p then cs * a[x // 8 * 8 + p + 1] - sn * a[x // 8 * 8 + q + 1]
                    when x % 8 = q then sn * a[x // 8 * 8 + p + 1] + cs * a[x // 8 * 8 + q + 1] else a[x + 1] end for x in range(64)] as b
    from (
      select *, 1 / sqrt(t * t + 1) as cs, t / sqrt(t * t + 1) as sn
      from (
        select *, case when a[p * 8 + q + 1] = 0 then 0
            else (case when turn >= 0 then 1 else -1 end) / (abs(turn) + sqrt(turn * turn + 1)) end as t
        from (
          select *, coalesce((a[q * 9 + 1] - a[p * 9 + 1]) / nullif(2 * a[p * 8 + q + 1], 0), 0) as turn
          from (select step, a, v, ps[step % 28 + 1] as p, qs[step % 28 + 1] as q from rotated, pairs where step < 28 * 15)
        )
      )
    )
  )
),
loadings as (
  select i, component, a[component * 9 + 1] as size, v[i * 8 + component + 1] as loading
  from rotated, (select unnest(range(8)) as i), (select unnest(range(8)) as component) where step = 28 * 15
),
largest as (
  select component, size, arg_min(loading, i) as first
  from (select *, max(abs(loading)) over (partition by component) as most from loadings)
  where abs(loading) >= most - 1e-6 group by all
),
places as (
  select component, case when first < 0 then -1 else 1 end as sign, row_number() over (order by size desc) as place from largest
)
  select session_id, 'pc' || place as feature, {r("sum(z * loading * sign)", "value")}
  from scaled join loadings using (i) join places using (component) where place <= 5 group by session_id, place"""
ORACLES["feature_stages"] = f"""with {ACTIVE}
  select session_id, {", ".join(
      r(f"coalesce({n}, 0)", n) if n in ACTIVITY_DOUBLES else n for n in S.ACTIVITY_VECTOR)},
      8 as features_size, 8 as scaled_features_size, 5 as pca_features_size
  from activity"""
ORACLES["detector_scale"] = f"""with {FEATURES}
  select {_rounded(S.SESSION_FEATURES)} from scaled"""


def _uniform(*parts: str) -> str:
    """A number in [0, 1) from the digest of the joined parts."""
    joined = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || left(md5({joined}), 13))::bigint / 4503599627370496.0::double)"


def _mean_path(n: str) -> str:
    return (f"(case when {n} <= 1 then 0 when {n} = 2 then 1 else 2 * (ln({n} - 1) + 0.5772156649015329) "
            f"- 2 * ({n} - 1) / {n}::double end)")


def forest_ctes(rows: str, others: str = "select * from cells", seed: int = 42, trees: int = 100, wanted: int = 256, levels: int = 8) -> str:
    """Tables nodes (the forest grown from `rows`, level by level) and forest_scores (id, raw_score) of `others`.

    Both are queries of (id, f, v): number f of the features of id has the value v.
    """
    parts = [f"""
cells as ({rows}),
others as ({others}),
ids as (select distinct id from cells),
numbers as (select count(*) as n, least({wanted}, count(*)) as wanted, least(1.0, 6.0 * {trees} * least({wanted}, count(*)) / count(*)) as pool from ids),
tree_list as (select unnest(range({trees})) as tree),
offered as (
  select tree, id, {_uniform(str(seed), "tree", "id")} as u, n, wanted, pool from ids, tree_list, numbers
  where {_uniform(str(seed), "'pool'", "id")} < pool
),
l0 as (
  select tree, 0 as node, id from offered where u < least(1.0, 3.0 * wanted / (n * pool))
  qualify row_number() over (partition by tree order by u, id) <= max(wanted) over ()
)"""]
    for d in range(levels + 1):
        grows = f"{d} < least({levels}, ceil(log2(greatest((select wanted from numbers), 2))))"
        parts.append(f"""
p{d} as (
  select tree, node, f, case when lo + u * (hi - lo) >= hi then lo else lo + u * (hi - lo) end as split
  from (
    select tree, node, f, min(v) as lo, max(v) as hi, {_uniform(str(seed), "tree", "node", "'split'")} as u,
           row_number() over (partition by tree, node order by f) - 1 as place,
           count(*) over (partition by tree, node) as varying
    from l{d} join cells using (id) where {grows} group by tree, node, f having max(v) > min(v)
  ) where place = floor({_uniform(str(seed), "tree", "node", "'feature'")} * varying)
),
n{d} as (
  select s.tree, s.node, coalesce(p.f, -1) as feature, coalesce(p.split, 0.0) as split, case when p.f is null then -1 else 2 * s.node + 1 end as lo,
         case when p.f is null then -1 else 2 * s.node + 2 end as hi, s.size, {d} as depth
  from (select tree, node, count(*) as size from l{d} group by tree, node) s left join p{d} p using (tree, node)
),
l{d + 1} as (
  select tree, case when v <= split then 2 * node + 1 else 2 * node + 2 end as node, id from l{d} join p{d} using (tree, node) join cells using (id, f)
)""")
    parts.append("\nnodes as (" + " union all ".join(f"select * from n{d}" for d in range(levels + 1)) + ")")
    parts.append("\nw0 as (select id, tree, 0 as node from (select distinct id from others), tree_list)")
    for d in range(levels):
        parts.append(f"""
w{d + 1} as (
  select w.id, w.tree, case when n.feature < 0 then w.node when c.v <= n.split then n.lo else n.hi end as node
  from w{d} w join nodes n using (tree, node) left join others c on c.id = w.id and c.f = n.feature
)""")
    parts.append(f"""
forest_scores as (
  select id, -pow(2, -avg(depth + {_mean_path("size")}) / (select {_mean_path("wanted")} from numbers)) as raw_score
  from w{levels} join nodes using (tree, node) group by id
)""")
    return ",".join(parts)


_EMBEDDED = "select vec_id as id, generate_subscripts(embedding, 1) - 1 as f, unnest(embedding)::double as v from embeddings"
ORACLES["iforest_fit"] = f"""with {forest_ctes(_EMBEDDED)}
  select tree, node, feature, {r("split", "split")}, lo, hi, size, depth from nodes"""
ORACLES["iforest_score"] = f"""with {forest_ctes(_EMBEDDED)}
  select id as vec_id, {r("raw_score", "iforest_score")}, {r("1 + raw_score", "iforest_prediction")} from forest_scores"""
ORACLES["iforest_flag"] = f"""with {forest_ctes(_EMBEDDED)}
  select id as vec_id, raw_score < (select quantile_cont(raw_score, 0.1) from forest_scores) as iforest_anomaly from forest_scores"""


def _cells(table: str, names: list[str], key: str = "id") -> str:
    return " union all ".join(f"select {key} as id, {i} as f, {n}::double as v from {table}" for i, n in enumerate(names))


def detector_ctes(table: str, names: list[str], key: str = "session_id") -> str:
    """forest_scores of a table of scaled features."""
    return forest_ctes(_cells(table, names, key))


ORACLES["detector_predict"] = f"""with {FEATURES}, {detector_ctes("scaled", S.SESSION_FEATURES)},
  judged as (select id as session_id, raw_score, 1 - 1 / (1 + exp(-raw_score)) as risk_score,
                    raw_score < (select quantile_cont(raw_score, 0.1) from forest_scores) as is_anomaly from forest_scores)
  select session_id, is_anomaly, {r("risk_score", "risk_score")}, {r("abs(risk_score - 0.5) * 2", "confidence")},
         {r("raw_score", "raw_score")}, {r("session_duration", "duration_importance")}
  from judged join shares using (session_id)"""

ORACLES["request_outcomes"] = f"""with {FEATURES}, {detector_ctes("scaled", S.SESSION_FEATURES)},
  risks as (select id as session_id, 1 - 1 / (1 + exp(-raw_score)) as risk_score from forest_scores),
  requests as (
    select c_custkey as request_id,
           case c_custkey % 10 when 9 then '' when 8 then null else cast(c_custkey as varchar) end as session_id
    from customer
  )
  select q.request_id, q.session_id,
         case when coalesce(q.session_id, '') = '' then 'refused' when k.session_id is null then 'no_data' else 'scored' end as outcome,
         case when coalesce(q.session_id, '') = '' then 'Missing session_id' when k.session_id is null then 'No data found for this session' end as reason,
         {r("k.risk_score", "risk_score")}, {r("abs(k.risk_score - 0.5) * 2", "confidence")},
         case when k.risk_score > 0.7 then 'high' when k.risk_score > 0.3 then 'medium' when k.risk_score is not null then 'low' end as tier,
         '{Q.HALF_TIME.replace(" ", "T")}.000000Z' as "timestamp"
  from requests q left join risks k on k.session_id = q.session_id"""

ORACLES["iforest_trees"] = f"""
  select cast(tree as int) as tree, cast(least(n, {S.MAX_SAMPLES}) as int) as drawn,
         least(n, {S.MAX_SAMPLES}) as in_leaves, 1::bigint as leaves_over_splits
  from range({S.NUM_TREES}) trees(tree), (select count(*) as n from embeddings)"""
ORACLES["model_roundtrip"] = """
  select distinct cast(user_id as varchar) as session_id, true as same_score from events"""

# ---- scores -------------------------------------------------------------------------------
ORACLES["risk_tier"] = f"""with {SCORED}
  select event_id, {r("risk_score", "risk_score")}, {TIER} as tier from scored"""


def _by_tier(texts: dict[str, str]) -> str:
    return "case tier " + " ".join(f"when '{t}' then '{x}'" for t, x in texts.items()) + " end"


ORACLES["risk_report"] = f"""with {SCORED}, tiers as (select *, {TIER} as tier from scored)
  select event_id, tier, {_by_tier(TIER_MESSAGES)} as message, {_by_tier(TIER_ICONS)} as icon,
         printf('%.1f%%', round(risk_score * 100, 1)) as risk_text,
         printf('%.1f%%', round(confidence * 100, 1)) as confidence_text
  from tiers"""
ORACLES["detector_risk"] = f"""with {SCORED},
  normal as (select event_id, 1 / (1 + exp(-raw_score)) as n from scored)
  select event_id, {r("1 - n", "risk_score")}, {r("abs(n - 0.5) * 2", "confidence")}
  from normal"""
ORACLES["ensemble_risk"] = f"""with {SCORED}
  select event_id,
         {r(f"{S.IFOREST_WEIGHT} * (1 - normality) + {S.RF_WEIGHT} * risk_score", "risk")},
         {r("1 - normality", "isolation_only")}
  from scored"""
ORACLES["feature_contributions"] = f"""with {FEATURES},
  spread as (unpivot shares on {", ".join(S.SESSION_FEATURES)}
             into name feature value contribution)
  select session_id, feature, {r("contribution", "contribution")} from spread"""
_FAMILY_ROWS = " union all ".join(
    f"select session_id, '{name}' as family, round({' + '.join(members)}, 9) as share, "
    f"'{UNUSUAL[name]}' as unusual, '{NORMAL[name]}' as normal from shares"
    for name, members in FAMILIES.items()
)
ORACLES["top_factors"] = f"""with {FEATURES},
  families as ({_FAMILY_ROWS}),
  ranked as (
    select *, row_number() over (partition by session_id order by share desc, family) as place,
           cast(session_id as int) % 100 / 100.0::double as risk_score
    from families
  )
  select session_id, cast(place - 1 as int) as place,
         case when risk_score > {S.HIGH_RISK} or (risk_score > {S.MEDIUM_RISK} and place = 1)
              then unusual else normal end as factor
  from ranked where place <= 3"""
ORACLES["auc_roc"] = f"""with rated as (
    select n_chars, toxic as label from documents join labels using (doc_id))
  select {r(_rank_sum("rated", "n_chars"), "auc")}"""

# ---- monitoring ---------------------------------------------------------------------------
ORACLES["model_monitor"] = f"""with scored as (
    select (n_chars % 1000) / 1000.0::double as risk_score, toxic as label
    from documents left join labels using (doc_id))
  select {METRICS} from scored"""
ORACLES["metrics_by_window"] = f"""with {SCORED}
  select epoch_us(time_bucket(interval 5 minutes, event_time)) as window_start, {METRICS}
  from scored group by window_start"""
ORACLES["auc_by_window"] = f"""with {SCORED}, days as (
    select epoch_us(date_trunc('day', event_time)) as "group", label, rank() over w as place,
           count(*) over (partition by date_trunc('day', event_time), risk_score) as ties
    from scored window w as (partition by date_trunc('day', event_time) order by risk_score))
  select "group", count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives,
         {r("""(sum(place + (ties - 1) / 2.0) filter (label = 1)
              - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0)
            / (count(*) filter (label = 1) * count(*) filter (label = 0))""", "auc")}
  from days group by "group\""""
ORACLES["risk_drift"] = f"""with {SCORED}, {DRIFT}
  select bin, {r("b", "baseline_share")}, {r("c", "current_share")},
         {r("(c - b) * ln(c / b)", "term")} from sides"""
ORACLES["alert_rules"] = f"""with {SCORED}, {DRIFT},
  early as (select * from scored where event_time < timestamp '{Q.HALF_TIME}'),
  late as (select * from scored where event_time >= timestamp '{Q.HALF_TIME}'),
  seen as (
    select 'false_positive_rate' as alert,
           (select count(*) filter (where label = 0 and risk_score >= {S.HIGH_RISK}) / count(*)
            from late) as value, {S.ALERT_FALSE_POSITIVE_RATE}::double as threshold
    union all
    select 'model_drift', (select sum((c - b) * ln(c / b)) from sides),
           {S.ALERT_DRIFT}::double
    union all
    select 'performance_degradation',
           {_rank_sum("early", "risk_score")} - {_rank_sum("late", "risk_score")},
           {S.ALERT_DEGRADATION}::double
  )
  select alert, {r("value", "value")}, threshold, value > threshold as fired from seen"""

# ---- feature store ------------------------------------------------------------------------
ORACLES["feature_store_write"] = ORACLES["session_features"]
ORACLES["feature_store_metadata"] = f"""
  select '{Q.VERSION}' as version, '2024-01-31T00:00:00' as "timestamp", 14 as feature_count,
         count(distinct user_id) as row_count
  from events"""
ORACLES["feature_store_latest"] = f"""with {FEATURES}
  select {_rounded(S.KEYSTROKE_FEATURES)}, '{Q.VERSION}' as version from kf"""
ORACLES["retention_versions"] = f"""
  select distinct strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%S') as version,
         date_trunc('hour', ts) >= timestamp '{Q.RETENTION_AS_OF}'
           - interval {S.RETENTION_DAYS} days as keep
  from events"""

# ---- streams ------------------------------------------------------------------------------
CLOSED = f"""{GAPS},
  closed as (
    select * from spans
    where last_event + interval 6 hours
          <= date_trunc('millisecond', (select max(ts) from events)) - interval 1 hour
  )"""
CLOSED_FEATURES = f"""{CLOSED},
members as (
  select ev.* replace (ev.session_id || '@' || epoch_us(session_start) as session_id)
  from ev join closed on ev.session_id = closed.session_id
   and event_time between session_start and last_event
){TIMED.removeprefix(EV).replace("from ev window", "from members window")},
closed_kf as (select session_id, {KEYS} from timed where lane = 'key' group by session_id),
closed_mf as (select session_id, {MOUSE} from timed where lane <> 'key' group by session_id),
closed_features as (
  select c.session_id, epoch_us(session_start) as session_start, epoch_us(last_event) as last_event, events,
         {_prefixed("keystroke_", S.KEYSTROKE_FEATURES)}, {_prefixed("mouse_", S.MOUSE_FEATURES, "movements >= 2")}
  from closed c left join closed_kf k on k.session_id = c.session_id || '@' || epoch_us(session_start)
  left join closed_mf m on m.session_id = c.session_id || '@' || epoch_us(session_start)
)"""
ORACLES["stream_state_features"] = f"""with {CLOSED_FEATURES}
  select {_rounded(S.SESSION_FEATURES[:11], "session_id, session_start, last_event, events")} from closed_features"""
ORACLES["stream_session_features"] = f"""with {CLOSED},
  members as (
    select ev.* replace (ev.session_id || '@' || epoch_us(session_start) as session_id),
           closed.session_id as plain_id, session_start
    from ev join closed on ev.session_id = closed.session_id
     and event_time between session_start and last_event
    where lane = 'key'
  ),
  paired as (
    select *, t - lag(t) over (partition by session_id order by t, pos) as dt,
           min(case when kind = 'keyup' then t end) over (
             partition by session_id, key_code order by t, pos
             rows between 1 following and unbounded following) - t as later_up
    from members
  ),
  timed as (
    select *, case when kind = 'keydown' then later_up end as hold,
           case when kind = 'keydown' and dt < {S.LONG_PAUSE_SECONDS} then dt end as interkey
    from paired
  ),
  kf as (select plain_id, session_start, {KEYS} from timed group by plain_id, session_start)
  select plain_id as session_id, epoch_us(session_start) as session_start,
         {", ".join(r(n, n) for n in S.KEYSTROKE_FEATURES)} from kf"""


BEHAVIOUR = S.SESSION_FEATURES[:11]


def _detector(train: str, scored: str) -> str:
    """Scores (id, raw_score) of the table `scored` by a detector of the table `train`: id and the features."""
    stats = ", ".join(f"avg({n}) as {n}_m, coalesce(nullif(stddev_pop({n}), 0), 1) as {n}_s" for n in BEHAVIOUR)
    scale = ", ".join(f"(coalesce({n}, 0) - {n}_m) / {n}_s as {n}" for n in BEHAVIOUR)
    filled = ", ".join(f"coalesce({n}, 0) as {n}" for n in BEHAVIOUR)
    return f"""(
    with stats as (select {stats} from (select {filled} from {train})), scaled_train as (select id, {scale} from {train}, stats),
    scaled_rows as (select id, {scale} from {scored}, stats), {forest_ctes(_cells("scaled_train", BEHAVIOUR), _cells("scaled_rows", BEHAVIOUR))}
    select * from forest_scores)"""


#: Sessions as the payloads' own clock closes them.
_PAYLOAD_CLOSED = (
    CLOSED_FEATURES.replace("ts as event_time", "make_timestamp(cast(round(epoch_us(ts) / 8e10 * 1e6) as bigint)) as event_time")
    .replace("interval 6 hours", "interval 270 milliseconds")
    .replace("(select max(ts) from events)) - interval 1 hour", "(select max(event_time) from ev)) - interval 45 milliseconds")
)
ORACLES["stream_scoring"] = f"""with train as (with {FEATURES} select session_id as id, {", ".join(BEHAVIOUR)} from features),
  closed_rows as (with {_PAYLOAD_CLOSED} select session_id || '@' || session_start as id, * from closed_features),
  judged as (select id, 1 - 1 / (1 + exp(-raw_score)) as risk_score from {_detector("train", "closed_rows")})
  select session_id, session_start, {r("risk_score", "risk_score")}, {r("abs(risk_score - 0.5) * 2", "confidence")}, '{Q.VERSION}' as model_version
  from judged join closed_rows using (id)"""


def _half(side: str) -> str:
    part = EV.replace("from events)", f"from events where ts {side} timestamp '{Q.HALF_TIME}')")
    return f"""(with {FEATURES.replace(EV, part)}
    select session_id as id, {", ".join(BEHAVIOUR)}, ('0x' || left(md5(session_id), 8))::bigint % 4 = 0 as unseen from features)"""


ORACLES["retrain_decision"] = f"""with {SCORED}, {DRIFT}, {DEVICES},
  early_rows as {_half("<")}, late_rows as {_half(">=")},
  old_train as (select * from early_rows where not unseen), new_train as (select * from late_rows where not unseen),
  asked as (select * from late_rows where unseen),
  old_rated as (select 1 - 1 / (1 + exp(-raw_score)) as risk_score, label from {_detector("old_train", "asked")} join users on session_id = id),
  new_rated as (select 1 - 1 / (1 + exp(-raw_score)) as risk_score, label from {_detector("new_train", "asked")} join users on session_id = id),
  areas as (select {_rank_sum("old_rated", "risk_score")} as old_area, {_rank_sum("new_rated", "risk_score")} as new_area,
            (select sum((c - b) * ln(c / b)) from sides) as drift)
  select '{Q.OLDER_VERSION}' as champion, '{Q.VERSION}' as challenger, {r("drift", "drift")}, {r("old_area", "champion_auc")},
         {r("new_area", "challenger_auc")}, new_area > old_area as promoted,
         case when new_area > old_area then '{Q.VERSION}' else '{Q.OLDER_VERSION}' end as in_use
  from areas"""
