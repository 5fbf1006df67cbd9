"""The queries in SQL for DuckDB."""

from __future__ import annotations

from strideloom.operators.signal import WIDTH, savgol_weights

W = "(partition by video, side order by frame)"
BEFORE = "(partition by video, side order by frame rows between unbounded preceding and 1 preceding)"

SIGNAL = """signal as (
  select cast(floor(user_id / 2) as bigint) as video, case when user_id % 2 = 0 then 'L' else 'R' end as side,
         row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
         value as ankle_y, cast((event_id * 37) % 101 as double) as hip_y, event_id, event_type
  from events)"""
KEYS = SIGNAL + """,
keys as (
  select video, side, frame, event_id, case event_type when 'view' then 'u' when 'purchase' then 'd' end as key,
         case event_id % 5 when 0 then 'h' when 3 then 'h' when 1 then 'm' when 2 then 'f' else 's' end as strike_key,
         case event_id % 3 when 0 then 'o' when 1 then 'n' else 's' end as overstride_key
  from signal)"""
STRIKES = KEYS + f""",
marks as (
  select *, max(case when key = 'u' then frame end) over {BEFORE} as last_u, max(case when key = 'd' then frame end) over {BEFORE} as last_d from keys),
strikes as (
  select video, side, frame, case strike_key when 'h' then 'heel' when 'm' then 'midfoot' else 'forefoot' end as strike_pattern,
         case overstride_key when 'o' then 'overstriding' when 'n' then 'neutral' else 'skip' end as overstriding,
         case when last_u > coalesce(last_d, -1) then last_u end as u_frame
  from marks where key = 'd' and strike_key in ('h', 'm', 'f'))"""
PREV = STRIKES + """,
prev as (
  select *, max(frame) over (partition by video, side order by frame range between unbounded preceding and 1 preceding) as prev_frame
  from strikes where u_frame is not null)"""
CYCLES = PREV + """,
cycles as (
  select video, side, prev_frame as start_frame, u_frame, frame - 1 as end_frame
  from prev where prev_frame is not null and frame - 1 - prev_frame between 7 and 39)"""
CONTACT = PREV + """,
numbered as (select *, row_number() over (partition by video, side order by frame) as n from prev),
spans as (
  select video, side, u_frame as lo, frame as hi, 0 as label, 2 * n as seq from numbered
  union all
  select video, side, prev_frame, u_frame, 1, 2 * n + 1 from numbered where prev_frame is not null),
contact as (
  select f.video, f.side, f.frame, cast(arg_max(s.label, s.seq) as int) as label
  from (select distinct video, side, frame from signal) f
  left join spans s on f.video = s.video and f.side = s.side and f.frame >= s.lo and f.frame < s.hi
  group by 1, 2, 3)"""


def gradient(c: str) -> str:
    a, b = f"lag({c}) over {W}", f"lead({c}) over {W}"
    return f"case when {a} is null then {b} - {c} when {b} is null then {c} - {a} else ({b} - {a}) / 2 end"


FEATURES = ["ankle_y", "hip_y", "ankle_y_vel", "hip_y_vel"]
FEATURE_ROWS = f"""features as (
  select video, side, frame, ankle_y, hip_y, {gradient('ankle_y')} as ankle_y_vel, {gradient('hip_y')} as hip_y_vel from signal)"""
SCALED = FEATURE_ROWS + """,
stats as (select """ + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in FEATURES) + """ from features),
scaled as (select video, side, frame, """ + ", ".join(f"case when s_{c} = 0 then 0.0 else ({c} - m_{c}) / s_{c} end as {c}" for c in FEATURES) + """ from features, stats)"""


def lagged(c: str, n: int) -> str:
    return f"coalesce(lag({c}, {n}) over {W}, first_value({c}) over {W})"


_points = ", ".join(f"embedding[{4 * i + 2 * s + 1}]::double as {side}_{j}_x, embedding[{4 * i + 2 * s + 2}]::double as {side}_{j}_y" for i, j in enumerate(("shoulder", "hip", "knee", "ankle")) for s, side in enumerate("lr"))
_side = lambda s, name: f"select video, '{name}' as side, frame, " + ", ".join(f"{s}_{j}_{c} as {j}_{c}" for j in ("shoulder", "hip", "knee", "ankle") for c in "xy") + " from pose"
KINEMATICS = f"""pose as (
  select label::bigint as video, row_number() over (partition by label order by vec_id) - 1 as frame, {_points} from embeddings),
sides as ({_side('l', 'L')} union all {_side('r', 'R')}),
moves as (
  select *, {gradient('ankle_x')} as ankle_x_vel, {gradient('ankle_y')} as ankle_y_vel, {gradient('(knee_x - ankle_x)')} as shin_velocity,
         atan2({lagged('ankle_y', 1)} - {lagged('ankle_y', 3)}, {lagged('ankle_x', 1)} - {lagged('ankle_x', 3)}) as ankle_approach_angle,
         row_number() over {W} - 1 as idx, count(*) over (partition by video, side) as n
  from sides),
kin as (
  select *, {lagged('ankle_y_vel', 2)} as ankle_velocity_pre_strike,
         pi() / 2 - atan2(knee_y - ankle_y, knee_x - ankle_x) as tibial_angle, pi() / 2 - atan2(ankle_y - knee_y, ankle_x - knee_x) as tibial_angle_down,
         (degrees(atan2(ankle_y - knee_y, ankle_x - knee_x) - atan2(hip_y - knee_y, hip_x - knee_x)) % 360 + 360) % 360 as knee_flexion_angle,
         abs(ankle_x - hip_x) as ankle_hip_horizontal_offset, degrees(pi() / 2 - atan2(shoulder_y - hip_y, shoulder_x - hip_x)) as trunk_angle
  from moves)"""
METRICS = ["ankle_x_vel", "ankle_y_vel", "shin_velocity", "tibial_angle", "knee_flexion_angle", "ankle_hip_horizontal_offset", "trunk_angle", "ankle_velocity_pre_strike", "ankle_approach_angle"]
_r = lambda cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)


def peaks(source: str, name: str, col: str, distance: int) -> str:
    return f"""{name}_flags as (select *, case when lag({col}) over {W} <> {col} then 1 else 0 end as fresh from {source}),
{name}_ids as (select *, sum(fresh) over {W} as run from {name}_flags),
{name}_runs as (select video, side, run, min(frame) as a, max(frame) as b, min({col}) as v from {name}_ids group by 1, 2, 3),
{name}_tops as (
  select *, lag(v) over (partition by video, side order by run) as v0, lead(v) over (partition by video, side order by run) as v1 from {name}_runs),
{name} as (
  select video, side, unnest(list_reduce(list([p] order by v desc, p desc), lambda acc, c: case when len(list_filter(acc, lambda a: abs(a - c[1]) < {distance})) > 0 then acc else list_concat(acc, c) end, []::bigint[])) as frame
  from (select video, side, v, (a + b) // 2 as p from {name}_tops where v > v0 and v > v1) group by video, side)"""


def savgol(source: str, name: str, col: str, out: str, more: str = "") -> str:
    h, half = savgol_weights(), WIDTH // 2
    terms = []
    for d in range(1 - WIDTH, WIDTH):
        case = " ".join(f"when {p} then {float(h[p, p + d])!r}::double" for p in range(WIDTH) if 0 <= p + d < WIDTH)
        if case:
            y = col if d == 0 else f"{'lead' if d > 0 else 'lag'}({col}, {abs(d)}) over {W}"
            terms.append(f"coalesce(case place {case} end * {y}, 0.0)")
    return f"""{name}_counted as (select *, row_number() over {W} - 1 as i, count(*) over (partition by video, side) as size from {source}),
{name}_placed as (select *, case when i < {half} then i when i >= size - {half} then i - size + {WIDTH} else {half} end as place from {name}_counted),
{name} as (select video, side, frame{more}, {' + '.join(terms)} as {out} from {name}_placed)"""


SMOOTH = f"{SIGNAL},\n{savgol('signal', 'smooth_ankle', 'ankle_y', 'raw')},\nsmoothed as (select video, side, frame, round(raw, 6) as smooth from smooth_ankle)"
PEAKS = f"{SMOOTH},\n{peaks('smoothed', 'tops', 'smooth', 14)}"
META = "meta as (select video, 30 as fps, max(frame) + 1 as frame_count from signal group by 1)"
OSCILLATION = PEAKS + f""",
{savgol('signal', 'smooth_hip', 'hip_y', 'hip')},
pairs as (select *, lead(frame) over (partition by video, side order by frame) as next_frame from tops),
ranges as (
  select p.video, p.side, p.frame, max(s.hip) - min(s.hip) as span
  from pairs p join smooth_hip s on s.video = p.video and s.side = p.side and s.frame between p.frame and p.next_frame group by 1, 2, 3),
vo as (
  select t.video, t.side, count(*) as peaks, coalesce(sum(r.span), 0.0) / count(*) as vo, sum(r.span) / count(r.span) as vo_per_pair
  from tops t left join ranges r using (video, side, frame) group by 1, 2)"""
LOGITS = CONTACT + """,
logits as (
  select s.video, s.side, s.frame, (s.ankle_y - 50) / 25 as logit, 1 / (1 + exp(-((s.ankle_y - 50) / 25))) as probability, c.label, c.label is not null as mask
  from signal s join contact c using (video, side, frame)),
preds as (select *, case when probability > 0.35 then 1 else 0 end as pred from logits)"""
BALANCE = LOGITS + """,
balance as (
  select count(*) filter (label = 0) as negatives, count(*) filter (label = 1) as positives,
         case when count(*) filter (label = 1) > 0 then (count(*) filter (label = 0)) / (count(*) filter (label = 1)) end as pos_weight
  from preds where mask)"""

SQL = {
    "label_fsm": f"with {STRIKES} select * from strikes",
    "legacy_cycles": f"""with {KEYS},
g as (select *, coalesce(sum(case when key = 'd' then 1 else 0 end) over {BEFORE}, 0) as grp from keys where key in ('u', 'd'))
select video, side, max(frame) filter (key = 'u') as u_frame, max(frame) filter (key = 'd') as frame from g
group by video, side, grp having count(*) filter (key = 'u') = 1 and count(*) filter (key = 'd') > 0""",
    "prev_strike": f"with {PREV} select video, side, frame, u_frame, prev_frame from prev",
    "gait_cycles": f"with {CYCLES} select * from cycles",
    "contact_labels": f"with {CONTACT} select * from contact",
    "cycle_slices": f"""with {CYCLES}
select s.video, s.side, s.frame, s.ankle_y, s.hip_y, c.start_frame, c.u_frame, c.end_frame from signal s
join cycles c on s.video = c.video and s.side = c.side and s.frame between c.start_frame and c.end_frame""",
    "zscore_frames": f"with {SIGNAL}, {SCALED} select video, side, frame, {_r(FEATURES)} from scaled",
    "cycle_tensor": f"""with {CONTACT}, {SCALED},
cycles as (select video, side, prev_frame as start_frame, frame - 1 as end_frame from prev where prev_frame is not null and frame - 1 - prev_frame between 7 and 39),
rows_ as (
  select c.video, c.side, c.start_frame, 40 - count(*) over (partition by c.video, c.side, c.start_frame)
         + row_number() over (partition by c.video, c.side, c.start_frame order by s.frame) - 1 as t, {', '.join(f's.{c}' for c in FEATURES)}, k.label
  from cycles c join scaled s on s.video = c.video and s.side = c.side and s.frame between c.start_frame and c.end_frame
  join contact k on k.video = s.video and k.side = s.side and k.frame = s.frame),
grid as (select video, side, start_frame, unnest(range(40)) as t from cycles)
select g.video, g.side, g.start_frame, g.t::int as t, {', '.join(f'coalesce(round(r.{c}, 6), 0.0) as {c}' for c in FEATURES)}, coalesce(r.label, -1)::int as label, r.t is not null as mask
from grid g left join rows_ r using (video, side, start_frame, t)""",
    "relabel_apply": f"""with {STRIKES},
new as (select video, frame, arg_max(case when event_id % 2 = 0 then 'overstriding' else 'neutral' end, event_id) as label from keys where event_id % 7 = 0 group by 1, 2)
select s.video, s.side, s.frame, s.strike_pattern, coalesce(n.label, s.overstriding) as overstriding, s.u_frame from strikes s left join new n using (video, frame)""",
    "legacy_store": f"""with {KEYS}, {FEATURE_ROWS},
g as (select *, coalesce(sum(case when key = 'd' then 1 else 0 end) over {BEFORE}, 0) as grp from keys where key in ('u', 'd')),
c as (select video, side, max(frame) filter (key = 'd') as frame from g group by video, side, grp having count(*) filter (key = 'u') = 1 and count(*) filter (key = 'd') > 0),
o as (select video, frame, min(side) as side from c group by 1, 2)
select video, frame, side, name, round(value, 6) as value from (
""" + " union all ".join(f"select video, frame, side, '{c}' as name, {c} as value from features join o using (video, frame, side)" for c in FEATURES) + ")",
    "frame_kinematics": f"with {KINEMATICS} select video, side, frame, {_r([*METRICS, 'tibial_angle_down'])} from kin",
    "gradient": f"with {SIGNAL}, {FEATURE_ROWS} select video, side, frame, ankle_y_vel, hip_y_vel from features",
    "strike_features": f"with {STRIKES}, {KINEMATICS} select s.*, {_r(METRICS)} from strikes s join kin using (video, side, frame)",
    "strike_features_clamped": f"""with {STRIKES}, {KINEMATICS}, last as (select video, side, max(idx) as last from kin group by 1, 2)
select s.video, s.side, s.frame, k.idx as frame_idx, {_r(METRICS)} from strikes s join last using (video, side)
join kin k on k.video = s.video and k.side = s.side and k.idx = least(s.frame, last.last)""",
    "legacy_strike_features": f"""with {KINEMATICS}, {savgol('kin', 'lowest', 'ankle_y', 'raw', ', idx, tibial_angle_down, knee_flexion_angle, ankle_hip_horizontal_offset, trunk_angle, ankle_approach_angle')},
lows as (select video, side, frame, round(raw, 6) as smooth from lowest), {peaks('lows', 'found', 'smooth', 14)},
speeds as (select *, {gradient('raw')} as vel from lowest), earlier as (select *, lag(vel, 2) over {W} as ankle_velocity_pre_strike from speeds)
select video, side, frame, round(tibial_angle_down, 6) as tibial_angle, {_r(['knee_flexion_angle', 'ankle_hip_horizontal_offset', 'trunk_angle'])},
       round(case when idx >= 3 then ankle_velocity_pre_strike end, 6) as ankle_velocity_pre_strike, round(case when idx >= 3 then ankle_approach_angle end, 6) as ankle_approach_angle
from found join earlier using (video, side, frame)""",
    "savgol_smooth": f"with {SMOOTH} select * from smoothed",
    "ankle_peaks": f"with {PEAKS} select * from tops",
    "peak_pairs": f"with {PEAKS} select * from (select *, lead(frame) over (partition by video, side order by frame) as next_frame from tops) where next_frame is not null",
    "video_meta": f"with {SIGNAL}, {META} select *, round(frame_count / fps, 6) as duration from meta",
    "cadence": f"""with {PEAKS}, {META}, n as (select video, count(*) as steps from tops group by 1)
select video, coalesce(steps, 0) as steps, round(coalesce(steps, 0) / (frame_count / fps), 6) as steps_per_sec, round(coalesce(steps, 0) / (frame_count / fps) * 60, 6) as steps_per_min
from meta left join n using (video)""",
    "vertical_oscillation": f"with {OSCILLATION} select video, side, peaks, {_r(['vo', 'vo_per_pair'])} from vo",
    "mean_oscillation": f"with {OSCILLATION} select video, round((max(case when side = 'L' then vo end) + max(case when side = 'R' then vo end)) / 2, 6) as vo from vo group by video",
    "run_summary": f"""with {STRIKES} select video, count(*) as strikes, count(*) filter (strike_pattern = 'heel') as heel, count(*) filter (strike_pattern = 'midfoot') as midfoot,
       count(*) filter (strike_pattern = 'forefoot') as forefoot, round(avg(case when overstriding <> 'skip' then (overstriding = 'overstriding')::int end), 6) as overstriding_rate
from strikes group by video""",
    "frames_by_video": f"with {STRIKES} select video, string_agg(frame::varchar, ',' order by k.event_id) as frames from strikes join keys k using (video, side, frame) group by video",
    "sorted_frames": f"with {STRIKES} select video, string_agg(frame::varchar, ',' order by frame) as frames from (select distinct video, frame from strikes) group by video",
    "mean_oscillation_cm": f"with {OSCILLATION} select video, round((max(case when side = 'L' then vo end) + max(case when side = 'R' then vo end)) / 2 * 170 / 101, 6) as vo_cm from vo group by video",
    "strike_window_resampled": f"""with {STRIKES},
w as (select s.video, s.side, s.frame as strike_frame, list(f.ankle_y order by f.frame) as a, list(f.hip_y order by f.frame) as h, count(*) as n
      from strikes s join signal f on f.video = s.video and f.side = s.side and f.frame between s.frame - 8 and s.frame + 3 group by 1, 2, 3),
g as (select *, t * (n - 1) / 11.0::double as x from (select *, unnest(range(12)) as t from w)),
i as (select *, floor(x)::bigint as lo, least(floor(x)::bigint + 1, n - 1) as hi from g)
select video, side, strike_frame, t::int as t, round(a[lo + 1] + (x - lo) * (a[hi + 1] - a[lo + 1]), 6) as ankle_y, round(h[lo + 1] + (x - lo) * (h[hi + 1] - h[lo + 1]), 6) as hip_y from i""",
    "video_counts": f"""with {STRIKES}, f as (select video, count(*) as frames from signal group by 1), s as (select video, count(*) as strikes from strikes group by 1)
select video, frames, coalesce(strikes, 0) as strikes from f left join s using (video)""",
    "strike_window": f"""with {STRIKES} select s.video, s.side, s.frame as strike_frame, (f.frame - s.frame)::int as step, f.ankle_y, f.hip_y
from strikes s join signal f on f.video = s.video and f.side = s.side and f.frame between s.frame - 8 and s.frame + 3""",
    "strike_union": f"with {STRIKES} select * from strikes where side = 'L' union all select * from strikes where side = 'R'",
    "strike_frames": f"with {STRIKES} select video, frame from strikes where side = 'L' union select video, frame from strikes where side = 'R'",
    "strike_order": f"""with {STRIKES}, k as (select s.*, k.event_id from strikes s join keys k using (video, side, frame))
select video, side, frame, min(event_id) over (partition by video) as video_ord from k""",
    "distinct_videos": f"with {STRIKES} select distinct video from strikes",
    "train_split": f"with {STRIKES} select * from strikes where video not in (3, 9, 13, 15)",
    "test_split": f"with {STRIKES} select * from strikes where video in (3, 9, 13, 15)",
    "legacy_train_split": f"with {STRIKES} select * from strikes where video not in (4, 18, 20, 26, 27)",
    "legacy_test_split": f"with {STRIKES} select * from strikes where video in (4, 18, 20, 26, 27)",
    "shuffled_strikes": f"with {STRIKES} select * from strikes",
    "strikes_head": f"with {STRIKES} select * from strikes order by video, side, frame limit 5",
    "contact_predictions": f"with {LOGITS} select video, side, frame, round(probability, 6) as probability, pred::bigint as pred from preds",
    "class_balance": f"with {BALANCE} select negatives, positives, round(pos_weight, 6) as pos_weight from balance",
    "masked_bce": f"""with {BALANCE} select video, round(sum(case when mask then (1 - label) * logit + (1 + (pos_weight - 1) * label) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0.0)) end)
       / count(*) filter (mask), 6) as loss from preds, balance group by video""",
    "classification_report": f"""with {LOGITS},
m as (select label, pred from preds where mask),
c as (select distinct unnest([label, pred]) as class from m),
p as (select class, count(*) filter (label = class and pred = class) as tp, count(*) filter (pred = class) as named, count(*) filter (label = class) as support from c, m group by 1),
q as (select *, case when named = 0 then 0.0 else tp / named end as precision, case when support = 0 then 0.0 else tp / support end as recall from p),
r as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from q),
u as (
  select class::varchar as class, precision, recall, f1, support from r
  union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from r
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from r
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from r)
select class, {_r(['precision', 'recall', 'f1'])}, support::bigint as support from u""",
}
SQL |= {
    name: f"with {KINEMATICS} select video, side, frame, round({col}, 6) as {col} from kin"
    for name, col in {
        "tibial_a": "tibial_angle", "tibial_b": "tibial_angle_down", "knee_flexion": "knee_flexion_angle", "trunk_angle": "trunk_angle",
        "approach_angle": "ankle_approach_angle", "ankle_hip_offset": "ankle_hip_horizontal_offset", "pre_strike_velocity": "ankle_velocity_pre_strike"}.items()}
SQL |= {
    "blocked_kinematics": SQL["frame_kinematics"], "blocked_smooth": SQL["savgol_smooth"], "blocked_peaks": SQL["ankle_peaks"], "blocked_legacy_cycles": SQL["legacy_cycles"],
    "blocked_contact_labels": SQL["contact_labels"], "blocked_strikes": f"with {PREV} select video, side, frame, strike_pattern, overstriding, u_frame, prev_frame from prev"}
_start = (7 * 7919 + 3 * 104729) % 2147483647
SQL |= {
    "duration_limits": f"""with {PREV}, c as (select side, frame - 1 - prev_frame as duration from prev where prev_frame is not null),
q as (select side, count(*) as cycles, quantile_disc(duration, 0.25) as q1, quantile_disc(duration, 0.75) as q3 from c group by 1)
select side, cycles, q1, q3, greatest(1.0, q1 - 1.5 * (q3 - q1))::double as shortest, (q3 + 1.5 * (q3 - q1))::double as longest from q""",
    "epoch_batches": f"""with recursive {CYCLES},
numbered_cycles as (select *, row_number() over (order by (video * 31 + start_frame) % 16, video, side, start_frame) - 1 as id, count(*) over () as n from cycles),
walk as (
  select id, n, id as x, 0::bigint as r from numbered_cycles
  union all
  select id, n, case when (h * h + 12345 * (r + 1)) % 2147483647 // 1024 % 2 = 1 then other else x end, r + 1
  from (select *, (greatest(x, other) * 48271 + r * 69621 + {_start}) % 2147483647 as h
        from (select *, (((r * 48271 + {_start}) * 16807) % 2147483647 + n - x) % n as other from walk where r < 48)))
select video, side, start_frame, u_frame, end_frame, x // 32 as batch, x % 32 as place from numbered_cycles join walk using (id) where r = 48"""}
SQL["referenced_metrics"] = f"""with c as ({SQL['cadence']}), o as ({SQL['mean_oscillation_cm']}), t as (select video, steps_per_min, vo_cm from c left join o using (video))
select video, 'steps_per_min' as metric, steps_per_min as value, null::double as low, null::double as high, null::varchar as standing from t
union all select video, 'vertical_oscillation_cm', vo_cm, 6.0::double, 13.0::double, case when vo_cm < 6 then 'below' when vo_cm > 13 then 'above' when vo_cm is not null then 'within' end from t"""
