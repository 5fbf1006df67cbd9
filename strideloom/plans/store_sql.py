"""What the store queries give, in SQL for DuckDB: what was written is what is read."""

from __future__ import annotations

from strideloom.plans.learned_sql import FORWARD
from strideloom.plans.sql import FEATURE_ROWS, KEYS, META, PREV, SIGNAL, SQL, STRIKES

# Indices of the joints among the 17 keypoints.
JOINTS = {"left_shoulder": 5, "right_shoulder": 6, "left_hip": 11, "right_hip": 12, "left_knee": 13, "right_knee": 14, "left_ankle": 15, "right_ankle": 16}
_points = ", ".join(f"round(embedding[{i + 1}]::double, 6) as {j}_x, round(embedding[{i + 18}]::double, 6) as {j}_y" for j, i in JOINTS.items())

STORE_SQL = {
    "read_strikes": f"with {STRIKES} select video, side, frame, strike_pattern, overstriding, u_frame::int as u_frame from strikes",
    "side_names": f"with {STRIKES} select case side when 'L' then 'left' else 'right' end as stored, side, count(*) as n from strikes group by side",
    "read_missing": f"with {STRIKES} select 0::bigint as before, count(*) as after from strikes",
    "read_frame_tables": f"""with {SIGNAL}, {FEATURE_ROWS}
select video, frame, side, round(ankle_y_vel, 6) as ankle_x_vel, round(hip_y, 6) as tibial_angle, round(ankle_y, 6) as shin_velocity, round(hip_y_vel, 6) as ankle_y_vel
from features where frame % 5 > 0 and ankle_y_vel is not null and hip_y_vel is not null""",
    "read_legacy_frames": SQL["legacy_store"],
    "legacy_round_trip": f"""with {SIGNAL}, least as (select video, frame, min(side) as side from signal group by 1, 2),
t as (select 'q"v\\' || s.video as video, frame::int as frame, 's''' || side as side, ankle_y, hip_y from signal s join least using (video, frame, side))
select video, frame, side, 'a"b' as name, case when frame % 5 > 0 then ankle_y end as value from t
union all select video, frame, side, 'é, [n]', hip_y from t""",
    "pose_ingest": f"""select label as video, vec_id as frame, (row_number() over (partition by label order by vec_id) - 1)::int as idx, {_points} from embeddings where vec_id % 7 > 0""",
    "video_paths": f"""with {SIGNAL}, {META} select video, case video % 3 when 0 then 'runs/' || video || '.MOV' when 1 then 'runs/' || video || '.mp4' end as path from meta""",
    "append_twice": f"with {STRIKES} select video, 2 * count(*) as n from strikes group by video",
    "replace_twice": f"with {STRIKES} select video, count(*) as n from strikes group by video",
    "overwrite_meta": f"with {SIGNAL}, {META} select * from meta where video % 2 = 0",
    "relabel_store": f"""with {KEYS}, r as (select video, frame, case side when 'L' then 'o' else 'n' end as label, event_id % 2 as run from keys where event_id % 7 = 0)
select video, frame, max_by(label, (run, label)) as label, count(*) as n from r group by 1, 2""",
    "lines_of_two_runs": f"with c as ({SQL['cadence']}) select * from c union all select * from c",
    "report_store": f"""with s as ({SQL['run_summary']}), c as ({SQL['cadence']}), o as ({SQL['mean_oscillation']}) select * from s join c using (video) left join o using (video)""",
    "video_store": f"with {SIGNAL}, {META} select video, fps::double as fps, frame_count, round(frame_count / fps, 6) as duration from meta",
    "weights_store": f"{FORWARD} select video, side, start_frame, t, label, logit from preds",
    "streamed_labels": f"with {STRIKES} select video, side, frame, strike_pattern, overstriding, u_frame from strikes",
}
for _name in ("read_strikes", "read_frame_tables", "read_legacy_frames", "pose_ingest", "relabel_store"):
    STORE_SQL[_name] = f"select * replace (frame::int as frame) from ({STORE_SQL[_name]})"
# stored videos are text
for _name in ("read_strikes", "read_frame_tables", "pose_ingest", "video_paths"):
    STORE_SQL[_name] = f"select * replace (video::varchar as video) from ({STORE_SQL[_name]})"
STORE_SQL |= {"split_frame_tables": STORE_SQL["read_frame_tables"], "split_legacy_frames": STORE_SQL["read_legacy_frames"]}
STORE_SQL |= {
    "event_time_strikes": SQL["blocked_strikes"], "event_time_cycles": SQL["gait_cycles"],
    "event_time_contacts": f"""with {PREV} select video, side, u_frame as lo, frame as hi, 0 as label from prev
union all select video, side, prev_frame, u_frame, 1 from prev where prev_frame is not null"""}
