"""The sample tables as timed-media tables: the same SQL for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOK = {
    "spark": r"select conv_id, turn, role, pos, word from conversations lateral view posexplode(regexp_extract_all(text, '[^ \\n\\t\\r]+', 0)) t as pos, word",
    "duckdb": r"select conv_id, turn, role, generate_subscripts(l, 1) - 1 as pos, unnest(l) as word from (select *, regexp_extract_all(text, '[^ \n\t\r]+') l from conversations)",
}

VIEWS = {
    "words": """with tok as ({TOK}),
o as (select *, row_number() over (partition by conv_id order by turn, pos) - 1 as k,
  case when pos = 0 then ((conv_id * 7 + turn * 3) % 3) * 400 else 0 end + case when lag(word) over (partition by conv_id order by turn, pos) like '%,' then 400 else 0 end as gap from tok),
w as (select *, cast(k as bigint) * 400 + cast(sum(gap) over (partition by conv_id order by turn, pos rows between unbounded preceding and current row) as bigint) as start_ms from o)
select conv_id as video_id, turn as segment_id, cast(pos as bigint) as word_pos, cast(k as bigint) as word_idx, word, start_ms, start_ms + 350 as end_ms from w""",
    "segments": """select w.video_id, w.segment_id, min(w.start_ms) as start_ms, max(w.end_ms) as end_ms, max(c.text) as text,
  concat('Speaker ', chr(cast(65 + (w.video_id + w.segment_id * w.segment_id) % 3 as int))) as speaker
from words w join conversations c on c.conv_id = w.video_id and c.turn = w.segment_id group by w.video_id, w.segment_id""",
    "turns": "select video_id, segment_id as turn_idx, speaker, start_ms, end_ms from segments",
    "media": "select video_id, max(end_ms) + 5000 as duration_ms from segments group by video_id",
    "scenes": """with g as (select video_id, cast(floor(segment_id / 2) as bigint) as scene_idx, min(start_ms) as start_ms, max(end_ms) as end_ms from segments group by 1, 2)
select video_id, scene_idx, start_ms, coalesce(lead(start_ms) over (partition by video_id order by scene_idx), end_ms) as end_ms from g""",
    "audio_frames": """select video_id, word_idx as frame_idx, cast(-(10 + (cast(floor(word_idx / 3) as bigint) * 29 + video_id * 11) % 45 + length(word) % 3) as double) as rms_db,
  ((word_idx * 37 + video_id) % 100) / cast(100 as double) as flatness, ((word_idx * 13 + video_id) % 60) / cast(100 as double) as modulation from words""",
    "frames": """with o as (select *, o_custkey % 100 as video_id from orders),
f as (select *, cast(1000 * (row_number() over (partition by video_id order by o_orderdate, o_orderkey) - 1) as bigint) as t_ms from o)
select video_id, t_ms, o_orderkey as frame_key, (o_orderkey % 17) / cast(100 as double) as motion, (o_orderkey % 100) / cast(100 as double) as brightness,
  (o_orderkey % 61) / cast(100 as double) as sharpness, case when (o_orderkey % 7) < 2 then cast(0.02 as double) else cast(0.001 as double) end as caption_score from f""",
    "faces": """select f.video_id, f.t_ms, l.l_linenumber as face_no, l.l_partkey % 1700 as x, l.l_suppkey * 7 % 900 as y,
  cast(40 + l.l_quantity * 3 as bigint) as w, cast(40 + l.l_quantity * 3 as bigint) as h from frames f join lineitem l on l.l_orderkey = f.frame_key where l.l_discount > 0.04""",
    "candidates": """select doc_id % 50 as video_id, doc_id as candidate_id, (doc_id * 7919) % 120000 as start_ms,
  (doc_id * 7919) % 120000 + 20000 + (doc_id * 104729) % 40000 as end_ms, text, ((doc_id * 31) % 100) / cast(100 as double) as heuristic_score from documents""",
    "windows": "select video_id, candidate_id as window_id, start_ms, end_ms from candidates",
    "probes": "select video_id, candidate_id as probe_id, start_ms as t_ms from candidates",
    "evaluations": """select doc_id as candidate_id, quality = 1 as recommended, ((doc_id * 53) % 100) / cast(100 as double) as quality_score,
  case when toxic = 1 then 'high' when doc_id % 2 = 0 then 'low' else 'medium' end as context_dependency, doc_id % 5 <> 0 as complete_thought from labels""",
    "jobs": """select o_custkey as project_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as bigint) as position,
  o_orderpriority as type, case o_orderstatus when 'F' then 'completed' when 'P' then 'running' when 'O' then case when o_orderkey % 4 = 0 then 'skipped' else 'pending' end end as status,
  (o_orderkey % 100) / cast(100 as double) as progress, o_orderdate as started_at, o_orderkey as job_key from orders""",
    "feedback": """select event_id, ts, user_id as project_id, case event_type when 'click' then 'clip_selected' when 'view' then 'clip_rejected' when 'purchase' then 'clip_downloaded' when 'signup' then 'boundary_adjusted' else 'unknown' end as event, value, props as payload from events""",
    "segment_embeddings": "select vec_id % 10 as video_id, cast(floor(vec_id / 10) as bigint) as segment_id, embedding, label from embeddings",
    # sentence starts, punctuated and other ends, pauses: the points that boundaries snap to
    "marked": r"""select *, regexp_like(word, '[.!?]["'')\]]*$') as ends from (select w.*, lead(start_ms) over (partition by video_id, segment_id order by word_idx) as next_start from words w) x""",
    "seg_ctx": r"""select *, lag(end_ms) over (partition by video_id order by segment_id) as prev_end, regexp_like(trim(coalesce(lag(text) over (partition by video_id order by segment_id), '')), '[.!?]["'')\]]*$') as prev_done from segments""",
    "starts": "select distinct video_id, point from (select video_id, start_ms as point from seg_ctx where prev_end is null or prev_done or start_ms - prev_end >= 600 union all select video_id, next_start from marked where ends and next_start is not null) x",
    "punctuated": "select distinct video_id, end_ms as point from marked where ends",
    "ends": "select distinct video_id, point from (select video_id, end_ms as point from marked where ends or next_start is null) x",
    "pauses": "select video_id, cast(end_ms + least((nxt - end_ms) / 2, 400) as bigint) as point from (select *, lead(start_ms) over (partition by video_id order by start_ms, word_idx) as nxt from words) x where nxt - end_ms >= 350",
    "loudness": "select a.video_id, a.frame_idx, a.rms_db, a.flatness, a.modulation, m.median_db, m.top_db from audio_frames a join (select video_id, max(rms_db) as top_db, {MEDIAN} as median_db from audio_frames group by video_id) m on m.video_id = a.video_id",
    "silences": "select video_id, min(frame_idx) * 400 as start_ms, (max(frame_idx) + 1) * 400 as end_ms from (select *, frame_idx - row_number() over (partition by video_id order by frame_idx) as island from loudness where rms_db < median_db - 22) x group by video_id, island having count(*) * 400 >= 450",
}
_MEDIAN = {"spark": "percentile(rms_db, 0.5)", "duckdb": "quantile_cont(rms_db, 0.5)"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(text: str) -> list[str]:
    """The views that a text names, those they need first."""
    out: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def _fill(sql: str, engine: str) -> str:
    sql = sql.replace("{TOK}", _TOK[engine]).replace("{MEDIAN}", _MEDIAN[engine])
    if engine == "duckdb":
        sql = sql.replace("regexp_like(", "regexp_matches(")
    else:
        sql = sql.replace(r"""'[.!?]["'')\]]*$'""", r"""'[.!?]["\')\\]]*$'""")
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a sample table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for t in TABLES:
        if any(re.search(rf"\b{t}\b", _fill(VIEWS[v], "spark")) for v in [*_needs(sql), name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in _needs(sql):
        spark.sql(_fill(VIEWS[v], "spark")).createOrReplaceTempView(v)
    return spark.sql(_fill(sql, "spark"))


def duckdb(sql: str) -> str:
    """sql for DuckDB with the views it names in front."""
    names = _needs(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} as ({_fill(VIEWS[n], 'duckdb')})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    return f"with {head},\n{body[5:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
