"""Window functions over sessions and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import history as H
from . import derived as D
from .catalog import query
from .derived import stamp

TAIL = """
    WITH tail AS (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM msgs)
      WHERE back <= {n})
    """


@query("history_last8", TAIL.format(n=8) + "SELECT session_id, turn, role, content FROM tail",
       ("msgs",))
def history_last8(t):
    return H.last_n(D.msgs(t), 8).select("session_id", "turn", "role", "content")


@query("history_parity", TAIL.format(n=8) + """
    SELECT session_id, pos, CASE WHEN pos % 2 = 0 THEN '用户' ELSE '助手' END AS speaker,
           message_id FROM tail""", ("msgs",))
def history_parity(t):
    tail = H.speaker_by_position(H.last_n(D.msgs(t), 8))
    return tail.select("session_id", F.col("pos").cast("bigint").alias("pos"), "speaker", "message_id")


@query("history_transcript", TAIL.format(n=8) + """
    SELECT session_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': '
                                  || content, chr(10) ORDER BY pos) AS history
    FROM tail GROUP BY session_id""", ("msgs",))
def history_transcript(t):
    return H.transcripts(D.msgs(t))


GAPS = """
    WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
               FROM events),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 3600 SECONDS
                             THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    """


@query("history_sessions", GAPS + """
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n
    FROM s GROUP BY user_id, sid""")
def history_sessions(t):
    s = H.inactivity_sessions(t.events, "user_id", "ts")
    return s.select("user_id", stamp("session_start").alias("session_start"),
                    stamp("last_ts").alias("last_ts"), "n")


@query("history_live", GAPS + """
    SELECT user_id, event_id FROM (
      SELECT *, max(sid) OVER (PARTITION BY user_id) AS top,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s)
    WHERE sid = top AND back <= 16""")
def history_live(t):
    return H.live_history(t.events, "user_id", "ts", "event_id").select("user_id", "event_id")


@query("heading_path", r"""
    WITH h AS (SELECT * FROM md_lines),
    l AS (SELECT doc_id, pos, line,
            max(CASE WHEN lv = 1 THEN pos END) OVER w AS p1, max(CASE WHEN lv = 2 THEN pos END) OVER w AS p2,
            max(CASE WHEN lv = 3 THEN pos END) OVER w AS p3
          FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT l.doc_id, l.pos, l.line,
           coalesce(nullif(concat_ws(' > ', a.title,
             CASE WHEN l.p2 > coalesce(l.p1, -1) THEN b.title END,
             CASE WHEN l.p3 > greatest(coalesce(l.p1, -1), coalesce(l.p2, -1)) THEN c.title END), ''),
             '通用正文') AS path
    FROM l LEFT JOIN h a ON a.doc_id = l.doc_id AND a.pos = l.p1
           LEFT JOIN h b ON b.doc_id = l.doc_id AND b.pos = l.p2
           LEFT JOIN h c ON c.doc_id = l.doc_id AND c.pos = l.p3""", ("md_lines",))
def heading_path(t):
    return K.heading_path(D.md_lines(t))


@query("session_rollup", """
    SELECT session_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS updated_at,
           coalesce(substr(min_by(content, created_at) FILTER (WHERE role = 'user'), 1, 15),
                    '新对话') AS title
    FROM msgs GROUP BY session_id""", ("msgs",))
def session_rollup(t):
    return H.session_rollup(D.msgs(t)).withColumn("updated_at", stamp("updated_at"))


@query("session_title", "SELECT message_id, substr(content, 1, 15) AS title FROM msgs", ("msgs",))
def session_title(t):
    from ..functions.text import session_title as title

    return D.msgs(t).select("message_id", title(F.col("content")).alias("title"))


@query("assemble_answer", """
    SELECT stream_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type = 'content'), '')
             AS content,
           max_by(data, seq) FILTER (WHERE type = 'sources') AS sources
    FROM frames GROUP BY stream_id HAVING count(*) FILTER (WHERE type = 'done') > 0""", ("frames",))
def assemble_answer(t):
    return H.assemble_answers(D.frames(t))
