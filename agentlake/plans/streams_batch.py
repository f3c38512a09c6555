"""Queries: streamed responses — error signatures, stitching, reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions.classify import has_error_signature
from agentlake.operators import streams as ST
from agentlake.plans.registry import query
from agentlake.sources.chunks import chunks

_STREAMS = """
WITH a AS (SELECT conv_id * 10 + turn AS stream_id, conv_id, text, string_split(text, ' ') AS toks
           FROM conversations WHERE role = 'assistant'),
pb AS (SELECT conv_id, CAST(strlen(text) AS BIGINT) AS prompt_bytes FROM conversations WHERE turn = 0),
s AS (SELECT a.*, coalesce(pb.prompt_bytes, 0) AS prompt_bytes, len(toks) AS n,
             (stream_id % 11 = 0 AND len(toks) >= 2) AS err, stream_id % 2 = 0 AS even
      FROM a LEFT JOIN pb USING (conv_id)),
p AS (SELECT stream_id, even, unnest(toks) AS tok, unnest(range(1, n + 1)) AS i, n FROM s),
pd AS (SELECT *, CASE WHEN i < n THEN tok || ' ' ELSE tok END AS piece FROM p),
bytes AS (SELECT stream_id,
                 sum(strlen(CASE WHEN even THEN '{"choices":[{"delta":{"content":"' || replace(piece, chr(10), '\\n') || '"}}]}'
                                 ELSE '{"delta":{"text":"' || replace(piece, chr(10), '\\n') || '"}}' END) + 1) AS b
          FROM pd GROUP BY stream_id)
"""


@query("error_signature", sql=_STREAMS + """
SELECT stream_id, count(*) FILTER (WHERE err) AS error_chunks FROM s GROUP BY stream_id
""")
def error_signature(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.groupBy("stream_id").agg(F.count_if(has_error_signature(F.col("data"))).alias("error_chunks"))


@query("stitch_streams", sql=_STREAMS + """
SELECT stream_id,
       CASE WHEN even <> err THEN 'openai' ELSE 'anthropic' END AS executed_provider,
       err AS is_hot_swapped,
       n + CASE WHEN even THEN 1 ELSE 0 END + 1 AS forwarded_chunks
FROM s
""")
def stitch_streams(spark, sf_dir):
    return ST.stitch_summary(ST.stitch(chunks(spark, sf_dir)))


@query("reassemble_stream", sql=_STREAMS + """
SELECT s.stream_id, s.text,
       CAST(CASE WHEN even THEN n + 10
                 ELSE greatest(1, prompt_bytes // 4) + greatest(1, b.b // 4) END AS BIGINT) AS total_tokens
FROM s JOIN bytes b USING (stream_id)
""")
def reassemble_stream(spark, sf_dir):
    return ST.reassemble(ST.stitch(chunks(spark, sf_dir)))
