r"""Chat formatting in budgeted windows, with DataFrame functions alone.

Each conversation becomes windows of whole turns. The prefix sums of the turns' tokens choose the spans: turn i goes to
bucket ``sum of the tokens before it // quota``, a new bucket starts a window, and a turn above the quota has a window of
its own. Each window after the first repeats the system turn and up to `history_turns`
turns before it; only new assistant texts are under the loss mask, so each is learnt once.

With s tokens in the system turn, history may take h = `history_tokens` or a quarter of ``budget - s``, whichever is less, and the quota is half of
``budget - s - h``. The turns of a bucket, but for its last, have less than the quota together, and the last has the quota at most, so a window of them never
exceeds the budget. A turn above the quota has as much history as still fits; its window exceeds the budget, and is flagged, only where the
turn and the system turn alone do. Every count is that of `tokens`, for new turns, history and system turn alike.

A turn reads ``<|im_start|>role\ntext<|im_end|>\n``. Within texts ``<`` + backslashes + ``|`` gets one more backslash, so no
text holds a control string and the way back is exact; roles also percent-encode ``%``, ``<`` and newline.

Defined cases: null texts and roles count as empty; null turns sort first; rows with the same turn are ordered by role, then
text, and repeated rows are turns like any other; a null conv_id is a conversation; a conversation of a system turn
alone is one window; an empty table gives no window; other columns are ignored. A conversation is one sort group,
since its order is what is computed, but only a window's rows are gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def token_estimate(text: Column) -> Column:
    """Four code points a token, and four tokens of template."""
    return F.floor((F.length(text) + 3) / 4).cast("long") + 4


def chat_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 256, history_turns: int = 2, tokens=token_estimate) -> DataFrame:
    """(conv_id, window_no, formatted, loss_spans, n_context, n_turns, tokens, over_budget), a row for each window.

    loss_spans: array of (start, length) in code points, start from 1. n_context: leading turns that repeat others.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", F.length(head).alias("head"), F.concat(head, escape(F.col("text")), F.lit(f"{END}\n")).alias("piece"), tokens(F.col("text")).alias("tok"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("idx", F.row_number().over(order))
    rows = rows.withColumn("is_sys", (F.col("idx") == 1) & (F.col("role") == "system"))
    rows = rows.withColumns({
        "sys": F.first(F.when(F.col("is_sys"), F.struct("piece", "tok"))).over(order),
        "cum": F.coalesce(F.sum(F.when(F.col("is_sys"), 0).otherwise(F.col("tok"))).over(before), F.lit(0)),
        "at": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)),
    } | {f"h{k}": F.lag(F.struct("piece", "tok", "is_sys"), k).over(order) for k in range(1, history_turns + 1)})
    sys_tok = F.coalesce(F.col("sys.tok"), F.lit(0))
    rows = rows.withColumn("room", F.lit(budget) - sys_tok)
    rows = rows.withColumn("cap", F.least(F.lit(history_tokens), F.greatest(F.lit(0), F.floor(F.col("room") / 4))).cast("long"))
    rows = rows.withColumn("quota", F.greatest(F.lit(1), F.floor((F.col("room") - F.col("cap")) / 2)).cast("long"))
    rows = rows.withColumn("bucket", F.floor(F.col("cum") / F.col("quota"))).withColumn("long", F.col("tok") > F.col("quota"))
    rows = rows.withColumn("cap", F.when(F.col("long"), F.least("cap", F.col("room") - F.col("tok"))).otherwise(F.col("cap")))
    fresh = (F.col("bucket") != F.lag("bucket").over(order)) | F.col("long") | F.lag("long").over(order)
    after_sys = F.lag("is_sys").over(order)
    rows = rows.withColumn("fresh", F.when(F.col("idx") == 1, True).when(after_sys, False).otherwise(fresh))
    rows = rows.withColumn("window_no", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # History: the nearest turns first, as long as all of them fit.
    fits, total, history = F.lit(True), F.lit(0).cast("long"), []
    for k in range(1, history_turns + 1):
        h = F.col(f"h{k}")
        total = total + h["tok"]
        fits = fits & F.coalesce(~h["is_sys"] & (total <= F.col("cap")), F.lit(False))
        history.insert(0, F.when(fits, F.struct(h["piece"].alias("piece"), h["tok"].alias("tok"))))
    rows = rows.withColumn("history", F.array_compact(F.array(*history) if history else F.array().cast("array<struct<piece: string, tok: bigint>>")))
    windows = rows.groupBy("conv_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("idx", "role", "head", "at", "piece", F.length(F.expr(r"substr(piece, head + 1)")).alias("rest")))).alias("new"),
        F.min_by("history", "idx").alias("history"), F.first("sys", ignorenulls=True).alias("sys"), F.sum("tok").alias("tok"),
    )
    context = F.when(F.col("window_no") > 1, F.concat(F.when(F.col("sys").isNotNull(), F.array("sys.piece")).otherwise(F.array().cast("array<string>")), F.transform("history", lambda x: x["piece"]))).otherwise(F.array().cast("array<string>"))
    windows = windows.withColumn("context", context).withColumn("ctx", F.array_join("context", ""))
    spans = F.transform(
        F.filter("new", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((F.length("ctx") + t["at"] - F.col("new")[0]["at"] + t["head"] + 1).cast("int").alias("start"), (t["rest"] - len(END) - 1).cast("int").alias("length")),
    )
    return windows.select(
        "conv_id", "window_no", F.concat("ctx", F.array_join(F.transform("new", lambda t: t["piece"]), "")).alias("formatted"), spans.alias("loss_spans"),
        F.size("context").alias("n_context"), F.size("new").alias("n_turns"),
        (F.col("tok") + F.when(F.col("window_no") > 1, F.coalesce(F.col("sys.tok"), F.lit(0)) + F.aggregate("history", F.lit(0).cast("long"), lambda s, x: s + x["tok"])).otherwise(0)).alias("tokens"),
    ).withColumn("over_budget", F.col("tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars): what the formatted windows say, each turn once.

    turns: role, newline, text, newline of each new turn, end to end.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("n_context") + 1, F.col("n_turns"))
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    role = lambda p: F.substring_index(p, "\n", 1)
    said = F.transform(body, lambda p: F.concat(unescape_role(role(p)), F.lit("\n"), unescape(F.substr(p, F.length(role(p)) + 2)), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"])))
    parts = windows.select("conv_id", "window_no", "n_turns", F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.sum("n_turns").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window_no", "said", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda x: F.array_join(F.transform("w", lambda w: w[x]), "")
    return whole.select("conv_id", "n_turns", joined("said").alias("turns"), joined("loss").alias("loss_text"), "formatted_chars")


def digests(windows: DataFrame) -> DataFrame:
    return read_back(windows).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, length(text) AS chars, (length(text) + 3) // 4 + 4 AS tok,
    length('<|im_start|>' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) AS piece,
    row_number() OVER o AS idx
  FROM given WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (SELECT *, idx = 1 AND role = 'system' AS is_sys FROM r
), c AS (
  SELECT *, max(CASE WHEN is_sys THEN tok END) OVER (PARTITION BY conv_id) AS sys_tok, max(CASE WHEN is_sys THEN piece END) OVER (PARTITION BY conv_id) AS sys_piece,
    coalesce(sum(CASE WHEN is_sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
    lag(tok, 1) OVER o AS t1, lag(tok, 2) OVER o AS t2, lag(piece, 1) OVER o AS p1, lag(piece, 2) OVER o AS p2, lag(is_sys, 1) OVER o AS s1, lag(is_sys, 2) OVER o AS s2
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY idx)
), m AS (SELECT *, 1024 - coalesce(sys_tok, 0) AS room, least(256, greatest(0, floor((1024 - coalesce(sys_tok, 0)) / 4.0))) AS most FROM c
), q AS (SELECT *, greatest(1, floor((room - most) / 2.0)) AS quota FROM m
), b AS (SELECT *, floor(cum / quota) AS bucket, tok > quota AS long, CASE WHEN tok > quota THEN least(most, room - tok) ELSE most END AS cap FROM q
), f AS (
  SELECT *, CASE WHEN idx = 1 THEN 1 WHEN s1 THEN 0 WHEN bucket <> lag(bucket) OVER o OR long OR lag(long) OVER o THEN 1 ELSE 0 END AS fresh
  FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY idx)
), h AS (
  SELECT *, CASE WHEN fresh = 1 AND idx > 1 THEN coalesce(sys_piece, 0) + CASE WHEN NOT s1 AND t1 <= cap THEN p1 + CASE WHEN coalesce(NOT s2 AND t1 + t2 <= cap, false) THEN p2 ELSE 0 END ELSE 0 END ELSE 0 END AS again FROM f
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN chars ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '')) AS loss_sha256,
  CAST(sum(piece + again) AS BIGINT) AS formatted_chars
FROM h GROUP BY conv_id
"""
