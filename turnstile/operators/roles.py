"""Speaker roles.

* ``role_scores``: substring votes over the lower-cased class string plus a
  bonus when the block holds code-like content (O60). Substring semantics
  are kept on purpose ("ai" matches inside "main").
* ``alternate``: ties fall back to alternation with the previous turn
  (O61). The sequential rule has a closed form: with ``s`` the last earlier
  index holding a strong role, a neutral turn takes ``role(s)`` when
  ``idx - s`` is even and the other role otherwise; with no strong turn
  before it, ``user`` on even indexes. One window, no recursion.
* ``legacy_vote``: the older multi-signal vote with parity tie-break (O62).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values (O60): class-string signals and their weights.
USER_SIGNALS = ["user", "human", "you", "vous"]
MODEL_SIGNALS = ["assistant", "model", "chatgpt", "deepseek", "ai", "thought", "assistant-message"]
SIGNAL_WEIGHT = 5.0
THOUGHT_WEIGHT = 8.0
CODE_WEIGHT = 2.0
STRONG_CONFIDENCE = 0.8
ALTERNATE_CONFIDENCE = 0.5
FIRST_CONFIDENCE = 0.4

# Fixed values (O62): legacy vote patterns (case-insensitive).
LEGACY_USER = r"\buser\b|human|visitor|vous|question|prompt"
LEGACY_MODEL = r"\bassistant\b|\bmodel\b|\bai\b|bot|response|answer|reply|gemini|gpt|claude|mistral|llm"


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def role_scores(class_str: Column, has_code: Column | None = None) -> tuple[Column, Column]:
    cls = F.lower(F.coalesce(class_str, F.lit("")))
    user = _sum([F.when(F.instr(cls, s) > 0, F.lit(SIGNAL_WEIGHT)).otherwise(F.lit(0.0))
                 for s in USER_SIGNALS])
    model = _sum([F.when(F.instr(cls, s) > 0,
                         F.lit(THOUGHT_WEIGHT if s == "thought" else SIGNAL_WEIGHT)).otherwise(F.lit(0.0))
                  for s in MODEL_SIGNALS])
    if has_code is not None:
        model = model + F.when(has_code, F.lit(CODE_WEIGHT)).otherwise(F.lit(0.0))
    return user, model


def strong_role(user: Column, model: Column) -> Column:
    """'user' / 'model' when one side wins, null on a tie (neutral)."""
    return F.when(user > model, F.lit("user")).when(model > user, F.lit("model"))


def context_free_role(user: Column, model: Column) -> Column:
    """Role with an empty context (validator view): neutral counts as user."""
    return F.coalesce(strong_role(user, model), F.lit("user"))


def _last_strong_plain(df: DataFrame, part: list[str], idx: str, strong: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_s_role", F.last(F.col(strong), ignorenulls=True).over(w))
            .withColumn("_s_idx", F.last(F.when(F.col(strong).isNotNull(), F.col(idx)), ignorenulls=True)
                        .over(w)))


def _last_strong_chunked(df: DataFrame, part: list[str], idx: str, strong: str, chunk: int) -> DataFrame:
    """Segmented scan for hot groups: windows run inside fixed-size chunks of
    ``idx`` (bounded tasks); the last strong turn of every earlier chunk is
    carried in by a window over the per-chunk summaries (one row per chunk,
    so even a group holding a third of all rows stays small there)."""
    d = df.withColumn("_chunk", F.floor(F.col(idx) / chunk))
    inner = Window.partitionBy(*part, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("_l_role", F.last(F.col(strong), ignorenulls=True).over(inner))
         .withColumn("_l_idx", F.last(F.when(F.col(strong).isNotNull(), F.col(idx)), ignorenulls=True)
                     .over(inner)))
    last_in = (d.filter(F.col(strong).isNotNull()).groupBy(*part, "_chunk")
               .agg(F.max_by(F.struct(F.col(idx).alias("i"), F.col(strong).alias("r")), F.col(idx)).alias("s")))
    chunks = d.select(*part, "_chunk").distinct().join(last_in, [*part, "_chunk"], "left")
    cw = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*part, "_chunk", F.last("s", ignorenulls=True).over(cw).alias("_carry"))
    d = d.join(carry, [*part, "_chunk"], "left")
    return (d.withColumn("_s_role", F.coalesce("_l_role", F.col("_carry.r")))
            .withColumn("_s_idx", F.coalesce("_l_idx", F.col("_carry.i")))
            .drop("_chunk", "_l_role", "_l_idx", "_carry"))


def alternate(df: DataFrame, part: list[str], idx: str, strong: str = "strong",
              chunk: int | None = None) -> DataFrame:
    """Adds ``role`` and ``confidence`` from a nullable ``strong`` column.
    ``chunk``: split each group into runs of that many indexes (hot groups)."""
    df = (_last_strong_chunked(df, part, idx, strong, chunk) if chunk
          else _last_strong_plain(df, part, idx, strong))
    other = F.when(F.col("_s_role") == "user", F.lit("model")).otherwise(F.lit("user"))
    role = (F.when(F.col(strong).isNotNull(), F.col(strong))
            .when(F.col("_s_role").isNull(),
                  F.when(F.col(idx) % 2 == 0, F.lit("user")).otherwise(F.lit("model")))
            .when((F.col(idx) - F.col("_s_idx")) % 2 == 0, F.col("_s_role"))
            .otherwise(other))
    conf = (F.when(F.col(strong).isNotNull(), F.lit(STRONG_CONFIDENCE))
            .when(F.col(idx) == 0, F.lit(FIRST_CONFIDENCE))
            .otherwise(F.lit(ALTERNATE_CONFIDENCE)))
    return df.withColumn("role", role).withColumn("confidence", conf).drop("_s_role", "_s_idx")


def legacy_vote(attrs_text: Column, text_len: Column, idx: Column,
                child_user: Column | None = None, child_model: Column | None = None):
    """O62 vote. Returns (label, confidence) columns; label is User/Model."""
    a = F.coalesce(attrs_text, F.lit(""))
    u = F.when(a.rlike("(?i)" + LEGACY_USER), 3).otherwise(0)
    m = F.when(a.rlike("(?i)" + LEGACY_MODEL), 3).otherwise(0)
    if child_user is not None:
        u = u + 2 * child_user
    if child_model is not None:
        m = m + 2 * child_model
    m = m + F.when(text_len > 300, 1).otherwise(0)
    u = u + F.when((text_len <= 300) & (text_len < 150), 1).otherwise(0)
    tie = u == m
    u2 = u + F.when(tie & (idx % 2 == 0), 1).otherwise(0)
    m2 = m + F.when(tie & (idx % 2 != 0), 1).otherwise(0)
    total = (u2 + m2).cast("double")
    label = F.when(u2 > m2, F.lit("User")).otherwise(F.lit("Model"))
    conf = F.when(u2 > m2, u2 / total).otherwise(m2 / total)
    return label, conf
