"""Queries over run logs, schedules, artifact lists and ranked candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import schedule
from textloom.functions.names import captured_step, is_interrupted_artifact, is_step_artifact
from textloom.operators import ranking, runs
from textloom.plans.catalog_tokens import sql_hash60
from textloom.plans.grouped import find_hot, row_numbers
from textloom.plans.registry import query, table
from textloom.plans.shared_dir import fresh_path
from textloom.sinks.writers import append_table

# The event table read as a run log: user = run, event = step, value = loss.


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("kind"),
        F.col("value").alias("loss"),
    )


_LOG = "(SELECT user_id AS run_id, event_id AS step, event_type AS kind, \"value\" AS loss FROM events)"


@query(
    "tokens_seen",
    "J3",
    f"SELECT run_id, step, CAST(sum(round(loss * 100)) OVER (PARTITION BY run_id ORDER BY step) AS BIGINT) AS tokens_seen FROM {_LOG}",
)
def _(spark, d):
    n = F.round(F.col("loss") * 100).cast("bigint")
    return runs.tokens_seen(_log(spark, d), ["run_id"], "step", n).select("run_id", "step", "tokens_seen")


@query(
    "mean_loss_of_first_batches",
    "J4",
    f"""WITH b AS (SELECT kind AS split, loss, row_number() OVER (PARTITION BY kind ORDER BY step) - 1 AS batch_id FROM {_LOG}),
        m AS (SELECT split, avg(loss) AS mean_loss FROM b WHERE batch_id < 20 GROUP BY split)
        SELECT split, round(coalesce(mean_loss, 'nan'::DOUBLE), 6) AS mean_loss
        FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'empty']) AS split) LEFT JOIN m USING (split)""",
)
def _(spark, d):
    batches = runs.first_batches(_log(spark, d).withColumnRenamed("kind", "split"), ["split"], "step", 20)
    names = ["click", "error", "purchase", "signup", "view", "empty"]
    return runs.mean_first_batches(batches, names, None).select("split", F.round("mean_loss", 6).alias("mean_loss"))


@query(
    "sampled_steps",
    "J5",
    f"""SELECT run_id, step, loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM {_LOG})
        WHERE step % 100 = 0 OR rn = 1""",
)
def _(spark, d):
    return runs.sampled_steps(_log(spark, d), ["run_id"], "step", 100).select("run_id", "step", "loss")


_LR_SQL = """WITH p AS (SELECT event_id AS step, count(*) OVER () AS total FROM events),
  q AS (SELECT step, total, CAST(floor(0.02::DOUBLE * total) AS BIGINT) AS warm,
               CAST(floor(0.02::DOUBLE * total) + floor(0.15::DOUBLE * total) AS BIGINT) AS held,
               CAST(floor(0.9::DOUBLE * total) AS BIGINT) AS last FROM p)
  SELECT step, round(1e9 * CASE WHEN step < warm THEN 1e-5 + step * ((2e-4 - 1e-5) / warm)
     WHEN step < held THEN 2e-4
     WHEN step < last THEN 2e-5 + (2e-4 - 2e-5) * 0.5 * (1 + cos(pi() * ((step - held) / (last - held)::DOUBLE)))
     ELSE 2e-5 END, 3) AS nano_lr FROM q"""


@query("learning_rates", "J6", _LR_SQL)
def _(spark, d):
    events = table(spark, d, "events")
    total = events.agg(F.count("*")).scalar()
    steps = events.select(F.col("event_id").alias("step"), total.alias("total"))
    lr = schedule.learning_rate(F.col("step"), F.col("total"))
    return steps.select("step", F.round(lr * 1e9, 3).alias("nano_lr"))


@query(
    "learning_rates_two_phase",
    "J6b",
    """WITH p AS (SELECT event_id AS step, count(*) OVER () AS total FROM events), q AS (SELECT step, total, 0.1::DOUBLE * total AS warm FROM p)
       SELECT step, round(1e9 * CASE WHEN step < warm THEN 1e-5 + step * ((2e-4 - 1e-5) / warm)
         ELSE 2e-5 + (2e-4 - 2e-5) * 0.5 * (1 + cos(pi() * ((step - warm) / (total - warm)))) END, 3) AS nano_lr FROM q""",
)
def _(spark, d):
    events = table(spark, d, "events")
    total = events.agg(F.count("*")).scalar()
    steps = events.select(F.col("event_id").alias("step"), total.alias("total"))
    lr = schedule.learning_rate_two_phase(F.col("step"), F.col("total"))
    return steps.select("step", F.round(lr * 1e9, 3).alias("nano_lr"))


@query(
    "even_axis",
    "J7",
    f"""SELECT run_id, step, round(CASE WHEN n > 1 THEN rn / (n - 1)::DOUBLE * 2 ELSE 0 END, 9) AS axis FROM (SELECT run_id, step,
        row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM {_LOG})""",
)
def _(spark, d):
    return runs.even_axis(_log(spark, d), ["run_id"], "step", 2.0).select("run_id", "step", F.round("axis", 9).alias("axis"))


@query(
    "run_log_appended",
    "B6 J1",
    f"""SELECT run_id, step, metric, "value" FROM (SELECT run_id, step, 'train_loss' AS metric, loss AS "value" FROM {_LOG}
        UNION ALL SELECT run_id, step, 'global_step', CAST(step + 1 AS DOUBLE) FROM {_LOG})""",
)
def _(spark, d):
    path = fresh_path(spark, "run-log")
    log = _log(spark, d)
    append_table(runs.long_metrics(log, "run_id", "step", {"train_loss": F.col("loss")}), path)
    append_table(runs.long_metrics(log, "run_id", "step", {"global_step": F.col("step") + 1}), path)
    return spark.read.parquet(path)


# Artifact names from orders: some are step files, some interrupted, some of other kinds.
_NAMES_SQL = """(SELECT o_custkey AS grp, o_orderkey AS ord, CASE o_orderstatus
    WHEN 'O' THEN 'model_pg_' || o_orderkey || '_steps.pth' WHEN 'P' THEN 'model_pg_' || o_orderkey || '_interrupted.pth'
    ELSE 'model_pg_epoch_' || o_orderkey || '_steps.pth' END AS name FROM orders)"""


def _artifacts(spark, d):
    name = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("model_pg_"), "o_orderkey", F.lit("_steps.pth")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("model_pg_"), "o_orderkey", F.lit("_interrupted.pth")))
        .otherwise(F.concat(F.lit("model_pg_epoch_"), "o_orderkey", F.lit("_steps.pth")))
    )
    return table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ord"), name.alias("name"))


@query(
    "artifact_names",
    "C6",
    f"""SELECT ord, name LIKE 'model~_pg~_%' ESCAPE '~' AND name LIKE '%~_steps.pth' ESCAPE '~' AS is_step,
        name LIKE '%~_interrupted.pth' ESCAPE '~' AS is_interrupted,
        TRY_CAST(regexp_extract(name, 'model_pg_(\\d+)_steps\\.pth', 1) AS BIGINT) AS step FROM {_NAMES_SQL}""",
)
def _(spark, d):
    name = F.col("name")
    return _artifacts(spark, d).select(
        "ord", is_step_artifact(name).alias("is_step"), is_interrupted_artifact(name).alias("is_interrupted"),
        captured_step(name).alias("step"),
    )


@query(
    "latest_artifacts",
    "J8",
    f"""SELECT grp, arg_max(name, step) AS name, max(step) AS step FROM (SELECT grp, name,
        TRY_CAST(regexp_extract(name, '^model_pg_(\\d+)_steps\\.pth$', 1) AS BIGINT) AS step FROM {_NAMES_SQL}) WHERE step > 0 GROUP BY grp""",
)
def _(spark, d):
    return runs.latest_artifact(_artifacts(spark, d), ["grp"], "name", "ord")


@query(
    "artifact_retention",
    "J9",
    f"""WITH n AS (SELECT *, TRY_CAST(regexp_extract(name, '^model_pg_(\\d+)_steps\\.pth$', 1) AS BIGINT) AS step FROM {_NAMES_SQL}),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY step DESC, ord) AS k FROM n WHERE step IS NOT NULL)
        SELECT grp, name, CASE WHEN k <= 2 THEN 'keep' ELSE 'delete' END AS action FROM r
        UNION ALL SELECT grp, name, CASE WHEN name LIKE '%interrupted.pth' THEN 'delete' ELSE 'ignore' END FROM n WHERE step IS NULL""",
)
def _(spark, d):
    return runs.retention(_artifacts(spark, d), ["grp"], "name", "ord", keep=2).select("grp", "name", "action")


_SPAN = "CAST(floor(epoch(ts)) AS BIGINT) - 1704067200"


@query(
    "duration_texts",
    "J10",
    f"""WITH s AS (SELECT event_id, {_SPAN} AS x FROM events),
        p AS (SELECT event_id, x // 86400 AS d, x % 86400 // 3600 AS h, x % 3600 // 60 AS m, x % 60 AS s FROM s),
        t AS (SELECT *, CASE WHEN d > 0 THEN d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END END AS td,
              CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END END AS th,
              CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END END AS tm FROM p)
        SELECT event_id, concat_ws(', ', td, th, tm, CASE WHEN s > 0 OR coalesce(td, th, tm) IS NULL
               THEN s || ' second' || CASE WHEN s > 1 THEN 's' ELSE '' END END) AS elapsed, d * 24 + h AS hours, m AS minutes, s AS seconds FROM t""",
)
def _(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start, end = F.lit(0).cast("bigint"), F.timestamp_diff("SECOND", start, F.col("ts").cast("timestamp_ntz"))
    parts = schedule.hms(end - start)
    return table(spark, d, "events").select(
        "event_id", schedule.duration_text(start, end).alias("elapsed"), parts["hours"].alias("hours"),
        parts["minutes"].alias("minutes"), parts["seconds"].alias("seconds"),
    )


@query(
    "epoch_positions",
    "J12",
    f"""SELECT run_id, step, CASE WHEN step > 700 THEN step % 700 ELSE 0 END AS epochs, step // 700 AS epoch FROM {_LOG}""",
)
def _(spark, d):
    step = F.col("step")
    return _log(spark, d).select("run_id", "step", runs.epoch_position(step, 700).alias("epochs"), runs.epoch_number(step, 700).alias("epoch"))


# -- ranking -----------------------------------------------------------------------------
# Candidates: each vector is a group, its dimensions are the items.

_CAND = "(SELECT vec_id AS grp, CAST(i AS INTEGER) AS item, CAST(s AS DOUBLE) AS score FROM (SELECT vec_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
_PROB = f"""c AS (SELECT grp, item, score / 0.7::DOUBLE AS x FROM {_CAND}),
  m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY grp)) AS e FROM c),
  pr AS (SELECT grp, item, e / sum(e) OVER (PARTITION BY grp) AS prob FROM m)"""


def _candidates(spark, d):
    dims = table(spark, d, "embeddings").select(F.col("vec_id").alias("grp"), F.posexplode("embedding").alias("item", "score"))
    return dims.withColumn("score", F.col("score").cast("double"))


def _probs(spark, d, hot=None):
    return ranking.softmax(_candidates(spark, d), ["grp"], temperature=0.7, hot=hot).select("grp", "item", "prob")


def _hot(spark, d):
    return find_hot(_candidates(spark, d), ["grp"])


def _rounded(df):
    return df.select("grp", "item", F.round("prob", 9).alias("prob"))


@query("softmax", "K1", f"WITH {_PROB} SELECT grp, item, round(prob, 9) AS prob FROM pr")
def _(spark, d):
    return _rounded(_probs(spark, d))


# scores in tenths, so that many are equal
_TENTHS = f"(SELECT grp, item, round(score, 1) AS score FROM {_CAND})"


@query("top_k_with_ties", "K2", f"SELECT grp, item, score FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score DESC) AS r FROM {_TENTHS}) WHERE r <= 5")
def _(spark, d):
    return ranking.top_k_ties(_candidates(spark, d).withColumn("score", F.round("score", 1)), ["grp"], 5)


@query(
    "top_k_exact",
    "K3",
    f"""WITH {_PROB}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY prob DESC, item DESC) AS r FROM pr)
        SELECT grp, item, round(prob / sum(prob) OVER (PARTITION BY grp), 9) AS prob FROM r WHERE r <= 5""",
)
def _(spark, d):
    hot = _hot(spark, d)
    return _rounded(ranking.top_k(_probs(spark, d, hot), ["grp"], 5, hot=hot))


@query(
    "top_k_capped",
    "K3",
    f"WITH {_PROB} SELECT grp, item, round(prob / (sum(prob) OVER (PARTITION BY grp) + 1e-8), 9) AS prob FROM pr",
)
def _(spark, d):
    hot = _hot(spark, d)
    return _rounded(ranking.top_k(_probs(spark, d, hot), ["grp"], 1000, eps=ranking.EPS, hot=hot))


@query(
    "top_p",
    "K4",
    f"""WITH {_PROB}, r AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, md5(CAST(item AS VARCHAR)), item
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr)
        SELECT grp, item, round(prob / sum(prob) OVER (PARTITION BY grp), 9) AS prob FROM r WHERE before <= 0.9""",
)
def _(spark, d):
    hot = _hot(spark, d)
    return _rounded(ranking.top_p(_probs(spark, d, hot), ["grp"], 0.9, hot=hot))


# event kinds in place of scores: long runs of equal probabilities per group
_EQUAL = "(SELECT event_type AS grp, event_id AS item, (1 + event_id % 2) / 32768.0::DOUBLE AS prob FROM events)"


@query(
    "top_p_equal_items",
    "K4",
    f"""WITH r AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, md5(CAST(item AS VARCHAR)), item
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_EQUAL})
        SELECT grp, item, round(prob / sum(prob) OVER (PARTITION BY grp), 9) AS prob FROM r WHERE before <= 0.05""",
)
def _(spark, d):
    events = table(spark, d, "events")
    prob = (1 + F.col("event_id") % 2) / F.lit(32768.0)
    rows = events.select(F.col("event_type").alias("grp"), F.col("event_id").alias("item"), prob.alias("prob"))
    return _rounded(ranking.top_p(rows, ["grp"], 0.05))


@query(
    "arg_max",
    "K5",
    f"SELECT grp, item, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, item) AS r FROM {_TENTHS}) WHERE r = 1",
)
def _(spark, d):
    return ranking.arg_max(_candidates(spark, d).withColumn("score", F.round("score", 1)), ["grp"])


_U = f"(({sql_hash60('grp', 'item')} >> 8) + 0.5) / 4503599627370496.0"


@query("weighted_draw", "K6", f"WITH {_PROB} SELECT grp, arg_min(item, -ln({_U}) / prob) AS item FROM pr GROUP BY grp")
def _(spark, d):
    return ranking.weighted_draw(_probs(spark, d), ["grp"])


# per user: the event kinds are the items, their summed value the score, the events the history
_USER = "(SELECT user_id AS grp, event_type AS item, sum(\"value\") AS score FROM events GROUP BY 1, 2)"
_HIST = "(SELECT user_id AS grp, event_id AS pos, event_type AS item FROM events)"


def _user_scores(spark, d):
    events = table(spark, d, "events")
    scores = events.groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("item")).agg(F.sum("value").alias("score"))
    history = events.select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), F.col("event_type").alias("item"))
    return scores, history


@query(
    "repetition_penalty",
    "K7",
    f"""SELECT grp, item, round(score / pow(1.2::DOUBLE, coalesce(m, 0)), 6) AS score FROM {_USER}
        LEFT JOIN (SELECT grp, item, count(*) - 1 AS m FROM {_HIST} GROUP BY 1, 2) USING (grp, item)""",
)
def _(spark, d):
    scores, history = _user_scores(spark, d)
    return ranking.repetition_penalty(scores, history, ["grp"], 1.2).select("grp", "item", F.round("score", 6).alias("score"))


@query(
    "repetition_penalty_newest",
    "K7",
    f"""SELECT grp, item, round(score / pow(1.2::DOUBLE, coalesce(m, 0)), 6) AS score FROM {_USER} LEFT JOIN (
          SELECT grp, item, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos DESC) AS late,
            row_number() OVER (PARTITION BY grp, item ORDER BY pos) AS seen FROM {_HIST}) WHERE late <= 3 AND seen > 1 GROUP BY 1, 2) USING (grp, item)""",
)
def _(spark, d):
    scores, history = _user_scores(spark, d)
    out = ranking.repetition_penalty(scores, history, ["grp"], 1.2, newest=3)
    return out.select("grp", "item", F.round("score", 6).alias("score"))


@query(
    "length_penalty",
    "K8",
    """SELECT event_id, round(CASE WHEN event_type = 'signup' AND event_id % 80 < 50 THEN "value" / ((50 - event_id % 80) / 50.0::DOUBLE) ELSE "value" END, 6) AS ratio,
       round(CASE WHEN event_type = 'signup' AND event_id % 80 < 50 THEN "value" / (1 + (50 - event_id % 80) / 50.0::DOUBLE) ELSE "value" END, 6) AS one_plus FROM events""",
)
def _(spark, d):
    step = F.col("event_id") % 80
    args = (F.col("value"), F.col("event_type"), "signup", step, 50)
    return table(spark, d, "events").select(
        "event_id", F.round(ranking.length_penalty(*args), 6).alias("ratio"),
        F.round(ranking.length_penalty(*args, mode="one_plus"), 6).alias("one_plus"),
    )


@query(
    "last_context_items",
    "K9",
    """SELECT doc_id, array_to_string(a[greatest(len(a) - 15, 1):], ' ') AS words
       FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)""",
)
def _(spark, d):
    last = ranking.last_items(F.split("text", " ", -1), 16)
    return table(spark, d, "documents").select("doc_id", F.array_join(last, " ").alias("words"))
